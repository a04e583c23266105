"""Queries of the column-level quality profile (p4) and of rows that fail to parse (p5), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.operators import quality, records
from lakelens.runtime import table

TRIPS = ["trip_distance", "trip_duration_minutes", "base_fare", "per_km_rate", "trip_price", "weather", "traffic_conditions", "day_of_week", "trip_id", "vehicle_code"]
NUMBERS = TRIPS[:5]
TIMES = ["pickup_ts", "ingest_ts"]
EVERY = [*TRIPS, *TIMES, "load_id"]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.departures(spark, f"{sf_dir}/taxi_trips.parquet", table(spark, sf_dir, "baseline_profiles"))


def p4_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of every load; times in microseconds since 1970."""
    return quality.load_profile(spark, f"{sf_dir}/taxi_trips.parquet", table(spark, sf_dir, "taxi_trips").columns)


def p4_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of every load, with its distribution."""
    found = quality.load_distribution(spark, f"{sf_dir}/taxi_trips.parquet")
    return found.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("min_ts", "max_ts")})


def p4_footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null shares and extrema of whole tables: footers alone, nothing is decoded."""
    return quality.load_profile(spark, f"{sf_dir}/sensor_readings.parquet", ["temperature_c", "vibration_mms", "remaining_useful_life", "machine_type"], by=None, distinct=False).drop("n_unique", "unique_rate")


def _three(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [table(spark, sf_dir, t) for t in ("raw_records", "profile_cards", "file_columns")]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.failures(*_three(spark, sf_dir))


def p5_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.row_counts(*_three(spark, sf_dir))


def p5_rows_insurance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.typed_rows(*_three(spark, sf_dir), "insurance")


def p5_rows_cat_breed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.typed_rows(*_three(spark, sf_dir), "cat_breed")


def p5_rows_mba_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.typed_rows(*_three(spark, sf_dir), "mba_admission")


def p5_rows_train_energy_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.typed_rows(*_three(spark, sf_dir), "train_energy_data")


QUERIES = {
    f.__name__: f
    for f in (
        p4_found, p4_profile, p4_distribution, p4_footers, p5_found, p5_row_counts,
        p5_rows_insurance, p5_rows_cat_breed, p5_rows_mba_admission, p5_rows_train_energy_data,
    )
}

_WIDE = ", ".join(f"{c}::VARCHAR AS {c}" for c in TRIPS)
_LONG = f"SELECT load_id, name, v FROM (SELECT load_id, {_WIDE} FROM taxi_trips) UNPIVOT INCLUDE NULLS (v FOR name IN ({', '.join(TRIPS)}))"
_NUM = f"CASE WHEN name IN ({', '.join(repr(c) for c in NUMBERS)}) THEN try_cast(v AS DOUBLE) END"
_EVERY = ", ".join(f"epoch_us({c})::VARCHAR AS {c}" if c in TIMES else f"{c}::VARCHAR AS {c}" for c in EVERY)
_SIZE = f"CASE WHEN name IN ({', '.join(repr(c) for c in (*NUMBERS, *TIMES, 'load_id'))}) THEN try_cast(v AS DOUBLE) END"

ORACLES = {
    "p4_found": f"""
        WITH v AS ({_LONG}),
        b AS (SELECT *, histogram IS NOT NULL AS has_hist, value_counts IS NOT NULL AS has_keys FROM baseline_profiles),
        j AS (SELECT v.load_id, b.*, v.v, CASE WHEN b.min_val IS NOT NULL OR b.has_hist THEN try_cast(v.v AS DOUBLE) END AS x FROM v JOIN b ON v.name = b.name),
        g AS (SELECT load_id, name, count(*) AS n, count(v) AS c, count(DISTINCT v) AS d, min(x) AS lo, max(x) AS hi,
                 count(*) FILTER (WHERE v IS NOT NULL AND value_pattern IS NOT NULL AND NOT regexp_full_match(v, value_pattern)) AS odd,
                 count(*) FILTER (WHERE v IS NOT NULL AND has_keys AND NOT list_contains(map_keys(value_counts), v)) AS other
              FROM j GROUP BY 1, 2),
        h AS (SELECT load_id, name, k.k AS k, count(*) FILTER (WHERE x <= histogram[k.k].hi) / nullif(count(v), 0) AS share
              FROM j, (SELECT unnest(range(1, 10)) AS k) k WHERE has_hist GROUP BY 1, 2, 3),
        key AS (SELECT name, row_count, unnest(map_entries(value_counts)) AS e FROM b WHERE has_keys),
        s AS (SELECT j.load_id, j.name, key.e.key AS key, any_value(key.e.value / key.row_count) AS was,
                 count(*) FILTER (WHERE j.v = key.e.key) / nullif(count(j.v), 0) AS share
              FROM j JOIN key ON j.name = key.name GROUP BY 1, 2, 3)
        SELECT load_id, name, 'null_rate' AS finding FROM g JOIN b USING (name) WHERE (n - c) / n > missing_rate + 0.10
        UNION SELECT load_id, name, 'unique_rate' FROM g JOIN b USING (name) WHERE unique_rate > 0.9 AND d / n < unique_rate - 0.10
        UNION SELECT load_id, name, 'range' FROM g JOIN b USING (name) WHERE lo < min_val OR hi > max_val
        UNION SELECT load_id, name, 'pattern' FROM g WHERE odd > 0
        UNION SELECT load_id, name, 'distinct' FROM g WHERE other > 0
        UNION SELECT load_id, name, 'distribution' FROM h WHERE abs(share - k / 10) > 0.15
        UNION SELECT load_id, name, 'distribution' FROM s WHERE abs(share - was) > 0.20""",
    "p4_profile": f"""
        WITH v AS (SELECT g AS load_id, name, v FROM (SELECT load_id AS g, {_EVERY} FROM taxi_trips) UNPIVOT INCLUDE NULLS (v FOR name IN ({', '.join(EVERY)})))
        SELECT load_id, name, count(*) AS n_rows, round((count(*) - count(v)) / count(*), 4) AS missing_rate,
            count(DISTINCT CASE WHEN {_SIZE} = 0 THEN '0' ELSE v END) AS n_unique, round(count(DISTINCT CASE WHEN {_SIZE} = 0 THEN '0' ELSE v END) / count(*), 4) AS unique_rate,
            min({_SIZE}) AS min_val, max({_SIZE}) AS max_val
        FROM v GROUP BY 1, 2""",
    "p4_footers": " UNION ALL ".join(
        f"SELECT '{c}' AS name, count(*) AS n_rows, round((count(*) - count({c})) / count(*), 4) AS missing_rate, "
        + (f"min({c})::DOUBLE AS min_val, max({c})::DOUBLE AS max_val" if c != "machine_type" else "NULL::DOUBLE AS min_val, NULL::DOUBLE AS max_val")
        + " FROM sensor_readings"
        for c in ("temperature_c", "vibration_mms", "remaining_useful_life", "machine_type")
    ),
}

# p4_distribution: NTILE over each column's values in SQL
_NTILE = "SELECT load_id, name, row_number() OVER w AS r, ntile(10) OVER w AS bucket, t, x, s FROM ({0}) WINDOW w AS (PARTITION BY load_id, name ORDER BY x, s)"
_CELLS = " UNION ALL ".join(
    f"SELECT load_id, '{c}' AS name, {value}::VARCHAR AS t, {number} AS x, {text} AS s FROM taxi_trips WHERE {c} IS NOT NULL"
    for c in EVERY
    for value, number, text in [(f"epoch_us({c})", f"epoch_us({c})::DOUBLE", "NULL") if c in TIMES else (c, f"{c}::DOUBLE", "NULL") if c in NUMBERS or c == "load_id" else (c, "NULL", c)]
)
_KINDS = " ".join(f"WHEN p.name = '{c}' THEN '{'timestamp_ntz' if c in TIMES else 'double' if c in NUMBERS else 'bigint' if c == 'load_id' else 'string'}'" for c in EVERY)
ORACLES["p4_distribution"] = f"""WITH p AS ({ORACLES['p4_profile']}),
    h AS (SELECT load_id, name, bucket::INTEGER AS bucket, arg_min(t, r) AS lo, arg_max(t, r) AS hi, count(*) AS cnt FROM ({_NTILE.format(_CELLS)}) GROUP BY 1, 2, 3)
    SELECT p.load_id, p.name, CASE {_KINDS} END AS dtype, n_rows, missing_rate, n_unique, unique_rate,
        CASE WHEN p.name NOT IN ('pickup_ts', 'ingest_ts') THEN min_val END AS min_val, CASE WHEN p.name NOT IN ('pickup_ts', 'ingest_ts') THEN max_val END AS max_val,
        CASE WHEN p.name IN ('pickup_ts', 'ingest_ts') THEN strftime(make_timestamp(min_val::BIGINT), '%Y-%m-%d %H:%M:%S') END AS min_ts,
        CASE WHEN p.name IN ('pickup_ts', 'ingest_ts') THEN strftime(make_timestamp(max_val::BIGINT), '%Y-%m-%d %H:%M:%S') END AS max_ts, bucket, lo, hi, cnt
    FROM p LEFT JOIN h ON p.load_id IS NOT DISTINCT FROM h.load_id AND p.name = h.name"""

# p5: a record is well quoted if it is all fields; fields are then cut one by one
_FIELD = """(?:"(?:[^"]|"")*"|[^"' || d || ']*)"""
_PARSED = f"""
    f AS (SELECT file_path, arg_max(dataset_id, (created_at, card_id)) AS dataset_id, arg_max(delimiter, (created_at, card_id)) AS delimiter FROM profile_cards
          WHERE file_path IS NOT NULL AND delimiter IS NOT NULL GROUP BY 1),
    k AS (SELECT dataset_id, list(name ORDER BY col_pos) AS names, list(dtype ORDER BY col_pos) AS dtypes FROM file_columns GROUP BY 1),
    r AS (SELECT DISTINCT file_path, line_no, dataset_id, names, dtypes, delimiter AS c, '\\' || delimiter AS d, coalesce(raw_record, '') AS r
          FROM raw_records JOIN f USING (file_path) LEFT JOIN k USING (dataset_id) WHERE line_no > 1),
    q AS (SELECT *, regexp_full_match(r, '{_FIELD}(?:' || d || '{_FIELD})*') AS well FROM r),
    s AS (SELECT *, CASE WHEN well THEN list_transform(regexp_extract_all(c || r, d || '({_FIELD})', 1),
              lambda x: CASE WHEN x LIKE '"%' THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) END AS fields FROM q),
    v AS (SELECT *, CASE WHEN well AND len(fields) = len(dtypes) THEN list_filter(range(1, len(fields) + 1), lambda i: CASE
              WHEN trim(fields[i], ' ') = '' THEN false
              WHEN dtypes[i] = 'int64' THEN NOT (regexp_full_match(trim(fields[i], ' '), '[+-]?[0-9]+') AND try_cast(regexp_replace(trim(fields[i], ' '), '^([+-]?)0+([0-9])', '\\1\\2') AS BIGINT) IS NOT NULL)
              WHEN dtypes[i] = 'float64' THEN NOT regexp_full_match(trim(fields[i], ' '), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')
              WHEN dtypes[i] = 'bool' THEN lower(trim(fields[i], ' ')) NOT IN ('true', 'false')
              WHEN dtypes[i] = 'date' THEN NOT (regexp_full_match(trim(fields[i], ' '), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_cast(trim(fields[i], ' ') AS DATE) IS NOT NULL AND trim(fields[i], ' ') >= '0001')
              WHEN dtypes[i] = 'datetime64' THEN NOT (regexp_full_match(trim(fields[i], ' '), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} ([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]') AND try_cast(substr(trim(fields[i], ' '), 1, 10) AS DATE) IS NOT NULL AND trim(fields[i], ' ') >= '0001')
              ELSE false END) END AS wrong FROM s),
    x AS (SELECT *, CASE WHEN NOT well THEN 'quoting' WHEN len(fields) <> len(dtypes) THEN 'column_count' WHEN len(wrong) > 0 THEN 'value' END AS reason FROM v)"""
ORACLES["p5_found"] = f"WITH {_PARSED} SELECT DISTINCT file_path, line_no, reason FROM x WHERE reason IS NOT NULL"
ORACLES["p5_row_counts"] = f"""WITH {_PARSED},
    w AS (SELECT file_path, arg_max(coalesce(row_count, -1), (created_at, card_id)) AS c FROM profile_cards WHERE file_path IS NOT NULL GROUP BY 1),
    n AS (SELECT file_path, count(DISTINCT line_no) AS records FROM raw_records WHERE line_no > 1 GROUP BY 1),
    b AS (SELECT file_path, count(DISTINCT line_no) AS failed FROM x WHERE reason IS NOT NULL GROUP BY 1)
    SELECT file_path, CASE WHEN c >= 0 THEN c END AS claimed, coalesce(records, 0) AS records, coalesce(failed, 0) AS failed, coalesce(records, 0) - coalesce(failed, 0) AS row_count
    FROM w LEFT JOIN n USING (file_path) LEFT JOIN b USING (file_path)"""
# the columns of the fixed table file_columns
_LAYOUTS = {
    "insurance": "policy_no:BIGINT age:BIGINT bmi:DOUBLE charges:DOUBLE smoker:BOOLEAN area:VARCHAR remark:VARCHAR start_date:DATE",
    "cat_breed": "Breed:VARCHAR Country:VARCHAR Fur_colour_dominant:VARCHAR Weight:DOUBLE Body_length:DOUBLE Sleep_time_hours:BIGINT",
    "mba_admission": "applicant_id:BIGINT gpa:DOUBLE gmat:BIGINT work_exp:BIGINT major:VARCHAR work_industry:VARCHAR admission:VARCHAR applied_at:TIMESTAMP",
    "train_energy_data": "Building_Type:VARCHAR Square_Footage:BIGINT Average_Temperature:DOUBLE Energy_Consumption:DOUBLE Day_of_Week:VARCHAR metered:BOOLEAN read_on:DATE",
}
for _name, _columns in _LAYOUTS.items():
    _spaced = _name == "train_energy_data"
    _picks = ", ".join(
        f"""try_cast(nullif(trim(fields[{i}], ' '), '') AS {kind}) AS "{c.replace('_', ' ') if _spaced and c != 'read_on' else c}\""""
        for i, (c, kind) in enumerate((x.split(":") for x in _columns.split()), 1)
    )
    ORACLES[f"p5_rows_{_name}"] = f"WITH {_PARSED} SELECT DISTINCT ON (file_path, line_no) file_path, line_no, {_picks} FROM x WHERE reason IS NULL AND dataset_id = '{_name}'"
