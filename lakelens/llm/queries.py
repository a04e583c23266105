"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.llm import abuse, frequent, leakage, overlap, quantiles, tokenize
from lakelens.runtime import table


MEASURES = ["temperature_c", "vibration_mms", "power_consumption_kw", "hydraulic_pressure_bar", "coolant_flow_l_min", "remaining_useful_life", "failure_within_7_days"]
POINTS = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.wrong_profiles(table(spark, sf_dir, "sensor_readings"), table(spark, sf_dir, "column_profiles"), MEASURES)


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({p: F.round(p, 4) for p in POINTS})


def p1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of each load and column, from sketches of its days that are merged."""
    readings = table(spark, sf_dir, "sensor_readings").withColumn("day", F.to_date("reading_ts"))
    days = quantiles.sketch(readings, ["dataset_id", "load_id", "day"], MEASURES)
    by = ["dataset_id", "load_id"]
    return rounded(quantiles.percentiles(quantiles.merge(days, by), by, POINTS))


def p1_all_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of each dataset and column over all its loads put together."""
    loads = quantiles.sketch(table(spark, sf_dir, "sensor_readings"), ["dataset_id", "load_id"], MEASURES)
    return rounded(quantiles.percentiles(quantiles.merge(loads, ["dataset_id"]), ["dataset_id"], POINTS))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    joinable = overlap.overlaps_by_days(table(spark, sf_dir, "join_key_values")).candidates()
    return joinable.where("2 * intersection_size >= least(left_distinct, right_distinct)").select("left_set", "right_set")


def p2_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlaps_by_days(table(spark, sf_dir, "join_key_values")).candidates()


def p2_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlaps_in_window(table(spark, sf_dir, "join_key_values")).candidates()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "order_items")
    return frequent.frequent_values(items, ["load_id"], ["product_id", "seller_id"]).select("load_id", "column_name", "value")


def p3_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent.top_values(table(spark, sf_dir, "order_items"), ["load_id"], ["product_id", "seller_id"], 10)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.token_ids(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per leaked item: the number of documents that carry it."""
    return p7_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"))


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.content_scores(table(spark, sf_dir, "documents"), keep=("source",))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.content_scores(table(spark, sf_dir, "documents")).where("flagged").select("doc_id")


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: pages, flagged pages and their share; pages without a source form the group null."""
    flagged = F.count_if("flagged")
    return p8_scores(spark, sf_dir).groupBy("source").agg(
        F.count("*").alias("documents"), flagged.alias("flagged"), F.round(flagged / F.count("*"), 6).alias("rate"),
        F.count_if(F.col("abusive") >= abuse.THRESHOLD).alias("abusive"), F.count_if(F.col("hateful") >= abuse.THRESHOLD).alias("hateful"),
        F.count_if(F.col("sexual") >= abuse.THRESHOLD).alias("sexual"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_percentiles, p1_all_loads, p2_found, p2_candidates, p2_window, p3_found, p3_top_values,
        p6_ids, p7_found, p7_items, p8_found, p8_scores, p8_rates,
    )
}

# Exact SQL. Percentiles are compared as the middle of the bucket, 1 % wide to either side, that holds the exact order
# statistic. The text operators have no SQL: tests hold them against brute force.
_LONG = "UNPIVOT (SELECT dataset_id, load_id, {cols} FROM sensor_readings) ON {names} INTO NAME name VALUE v".format(
    cols=", ".join(f"{c}::DOUBLE AS {c}" for c in MEASURES), names=", ".join(MEASURES)
)
_SETS = "SELECT DISTINCT set_id, lower(trim(value)) AS v{more} FROM join_key_values WHERE value IS NOT NULL AND set_id IS NOT NULL"
_PAIRS = """
sizes AS (SELECT set_id, count(*) AS n FROM m GROUP BY set_id),
pairs AS (SELECT a.set_id AS l, b.set_id AS r, count(*) AS shared FROM m a JOIN m b ON a.v = b.v AND a.set_id < b.set_id GROUP BY 1, 2)
SELECT l AS left_set, r AS right_set{columns} FROM pairs JOIN sizes x ON x.set_id = l JOIN sizes y ON y.set_id = r"""
_CANDIDATE = ", shared AS intersection_size, x.n AS left_distinct, y.n AS right_distinct, shared / least(x.n, y.n) AS overlap_ratio"
_COUNTS = """UNPIVOT (SELECT load_id, product_id, seller_id FROM order_items) ON product_id, seller_id INTO NAME column_name VALUE value"""

_WIDTH = (1 + quantiles.ALPHA) / (1 - quantiles.ALPHA)


def _percentiles(by: str) -> str:
    rank = "l[floor({q} * (n - 1))::BIGINT + 1]"
    middle = f"round(CASE WHEN {rank} = 0 THEN 0 ELSE sign({rank}) * pow({_WIDTH!r}, ceil(ln(abs({rank})) / ln({_WIDTH!r}))) * 2 / ({_WIDTH!r} + 1) END, 4)"
    points = ", ".join(f"{middle.format(q=q)} AS {p}" for p, q in POINTS.items())
    return f"SELECT {by}, name, n, {points} FROM (SELECT {by}, name, count(*) AS n, list_sort(list(v)) AS l FROM ({_LONG}) WHERE v IS NOT NULL GROUP BY ALL)"


ORACLES: dict[str, str] = {
    "p1_percentiles": _percentiles("dataset_id, load_id"),
    "p1_all_loads": _percentiles("dataset_id"),
    "p1_found": f"""
        WITH v AS ({_LONG}),
        m AS (SELECT profile_id, dataset_id, load_id, name, unnest([struct_pack(k := i, x := histogram[i].hi) FOR i IN range(1, 10)] || [struct_pack(k := 0, x := mean_val)], recursive := true)
              FROM column_profiles WHERE histogram IS NOT NULL),
        c AS (SELECT m.profile_id, m.k, count(*) AS n, count(*) FILTER (WHERE v.v <= m.x) AS c
              FROM m JOIN v USING (dataset_id, load_id, name) WHERE m.x IS NOT NULL GROUP BY 1, 2)
        SELECT DISTINCT profile_id FROM c
        WHERE CASE WHEN k > 0 THEN abs(20 * c - 2 * k * n) > n ELSE 20 * c > 19 * n OR 20 * c < n END""",
    "p2_found": "WITH m AS (" + _SETS.format(more="") + ")," + _PAIRS.format(columns="") + " WHERE 2 * shared >= least(x.n, y.n)",
    "p2_candidates": "WITH m AS (" + _SETS.format(more="") + ")," + _PAIRS.format(columns=_CANDIDATE),
    "p2_window": """WITH m AS (SELECT set_id, lower(trim(value)) AS v FROM join_key_values WHERE value IS NOT NULL AND set_id IS NOT NULL
        GROUP BY 1, 2 HAVING max(seen_ts) > (SELECT max(seen_ts) FROM join_key_values) - INTERVAL 14 DAY),""" + _PAIRS.format(columns=_CANDIDATE),
    "p3_found": f"""WITH c AS (SELECT load_id, column_name, value, count(*) AS cnt FROM ({_COUNTS}) GROUP BY ALL),
        t AS (SELECT *, sum(cnt) OVER (PARTITION BY load_id, column_name) AS n FROM c)
        SELECT load_id, column_name, value FROM t WHERE cnt * 100 >= n""",
    "p3_top_values": f"""WITH c AS (SELECT load_id, column_name, value, count(*) AS cnt FROM ({_COUNTS}) GROUP BY ALL)
        SELECT *, row_number() OVER (PARTITION BY load_id, column_name ORDER BY cnt DESC, value)::INTEGER AS rank FROM c
        QUALIFY rank <= 10""",
}
