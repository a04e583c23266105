"""Departures of loads from an accepted baseline profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakelens.operators.footer_profile import ColumnSpec, profile_columns
from lakelens.operators.profile import bucket_rows, ntile_rows

#: A baseline has one row for each column of a data set; more than this is no baseline.
MOST_COLUMNS = 20_000

NULL_RATE, UNIQUE_RATE, KEY_SHARE, BUCKET_SHARE, UNIQUE_FROM = 0.10, 0.10, 0.20, 0.15, 0.9


def baseline_rows(baseline: DataFrame) -> list[Row]:
    rows = baseline.where("name is not null").limit(MOST_COLUMNS + 1).collect()
    if len(rows) > MOST_COLUMNS:
        raise ValueError("a baseline holds one row for each column")
    return rows


def specs_of(rows: list[Row], distinct: bool = False) -> list[ColumnSpec]:
    """What must be learnt of each column to hold it against the baseline."""
    return [
        ColumnSpec(
            r.name, r.value_pattern, [b.hi for b in (r.histogram or [])[:9]],
            sorted(r.value_counts) if r.value_counts is not None else None, distinct or (r.unique_rate or 0) > UNIQUE_FROM,
            (r.min_val, r.max_val),
        )
        for r in rows
    ]


def departures(spark: SparkSession, path: str, baseline: DataFrame, by: str = "load_id") -> DataFrame:
    """(by, name, finding): one row for each load, column of the baseline, and finding that applies.

    Shares are among non-null values, so a load without any makes no distribution finding; NaN is no range finding;
    baseline fields that are null make no finding; of a column that the baseline has twice the findings of each row
    are united.
    """
    found: DataFrame | None = None
    rows = baseline_rows(baseline)
    batches: list[dict[str, Row]] = []
    for r in rows:  # one pass takes each column once
        batch = next((b for b in batches if r.name not in b), None)
        if batch is None:
            batches.append(batch := {})
        batch[r.name] = r
    for batch in batches:
        specs = specs_of(list(batch.values()))
        profile = profile_columns(spark, path, by, specs)
        tests = []
        for spec in specs:
            tests += [F.when(F.col("name") == spec.name, F.array(*_findings(batch[spec.name], spec)))]
        one = profile.select(F.col("grp").alias(by), "name", F.explode(F.array_compact(F.coalesce(*tests))).alias("finding"))
        found = one if found is None else found.union(one)
    if found is None:
        return spark.createDataFrame([], f"{by} bigint, name string, finding string")
    return found.distinct()


def _findings(b: Row, spec: ColumnSpec) -> list:
    values = F.col("n_rows") - F.col("nulls")
    tests = {}
    if b.missing_rate is not None:
        tests["null_rate"] = F.col("nulls") / F.col("n_rows") > b.missing_rate + NULL_RATE
    if b.unique_rate is not None and b.unique_rate > UNIQUE_FROM:
        tests["unique_rate"] = F.col("n_unique") / F.col("n_rows") < b.unique_rate - UNIQUE_RATE
    bounds = [F.col("low") < b.min_val] * (b.min_val is not None) + [F.col("high") > b.max_val] * (b.max_val is not None)
    if bounds:
        tests["range"] = F.array_contains(F.array(*(F.coalesce(x, F.lit(False)) for x in bounds)), True)
    if spec.pattern:
        tests["pattern"] = F.col("odd") > 0
    if spec.keys is not None:
        tests["distinct"] = F.col("other") > 0
    far = [F.abs(F.get("upto", F.lit(k)) / values - (k + 1) / 10) > BUCKET_SHARE for k in range(len(spec.cuts))]
    if spec.keys is not None and b.row_count:
        far += [F.abs(F.get("per_key", F.lit(i)) / values - b.value_counts[key] / b.row_count) > KEY_SHARE for i, key in enumerate(spec.keys)]
    if far:
        tests["distribution"] = (values > 0) & F.array_contains(F.array(*far), True)
    return [F.when(test, F.lit(name)) for name, test in tests.items()] or [F.lit(None).cast("string")]


def load_profile(spark: SparkSession, path: str, columns: list[str], by: str | None = "load_id", distinct: bool = True) -> DataFrame:
    """(by, name, n_rows, missing_rate, n_unique, unique_rate, min_val, max_val) of each load and column.

    Without ``by`` the table is one group. Without ``distinct`` nothing is decoded where the footers do, and n_unique and unique_rate are null.
    """
    p = profile_columns(spark, path, by, [ColumnSpec(c, distinct=distinct) for c in columns])
    return p.select(
        *([F.col("grp").alias(by)] if by else []), "name", "n_rows", F.round(F.col("nulls") / F.col("n_rows"), 4).alias("missing_rate"),
        "n_unique", F.round(F.col("n_unique") / F.col("n_rows"), 4).alias("unique_rate"),
        F.col("low").alias("min_val"), F.col("high").alias("max_val"),
    )


def load_distribution(spark: SparkSession, path: str, by: str = "load_id", buckets: int = 10) -> DataFrame:
    """(by, name, dtype, n_rows, missing_rate, n_unique, unique_rate, min_val, max_val, min_ts, max_ts, bucket, lo, hi, cnt) of every column of the schema.

    A row for each load, column and bucket of the load's values in NTILE order: numbers and times by size, other types by
    value as text. ``lo`` and ``hi`` are texts; times are in microseconds since 1970 there. A column that is null
    throughout a load has one row with a null bucket; so has a type without an order.
    """
    df = spark.read.parquet(path)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    times = [c for c, t in kinds.items() if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType))]
    numbers = [c for c, t in kinds.items() if isinstance(t, T.NumericType)]
    stats = profile_columns(spark, path, by, [ColumnSpec(c, distinct=True) for c in kinds])
    at = F.timestamp_micros(F.col("low").cast("long")), F.timestamp_micros(F.col("high").cast("long"))
    is_time = F.col("name").isin(times)
    head = stats.select(
        F.col("grp").alias(by), "name", F.element_at(F.create_map(*(F.lit(x) for c, t in kinds.items() for x in (c, t.simpleString()))), F.col("name")).alias("dtype"),
        "n_rows", F.round(F.col("nulls") / F.col("n_rows"), 4).alias("missing_rate"), "n_unique", F.round(F.col("n_unique") / F.col("n_rows"), 4).alias("unique_rate"),
        F.when(~is_time, F.col("low")).alias("min_val"), F.when(~is_time, F.col("high")).alias("max_val"), F.when(is_time, at[0]).alias("min_ts"), F.when(is_time, at[1]).alias("max_ts"),
    )

    def cell(c: str) -> Column:
        x = F.col(f"`{c}`")
        number = F.unix_micros(x.cast("timestamp")) if c in times else x
        text = number.cast("string") if not isinstance(kinds[c], (T.ArrayType, T.MapType, T.StructType)) else F.lit(None).cast("string")
        return F.struct(F.lit(c).alias("name"), (number.cast("double") + F.lit(0.0) if c in times or c in numbers else F.lit(None).cast("double")).alias("x"), text.alias("t"))

    # values are counted first, so that a bucket is found among distinct values only
    cells = df.select(F.col(by).alias(by), F.explode(F.array(*map(cell, kinds))).alias("c")).select(by, "c.*").where("t is not null")
    counts = cells.groupBy(by, "name", "x", F.when(F.col("x").isNull(), F.col("t")).alias("s")).agg(F.count("*").alias("cnt"), F.min("t").alias("t"))
    met = ntile_rows(counts, [by, "name"], ["x", "s"], buckets)
    hist = met.groupBy(by, "name", "bucket").agg(F.min_by("t", F.struct("x", "s")).alias("lo"), F.max_by("t", F.struct("x", "s")).alias("hi"), bucket_rows(buckets).alias("cnt"))
    h, d = head.alias("h"), hist.alias("d")
    joined = h.join(d, F.col(f"h.{by}").eqNullSafe(F.col(f"d.{by}")) & (F.col("h.name") == F.col("d.name")), "left")
    return joined.select("h.*", "d.bucket", "d.lo", "d.hi", "d.cnt")
