"""Problem 1: percentiles of very large columns from mergeable signed logarithmic buckets.

A value x != 0 falls into bucket sign(x) * (ceil(log_g |x|) + OFFSET) with g = (1 + alpha) / (1 - alpha), zero into
bucket 0: the bucket numbers order as the values do, every bucket has the same relative width, and its middle is
within ``alpha`` of each value in it. A sketch is a table (group..., name, bucket, cnt); sketches of partitions, days
or loads are merged by adding the counts of equal buckets. All work is JVM-side, with map-side partial counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakelens.operators.buckets import ALPHA, bucket_of, bucket_value
from lakelens.runtime import small_side, written

def long_form(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by..., name, value double) of all non-null, non-NaN values."""
    if clash := {"name", "value", "bucket", "cnt"} & set(by):
        raise ValueError(f"group columns may not be called {sorted(clash)}")
    picked = df.select(*(df[c] for c in by), *(df[c].cast("double").alias(c) for c in columns))
    return picked.unpivot(by, columns, "name", "value").where("value is not null and not isnan(value)")


def sketch(df: DataFrame, by: list[str], columns: list[str], alpha: float = ALPHA) -> DataFrame:
    """(by..., name, bucket, cnt): one partial count per bucket and task, one shuffle of bucket counts.

    Nulls and NaN don't count; repeated rows count as often as they are stored; a null group is a group; a group
    without values, and an empty table, give no rows; other columns of ``df`` are not read.
    """
    rows = long_form(df, by, columns)
    return rows.groupBy(*by, "name", bucket_of(rows["value"], alpha).alias("bucket")).agg(F.count("*").alias("cnt"))


def merge(sketched: DataFrame, by: list[str]) -> DataFrame:
    """The sketch of coarser groups ``by``: counts of equal buckets are added; exact, in any order."""
    return sketched.groupBy(*by, "name", "bucket").agg(F.sum("cnt").alias("cnt"))


def percentiles(sketched: DataFrame, by: list[str], points: dict[str, float], alpha: float = ALPHA) -> DataFrame:
    """(by..., name, n, one column per point): the value of 0-based rank floor(q * (n - 1)) within ``alpha``."""
    whole = Window.partitionBy(*by, "name")
    ranked = sketched.withColumns(
        {"n": F.sum("cnt").over(whole), "upto": F.sum("cnt").over(whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))}
    )
    picks = [
        bucket_value(F.min(F.when(F.col("upto") > F.floor(F.lit(q) * (F.col("n") - 1)), F.col("bucket"))), alpha).alias(name)
        for name, q in points.items()
    ]
    return ranked.groupBy(*by, "name").agg(F.max("n").alias("n"), *picks)


def cdf_bounds(sketched: DataFrame, marks: DataFrame, by: list[str], alpha: float = ALPHA) -> DataFrame:
    """``marks`` (by..., name, x, ...) with n, below and upto: below <= #(values <= x) <= upto, from counts alone.

    Marks and buckets are ordered together in one window for each group, so nothing is joined or multiplied. The
    window's input is bounded by the number of buckets and marks of a group, whatever its number of rows.
    """
    keys = [*by, "name", "bucket"]
    rest = [c for c in marks.columns if c not in keys]
    points = marks.withColumn("bucket", bucket_of(F.col("x"), alpha))
    both = sketched.select(*keys, "cnt", *(F.lit(None).cast(marks.schema[c].dataType).alias(c) for c in rest), F.lit(False).alias("is_mark")).unionByName(
        points.select(*keys, F.lit(0).cast("long").alias("cnt"), *rest, F.lit(True).alias("is_mark"))
    )
    whole = Window.partitionBy(*by, "name")
    upto = whole.orderBy("bucket")
    bounded = both.withColumns(
        {
            "n": F.sum("cnt").over(whole),
            "upto": F.sum("cnt").over(upto.rangeBetween(Window.unboundedPreceding, 0)),
            "below": F.coalesce(F.sum("cnt").over(upto.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        }
    )
    return bounded.where("is_mark").drop("is_mark", "cnt")


def wrong_profiles(readings: DataFrame, profiles: DataFrame, columns: list[str], alpha: float = ALPHA) -> DataFrame:
    """Distinct profile_id of profiles whose histogram or mean_val doesn't describe their load.

    The bucket counts decide almost every profile: F(x) lies between the counts below and up to the bucket of x. Only
    where a threshold falls between these bounds are the values of that one bucket compared exactly.
    A load without values of the column makes no case; a null mean, a null ``hi`` and missing buckets are passed over;
    profiles without a histogram are left out; repeated profiles give one row.
    """
    by = ["dataset_id", "load_id"]
    marks = (
        profiles.where("histogram is not null")
        .select(
            "profile_id", *by, "name",
            F.explode(F.expr("concat(transform(slice(histogram, 1, 9), (h, i) -> struct(i + 1 AS k, double(h.hi) AS x)), array(struct(0 AS k, double(mean_val) AS x)))")).alias("m"),
        )
        .select("profile_id", *by, "name", "m.k", "m.x")
        .where("x is not null and not isnan(x)")
    )
    bounds = cdf_bounds(sketch(readings, by, columns, alpha), marks, by, alpha).where("n > 0")
    # |F - k/10| > 0.05 and F outside [0.05, 0.95], in whole numbers
    beyond = lambda low, high: f"CASE WHEN k > 0 THEN 20 * {low} - 2 * k * n > n OR 20 * {high} - 2 * k * n < -n ELSE 20 * {low} > 19 * n OR 20 * {high} < n END"
    kept = written(bounds.withColumns({"sure": F.expr(beyond("below", "upto")), "possible": F.expr(beyond("upto", "below"))}), "p1-bounds")
    sure = kept.where("sure").select("profile_id").distinct()
    # few rows: at most ten for each profile, those that the bounds leave open
    unsure = small_side(kept.where("possible and not sure").join(sure, "profile_id", "left_anti"), "p1-open")
    if unsure.isEmpty():
        return sure
    rows = long_form(readings, by, columns)
    keys = [*by, "name", "bucket"]
    marked = unsure.select(*keys, "profile_id", "k", "x", "n", "below")
    inside = (
        rows.withColumn("bucket", bucket_of(rows["value"], alpha))
        .join(marked, keys)
        .groupBy("profile_id", "k", "x", "n", "below")
        .agg(F.count_if(F.col("value") <= F.col("x")).alias("inside"))
        .withColumn("c", F.col("below") + F.col("inside"))
    )
    # a bucket without values leaves nothing open: then below = upto, and the bounds were exact
    return sure.union(inside.where(beyond("c", "c")).select("profile_id").distinct())
