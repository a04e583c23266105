"""Signed logarithmic buckets, and exact medians from bucket counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALPHA = 0.01
#: Larger than any |ceil(log_g |x|)| of a double for alpha >= 1e-6.
OFFSET = 1 << 32
#: Equal parts into which the bucket that holds a median is cut.
PARTS = 4096


def gamma(alpha: float) -> float:
    return (1 + alpha) / (1 - alpha)


def bucket_of(x: Column, alpha: float = ALPHA) -> Column:
    """The bucket of a double; infinities fall beyond all finite values.

    A value x != 0 falls into sign(x) * (ceil(log_g |x|) + OFFSET) with g = (1 + alpha) / (1 - alpha), zero into 0, so
    buckets order as values do.
    """
    far = F.lit(OFFSET * 2)
    index = F.when(F.abs(x) == math.inf, far).otherwise(F.ceil(F.log(F.abs(x)) / math.log(gamma(alpha))).cast("long") + OFFSET)
    return F.when(x == 0, F.lit(0).cast("long")).otherwise(F.when(x < 0, -index).otherwise(index))


def bucket_value(bucket: Column, alpha: float = ALPHA) -> Column:
    """The middle of a bucket: within ``alpha`` (relative) of every value in it."""
    g = gamma(alpha)
    size = F.pow(F.lit(g), F.abs(bucket) - OFFSET) * (2 / (g + 1))
    middle = F.when(F.abs(bucket) == OFFSET * 2, F.lit(math.inf)).otherwise(size)
    return F.when(bucket == 0, F.lit(0.0)).otherwise(F.signum(bucket.cast("double")) * middle)


def _hit(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Of counted ranges (keys, which, rank, below, b, cnt, lo, hi) the one that holds each wanted rank."""
    own = Window.partitionBy(*keys, "which").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    upto = counted.withColumn("upto", F.col("below") + F.sum("cnt").over(own))
    return upto.where("upto > rank and upto - cnt <= rank").select(*keys, "which", "rank", (F.col("upto") - F.col("cnt")).alias("below"), "lo", "hi")


def medians(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys..., name): the exact median of each group's non-null values, null for a group without any.

    Values are counted by logarithmic bucket; the bucket that holds the middle is cut into equal parts, and only values of
    the hit part are counted one by one. No task holds a group: what a window sees is bounded by buckets, parts and the
    distinct values of one part. NaN counts as the largest value. All steps are lazy.
    """
    if clash := {"which", "rank", "below", "b", "cnt", "lo", "hi", "x", "n", "upto"} & set(keys):
        raise ValueError(f"group columns may not be called {sorted(clash)}")
    rows = df.select(*(F.col(f"`{k}`").alias(k) for k in keys), F.col(f"`{value}`").cast("double").alias("x"))
    real = rows.where("x is not null")
    ranged = lambda frame, *by: frame.groupBy(*by).agg(F.count("*").alias("cnt"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    coarse = ranged(real, *keys, F.when(F.isnan("x"), F.lit(OFFSET * 2 + 1)).otherwise(bucket_of(F.col("x"))).alias("b"))
    n = F.col("n")
    wanted = F.array(F.struct(F.lit(0).alias("which"), F.floor((n - 1) / 2).alias("rank")), F.struct(F.lit(1).alias("which"), F.floor(n / 2).alias("rank")))
    asked = coarse.withColumn("n", F.sum("cnt").over(Window.partitionBy(*keys))).withColumn("w", F.explode(wanted)).select(*keys, "b", "cnt", "lo", "hi", "w.which", "w.rank", F.lit(0).cast("long").alias("below"))
    hit = _hit(asked, keys)
    part = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * PARTS), F.lit(PARTS - 1))).otherwise(F.lit(0))
    inside = _within(real, hit, keys).select(*keys, "which", "rank", "below", "x", part.alias("b"))
    hit = _hit(ranged(inside, *keys, "which", "rank", "below", "b"), keys)
    each = _within(real, hit, keys).select(*keys, "which", "rank", "below", "x", F.col("x").alias("b"))
    found = _hit(ranged(each, *keys, "which", "rank", "below", "b"), keys).groupBy(*keys).agg(F.avg("lo").alias(name))
    if not keys:
        return found
    a, b = rows.select(*keys).distinct().alias("a"), found.alias("b")
    return a.join(b, [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in keys], "left").select("a.*", f"b.`{name}`")


def _within(rows: DataFrame, hit: DataFrame, keys: list[str]) -> DataFrame:
    a, b = rows.alias("a"), hit.alias("b")
    on = [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in keys]
    near = F.col("x").between(F.col("lo"), F.col("hi"))
    joined = a.join(b, [*on, near]) if keys else a.join(F.broadcast(b), near)  # without keys: two rows
    return joined.select("a.*", "b.which", "b.rank", "b.below", "b.lo", "b.hi")
