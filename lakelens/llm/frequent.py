"""Problem 3: the most frequent values of huge columns by exact refinement of hash prefixes.

Round by round the table is aggregated by a prefix of each value's hash. A prefix's count is an upper bound for every
value in it, so prefixes that can't reach the current lower bound are dropped and the others lengthened, until whole
values remain. How far they are lengthened depends on how many survive, so a round's counters are bounded however many
distinct values there are. Counts are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakelens.runtime import small_side, written

BITS = (12, 32)
#: A round of ``top_values`` has at most about 2^COUNTERS prefixes in all; prefixes of this many bits hold one value almost always.
COUNTERS, LONG_ENOUGH = 22, 40


def long_form(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by..., column_name, value, h) of all non-null values; h is the value's 64-bit hash."""
    if clash := {"column_name", "value", "h", "p", "cnt", "n"} & set(by):
        raise ValueError(f"group columns may not be called {sorted(clash)}")
    picked = df.select(*(df[c] for c in by), *(df[c].cast("string").alias(c) for c in columns))
    rows = picked.unpivot(by, columns, "column_name", "value").where("value is not null")
    return rows.withColumn("h", F.xxhash64("value"))


def prefix(bits: int) -> Column:
    return F.shiftrightunsigned("h", 64 - bits)


def count_by(rows: DataFrame, keys: list[str], what: Column) -> DataFrame:
    return rows.groupBy(*keys, what).agg(F.count("*").alias("cnt"))


def null_safe_semi(rows: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys, nulls included, are in ``kept``."""
    a, b = rows.alias("a"), kept.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return a.join(b, on, "left_semi")


def frequent_values(df: DataFrame, by: list[str], columns: list[str], share: tuple[int, int] = (1, 100), bits: tuple[int, ...] = BITS) -> DataFrame:
    """(by..., column_name, value, cnt, n) of all values with cnt / n >= share; n counts the group's non-null values.

    Nulls don't count; repeated rows count as often as they are stored; values are compared as stored; a null group
    is a group; empty tables give no rows; other columns are not read. The lower bound is the share itself: at most
    1 / share prefixes of a group survive a round, so what is joined back is bounded by the number of groups.
    """
    keys = [*by, "column_name"]
    rows = long_form(df, by, columns)
    first = written(count_by(rows, keys, prefix(bits[0]).alias("p")), "p3-prefixes")
    reach = F.col("cnt") * share[1] >= F.col("n") * share[0]
    kept = small_side(first.withColumn("n", F.sum("cnt").over(Window.partitionBy(*keys))).where(reach).drop("cnt"), "p3-kept")
    totals = kept.select(*keys, "n").distinct()
    alive = lambda counted: _with_total(counted, totals, keys).where(reach)
    rows = null_safe_semi(rows.withColumn("p", prefix(bits[0])), kept, [*keys, "p"])
    for b in bits[1:]:
        kept = small_side(alive(count_by(rows, keys, prefix(b).alias("p"))).drop("cnt"), "p3-kept")
        rows = null_safe_semi(long_form(df, by, columns).withColumn("p", prefix(b)), kept, [*keys, "p"])
    return alive(count_by(rows, keys, F.col("value"))).select(*keys, "value", "cnt", "n")


def _with_total(counted: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    a, b = counted.alias("a"), totals.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return a.join(b, on).select("a.*", "b.n")


def top_values(df: DataFrame, by: list[str], columns: list[str], k: int = 10, bits: int = BITS[0]) -> DataFrame:
    """(by..., column_name, value, cnt, rank) of the k most frequent values; ties are ranked by value.

    The lower bound is the k-th largest exact count among the values of the k heaviest prefixes, taken anew as long as
    many prefixes survive; every prefix that reaches it is lengthened by as many bits as keep a round's counters within
    2^``COUNTERS``. A column so flat that more prefixes than that survive is counted by value at once, in a distributed
    aggregation that spills: exact at any size, never capped.
    """
    keys = [*by, "column_name"]
    reach = F.col("cnt") >= F.col("n")
    ranked = Window.partitionBy(*keys).orderBy(F.desc("cnt"), "value")
    counted, bound = written(count_by(long_form(df, by, columns), keys, prefix(bits).alias("p")), "p3-prefixes"), None
    while True:
        if bound is None or survivors > 4 * k * groups:
            bound = _kth_count(df, by, columns, k, counted, bits)
            groups = bound.count()
        kept = small_side(_with_total(counted, bound, keys).where(reach).select(*keys, "p"), "p3-kept")
        survivors = kept.count()
        rows = null_safe_semi(long_form(df, by, columns).withColumn("p", prefix(bits)), kept, [*keys, "p"])
        if bits >= LONG_ENOUGH or survivors >> COUNTERS:
            break
        bits = min(LONG_ENOUGH, bits + max(4, COUNTERS - survivors.bit_length()))
        counted = written(count_by(rows, keys, prefix(bits).alias("p")), "p3-prefixes")
    return (
        _with_total(count_by(rows, keys, F.col("value")), bound, keys).where(reach)
        .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
        .select(*keys, "value", "cnt", "rank")
    )


def _kth_count(df: DataFrame, by: list[str], columns: list[str], k: int, counted: DataFrame, bits: int) -> DataFrame:
    """(keys, n): of each group the k-th largest exact count among the values of its k heaviest prefixes, 1 if there are fewer values."""
    keys = [*by, "column_name"]
    order = Window.partitionBy(*keys).orderBy(F.desc("cnt"), "p")
    heavy = small_side(counted.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select(*keys, "p"), "p3-heavy")
    ranked = Window.partitionBy(*keys).orderBy(F.desc("cnt"), "value")
    known = count_by(null_safe_semi(long_form(df, by, columns).withColumn("p", prefix(bits)), heavy, [*keys, "p"]), keys, F.col("value"))
    return small_side(
        known.withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= k).groupBy(*keys)
        .agg(F.when(F.count("*") == k, F.min("cnt")).otherwise(F.lit(1)).alias("n")),
        "p3-bound",
    )
