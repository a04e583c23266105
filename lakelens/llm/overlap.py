"""Problem 2: sizes of the overlaps between many large sets, maintained by signed pair deltas.

State, in segments that are only appended to: memberships (value, kept, plus, seq; a value's newest row counts, its sets
are kept and plus), pair deltas (left_set, right_set, shared) and size deltas (set_id, n), to be summed. A batch says which
identifiers join or leave which sets. It is reduced per identifier, joined against those identifiers' other memberships, and
becomes signed deltas. Identifiers whose old sets, joins and leaves are the same are counted together first, so a pair
delta is emitted once for each such signature, not for each identifier; no intersection is materialised. An increment
writes as much as it changes; every ``COMPACT`` segments they are merged.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.runtime import small_side, written

#: Signatures of more sets than this are cut into pieces of as many sets, spread over tasks, and paired row by row.
PIECE = 64
#: Segments of a state before they are merged.
COMPACT = 16

PAIRS = """flatten(array(
    flatten(transform(plus, p -> transform(kept, q -> struct(least(p, q) AS a, greatest(p, q) AS b, w AS d)))),
    flatten(transform(plus, p -> transform(filter(plus, q -> q > p), q -> struct(p AS a, q AS b, w AS d)))),
    flatten(transform(minus, p -> transform(kept, q -> struct(least(p, q) AS a, greatest(p, q) AS b, -w AS d)))),
    flatten(transform(minus, p -> transform(filter(minus, q -> q > p), q -> struct(p AS a, q AS b, -w AS d))))
))"""
SIZES = "flatten(array(transform(plus, p -> struct(p AS s, w AS d)), transform(minus, p -> struct(p AS s, -w AS d))))"


def pair_deltas(signatures: DataFrame, piece: int = PIECE) -> DataFrame:
    """(left_set, right_set, shared) of signatures (kept, plus, minus, w), not yet summed.

    The pairs of a small signature are made in one row. A large one, of an identifier that is in very many sets, is cut
    into pieces of its moves that are spread over tasks; there each move is a row, and then each of its pairs.
    """
    size = F.size("kept") + F.size("plus") + F.size("minus")
    small = signatures.where(size <= piece).select(F.explode(F.expr(PAIRS)).alias("x")).select("x.*")
    parts = []
    for moves, sign in (("plus", 1), ("minus", -1)):
        large = signatures.where((size > piece) & (F.size(moves) > 0)).select("kept", F.col(moves).alias("moves"), (F.col("w") * sign).alias("d"))
        cut = large.withColumn("at", F.explode(F.sequence(F.lit(0), F.floor((F.size("moves") - 1) / piece).cast("int"))))
        spread = cut.repartition(F.xxhash64("moves", "kept"), "at")
        each = spread.select("kept", "moves", "d", F.explode(F.slice("moves", F.col("at") * piece + 1, piece)).alias("p"))
        pairs = each.select("p", "d", F.explode(F.concat("kept", F.filter("moves", lambda q: q > F.col("p")))).alias("q"))
        parts.append(pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "d"))
    return reduce(DataFrame.union, [small, *parts]).select(F.col("a").alias("left_set"), F.col("b").alias("right_set"), F.col("d").alias("shared"))


@dataclass
class Overlaps:
    """Pair counts of sets under joins and leaves; every ``apply`` returns the next state, written to shared storage."""

    spark: SparkSession
    members: list[DataFrame] = field(default_factory=list)
    pair_parts: list[DataFrame] = field(default_factory=list)
    size_parts: list[DataFrame] = field(default_factory=list)
    seq: int = 0

    @staticmethod
    def empty(spark: SparkSession) -> Overlaps:
        return Overlaps(spark)

    @property
    def memberships(self) -> DataFrame:
        """(value, sets) of all identifiers that are in a set."""
        if not self.members:
            return self.spark.createDataFrame([], "value string, sets array<bigint>")
        return self._newest(self.members).where("size(sets) > 0")

    @property
    def pairs(self) -> DataFrame:
        """(left_set, right_set, shared) of sets that share identifiers."""
        parts = self.pair_parts or [self.spark.createDataFrame([], "left_set bigint, right_set bigint, shared bigint")]
        return self._summed(parts, ["left_set", "right_set"], "shared")

    @property
    def sizes(self) -> DataFrame:
        parts = self.size_parts or [self.spark.createDataFrame([], "set_id bigint, n bigint")]
        return self._summed(parts, ["set_id"], "n")

    @staticmethod
    def _summed(parts: list[DataFrame], keys: list[str], what: str) -> DataFrame:
        return parts[0] if len(parts) == 1 else _sum(reduce(DataFrame.unionByName, parts), keys, what)  # a segment holds each key once

    @staticmethod
    def _newest(parts: list[DataFrame]) -> DataFrame:
        sets = F.array_sort(F.array_union("kept", "plus"))
        if len(parts) == 1:  # a segment holds each value once
            return parts[0].select("value", sets.alias("sets"))
        return reduce(DataFrame.unionByName, parts).groupBy("value").agg(F.max_by(sets, "seq").alias("sets"))

    def apply(self, changes: DataFrame) -> Overlaps:
        """``changes``: (value, set_id, member boolean), the membership that shall hold afterwards.

        Null values and set ids don't count; a repeated change counts once; joining a set one is in, and leaving one
        one isn't in, change nothing; if a batch both joins and leaves, the join holds. ``collect_set`` is partial on
        the map side and bounded by the number of sets, whatever share of the rows one identifier has. Of the state only
        the identifiers of the batch are taken, by a broadcast of these where they are few.
        """
        told = (
            changes.where("value is not null and set_id is not null and member is not null")
            .groupBy("value")
            .agg(
                F.collect_set(F.when(F.col("member"), F.col("set_id"))).alias("joined"),
                F.collect_set(F.when(~F.col("member"), F.col("set_id"))).alias("left"),
            )
        )
        none = F.array().cast("array<bigint>")
        if self.members:
            told = written(told, "p2-told")
            touched = small_side(told.select("value"), "p2-touched")
            old = self._newest([part.join(touched, "value", "left_semi") for part in self.members])
            known = told.join(old, "value", "left").withColumn("old", F.coalesce("sets", none))
        else:
            known = told.withColumn("old", none)
        moved = (
            known.select(
                "value",
                F.array_sort(F.array_except("joined", "old")).alias("plus"),
                F.array_sort(F.array_except(F.array_intersect("left", "old"), "joined")).alias("minus"),
                "old",
            )
            .where("size(plus) + size(minus) > 0")
            .select("value", F.array_sort(F.array_except("old", "minus")).alias("kept"), "plus", "minus", F.lit(self.seq).alias("seq"))
        )
        moved = written(moved, "p2-members")
        signatures = written(moved.groupBy("kept", "plus", "minus").agg(F.count("*").alias("w")), "p2-signatures")
        pairs = written(_sum(pair_deltas(signatures), ["left_set", "right_set"], "shared"), "p2-pairs")
        moves = signatures.select(F.explode(F.expr(SIZES)).alias("x")).select(F.col("x.s").alias("set_id"), F.col("x.d").alias("n"))
        sizes = written(_sum(moves, ["set_id"], "n"), "p2-sizes")
        after = Overlaps(self.spark, [*self.members, moved], [*self.pair_parts, pairs], [*self.size_parts, sizes], self.seq + 1)
        return after.compact() if len(after.members) > COMPACT else after

    def compact(self) -> Overlaps:
        """The same state in one segment."""
        none = F.array().cast("array<bigint>")
        members = self.memberships.select("value", F.col("sets").alias("kept"), none.alias("plus"), none.alias("minus"), F.lit(self.seq).alias("seq"))
        return Overlaps(self.spark, [written(members, "p2-members")], [written(self.pairs, "p2-pairs")], [written(self.sizes, "p2-sizes")], self.seq + 1)

    def candidates(self) -> DataFrame:
        """(left_set, right_set, intersection_size, left_distinct, right_distinct, overlap_ratio) of sharing pairs."""
        sizes = self.sizes
        left = sizes.select(F.col("set_id").alias("left_set"), F.col("n").alias("left_distinct"))
        right = sizes.select(F.col("set_id").alias("right_set"), F.col("n").alias("right_distinct"))
        return (
            self.pairs.withColumnRenamed("shared", "intersection_size")
            .join(left, "left_set")
            .join(right, "right_set")
            .select(
                "left_set", "right_set", "intersection_size", "left_distinct", "right_distinct",
                (F.col("intersection_size") / F.least("left_distinct", "right_distinct")).alias("overlap_ratio"),
            )
        )


def _sum(rows: DataFrame, keys: list[str], what: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum(what).alias(what)).where(f"{what} <> 0")


def identifiers(values: DataFrame, value_col: str = "value", set_col: str = "set_id") -> DataFrame:
    """(value, set_id, seen_ts if there): values without surrounding blanks and in lower case; nulls stay null."""
    plain = F.lower(F.regexp_replace(values[value_col], r"^\s+|\s+$", ""))
    extra = [values["seen_ts"]] if "seen_ts" in values.columns else []
    return values.select(plain.alias("value"), values[set_col].cast("long").alias("set_id"), *extra)


def _after(values: DataFrame, newest: datetime, days: int) -> Column:
    """``newest`` minus the days, in the column's own type whatever time zone the driver is in."""
    kind = values.schema["seen_ts"].dataType
    at = F.lit(str(newest)).cast(kind) if kind.simpleString() != "timestamp" else F.lit(newest)
    return at - F.expr(f"interval {int(days)} days")


def overlaps_by_days(values: DataFrame, last_days: int = 7) -> Overlaps:
    """The state after a bulk load of all but the last days, and one increment with these days."""
    rows = identifiers(values).withColumn("member", F.lit(True))
    newest = values.agg(F.max("seen_ts")).first()[0]
    state = Overlaps.empty(values.sparkSession)
    if newest is None:
        return state.apply(rows.drop("seen_ts"))
    recent = F.coalesce(F.col("seen_ts") > _after(values, newest, last_days), F.lit(False))
    return state.apply(rows.where(~recent).drop("seen_ts")).apply(rows.where(recent).drop("seen_ts"))


def overlaps_in_window(values: DataFrame, last_days: int = 14) -> Overlaps:
    """The state for identifiers seen in the last days: all join first, then those not seen since leave."""
    rows = identifiers(values)
    state = Overlaps.empty(values.sparkSession).apply(rows.select("value", "set_id", F.lit(True).alias("member")))
    newest = values.agg(F.max("seen_ts")).first()[0]
    if newest is None:
        return state
    seen = rows.groupBy("value", "set_id").agg(F.max("seen_ts").alias("last"))
    gone = ~F.coalesce(F.col("last") > _after(values, newest, last_days), F.lit(False))
    return state.apply(seen.where(gone).select("value", "set_id", F.lit(False).alias("member")))
