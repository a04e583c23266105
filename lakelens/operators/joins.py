"""Which columns can join: exact overlaps of all columns at once, and MinHash sketches as an optional pre-filter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakelens.operators.profile import as_text
from lakelens.runtime import small_side, spread, written

# fixed values: sketch shape
HASHES, BANDS, ROWS = 128, 16, 8
#: Columns of a value that are paired in one task.
PIECE = 64


def column_values(tables: dict[str, DataFrame], columns: dict[str, list[str]]) -> DataFrame:
    """(dataset, column, v): non-null values as text of the named columns."""
    parts = []
    for dataset, df in tables.items():
        if cols := columns.get(dataset):
            pairs = F.array(*(F.struct(F.lit(c).alias("column"), as_text(df, c).alias("v")) for c in cols))
            df = spread(df)
            parts.append(df.select(F.lit(dataset).alias("dataset"), F.explode(pairs).alias("p")).select("dataset", "p.column", "p.v").where("v is not null"))
    return reduce(DataFrame.union, parts)


def column_pairs(groups: DataFrame, piece: int = PIECE) -> DataFrame:
    """(a, b, n, some) for the pairs of each group's ``cols`` (an ordered array) that lie in different data sets.

    A group is cut into pieces of ``piece`` columns that are spread over tasks; there each column is a row, and then each
    of its later partners, so no row ever holds all pairs of a value that very many columns have.
    """
    pieces = groups.withColumn("at", F.explode(F.sequence(F.lit(0), F.floor((F.size("cols") - 1) / piece).cast("int"))))
    large = F.size("cols") > piece
    cut = pieces.where(~large).unionByName(pieces.where(large).repartition(F.xxhash64("cols"), "at"))
    each = cut.select("cols", "n", "some", F.posexplode(F.slice("cols", F.col("at") * piece + 1, piece)).alias("i", "a"), "at")
    later = each.select("a", "n", "some", F.explode(F.slice("cols", F.col("at") * piece + F.col("i") + 2, F.size("cols"))).alias("b"))
    return later.where("a.dataset <> b.dataset")


def overlap_edges(values: DataFrame, least: float = 0.5, examples: int = 10) -> DataFrame:
    """Pairs of columns of different data sets with |A ∩ B| / min(|A|, |B|) >= least; full recall, one shuffle by value.

    Values with the same set of columns are counted together before any pair is formed, so work grows with the number
    of such sets, not with the number of shared values. Examples are the smallest shared values; they are looked up for
    the pairs that qualify only.
    """
    column = F.struct("dataset", "column")
    held = written(values.groupBy("v").agg(F.array_sort(F.collect_set(column)).alias("cols")), "overlap-values")
    sizes = held.select(F.explode("cols").alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    shared = held.where("size(cols) > 1")
    # ranks are cut before their shuffle, so a group of very many values isn't gathered in a task
    first = shared.withColumn("r", F.row_number().over(Window.partitionBy("cols").orderBy("v"))).where(F.col("r") <= examples)
    some = first.groupBy("cols").agg(F.sort_array(F.collect_list("v")).alias("some"))
    groups = shared.groupBy("cols").agg(F.count("*").alias("n")).join(some, "cols")
    pairs = column_pairs(written(groups, "overlap-groups"))
    edges = pairs.groupBy("a", "b").agg(F.sum("n").alias("both"))
    left = sizes.select(F.col("c").alias("a"), F.col("n").alias("left_distinct"))
    right = sizes.select(F.col("c").alias("b"), F.col("n").alias("right_distinct"))
    ratio = F.col("both") / F.least("left_distinct", "right_distinct")
    edges = edges.join(left, "a").join(right, "b").where(ratio >= least)
    kept = small_side(edges, "overlap-edges")
    values_of = pairs.join(kept.select("a", "b"), ["a", "b"], "left_semi").select("a", "b", F.explode("some").alias("v"))
    first = values_of.withColumn("r", F.row_number().over(Window.partitionBy("a", "b").orderBy("v"))).where(F.col("r") <= examples)
    some = first.groupBy("a", "b").agg(F.sort_array(F.collect_list("v")).alias("samples"))
    return (
        kept.join(some, ["a", "b"], "left")
        .select(
            F.col("a.dataset").alias("left_dataset"), F.col("a.column").alias("left_column"),
            F.col("b.dataset").alias("right_dataset"), F.col("b.column").alias("right_column"),
            F.round(ratio, 4).alias("overlap_ratio"), "left_distinct", "right_distinct", F.col("both").alias("intersection_size"), "samples",
            F.array(F.concat(F.lit("overlap="), F.col("both"), F.lit("/"), F.least("left_distinct", "right_distinct"))).alias("evidence"),
        )
    )


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from either end."""
    turned = edges.select(
        F.col("right_dataset").alias("left_dataset"), F.col("right_column").alias("left_column"), F.col("left_dataset").alias("right_dataset"),
        F.col("left_column").alias("right_column"), "overlap_ratio", F.col("right_distinct").alias("left_distinct"),
        F.col("left_distinct").alias("right_distinct"), "intersection_size", "samples", "evidence",
    )
    return edges.unionByName(turned)


def joinable(edges: DataFrame, dataset: str, column: str | None = None, top_k: int = 10) -> DataFrame:
    """The best partners of each column of a data set: by overlap, then by how unique the other side is, then by name."""
    own = both_ways(edges).where(F.col("left_dataset") == dataset)
    if column:
        own = own.where(F.col("left_column") == column)
    same = F.levenshtein("left_column", "right_column")
    order = Window.partitionBy("left_column").orderBy(F.desc("overlap_ratio"), same, F.desc("right_distinct"), "right_dataset", "right_column")
    return own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def index_stats(values: DataFrame) -> DataFrame:
    """(dataset, column, n_distinct) of the indexed columns."""
    return values.groupBy("dataset", "column").agg(F.count_distinct("v").alias("n_distinct"))


def minhash(values: DataFrame, hashes: int = HASHES) -> DataFrame:
    """(dataset, column, signature): minima of seeded 64-bit hashes, mergeable, with map-side partials and one shuffle of minima.

    A value is hashed once, and each seed mixes that 64-bit hash. Repeated values change no minimum, so they needn't be removed.
    """
    hashed = values.select("dataset", "column", F.xxhash64("v").alias("h"))
    mins = [F.min(F.xxhash64("h", F.lit(i))).alias(f"h{i}") for i in range(hashes)]
    return hashed.groupBy("dataset", "column").agg(*mins).select("dataset", "column", F.array(*(f"h{i}" for i in range(hashes))).alias("signature"))


def jaccard(a, b, hashes: int = HASHES):
    """Estimated Jaccard similarity: the share of equal positions."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / hashes


def lsh_pairs(signatures: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Pairs of columns of different data sets that share at least one band, with their estimated Jaccard similarity."""
    parts = F.array(*(F.struct(F.lit(b).alias("band"), F.xxhash64(F.slice("signature", b * rows + 1, rows)).alias("h")) for b in range(bands)))
    banded = signatures.select("dataset", "column", F.explode(parts).alias("p")).select("dataset", "column", "p.band", "p.h")
    a, b = banded.alias("a"), banded.alias("b")
    same = (F.col("a.band") == F.col("b.band")) & (F.col("a.h") == F.col("b.h")) & (F.col("a.dataset") < F.col("b.dataset"))
    pairs = a.join(b, same).select(
        F.col("a.dataset").alias("left_dataset"), F.col("a.column").alias("left_column"), F.col("b.dataset").alias("right_dataset"), F.col("b.column").alias("right_column")
    ).distinct()
    left = signatures.select(F.col("dataset").alias("left_dataset"), F.col("column").alias("left_column"), F.col("signature").alias("s"))
    right = signatures.select(F.col("dataset").alias("right_dataset"), F.col("column").alias("right_column"), F.col("signature").alias("t"))
    joined = pairs.join(left, ["left_dataset", "left_column"]).join(right, ["right_dataset", "right_column"])
    return joined.withColumn("jaccard", jaccard("s", "t", bands * rows)).drop("s", "t")
