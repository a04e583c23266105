"""Profiles of whole data sets: one aggregation for all scalars, one count of (column, value) for everything else.

Nothing is computed column by column: the scalars of all columns come from a single pass, and one unpivoted count
frame yields distinct counts, frequent values, samples and value counts together.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakelens.functions.types import NUMERIC, logical, pii_risk, role_of
from lakelens.operators.relational import quoted
from lakelens.runtime import small_side, spread, written

# fixed values: sizes of a profile
TOP, SAMPLES, KEYS, BUCKETS, FEW = 5, 8, 200, 10, 10


def as_text(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (quoted(name).cast("double") + F.lit(0.0)).cast("string")  # -0.0 and 0.0 are one value
    if logical(kind) == "nested":
        return F.to_json(quoted(name)) if not isinstance(kind, T.BinaryType) else F.hex(quoted(name))
    return quoted(name).cast("string")


KEY = ["dataset", "name"]


def long_values(df: DataFrame, columns: list[str], dataset: str, value: Callable[[DataFrame, str], Column], as_name: str) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(c).alias("name"), value(df, c).alias(as_name)) for c in columns))
    return df.select(F.explode(pairs).alias("p")).select(F.lit(dataset).alias("dataset"), "p.name", f"p.{as_name}").where(f"{as_name} is not null")


def long_texts(df: DataFrame, columns: list[str], dataset: str = "") -> DataFrame:
    """(dataset, name, v): every non-null value of the columns as text."""
    return long_values(df, columns, dataset, as_text, "v")


def value_frequencies(tables: dict[str, DataFrame], columns: dict[str, list[str]]) -> DataFrame:
    """(dataset, name, v, cnt): the distinct values of each column; counted on the map side first, so hot values are cheap."""
    parts = [long_texts(df, columns[d], d) for d, df in tables.items() if columns.get(d)]
    return reduce(DataFrame.union, parts).groupBy(*KEY, "v").agg(F.count("*").alias("cnt"))


def scalars(df: DataFrame, dataset: str = "", guess: bool = False) -> DataFrame:
    """One row for each column: dataset, name, n_rows, n_values, min_val, max_val, mean_val (numbers only) and, with
    ``guess``, guessed (the estimated number of distinct values), all from one pass."""
    measures = []
    for i, f in enumerate(df.schema.fields):
        c, number = quoted(f.name), logical(f.dataType) in NUMERIC
        x = c.cast("double") if number else F.lit(None).cast("double")
        measures.append(
            F.struct(
                F.lit(dataset).alias("dataset"), F.lit(f.name).alias("name"), F.count(F.lit(1)).alias("n_rows"), F.count(c).alias("n_values"), F.min(x).alias("min_val"),
                F.max(x).alias("max_val"), F.avg(x).alias("mean_val"),
                (F.approx_count_distinct(c if logical(f.dataType) != "nested" else as_text(df, f.name)) if guess else F.lit(None).cast("long")).alias("guessed"),
            ).alias(f"s{i}")
        )
    one = df.agg(*measures)
    return one.select(F.explode(F.array(*(F.col(f"s{i}") for i in range(len(measures))))).alias("s")).select("s.*")


def ntile(row: str, buckets: int) -> str:
    """SQL of the NTILE bucket of row number ``row`` of ``n``; rows count from 0, and the first n % buckets buckets hold one row more."""
    some = f"(n % {buckets})"
    return f"if({row} < {some} * (n div {buckets} + 1), {row} div (n div {buckets} + 1), {some} + ({row} - {some} * (n div {buckets} + 1)) div greatest(n div {buckets}, 1)) + 1"


def ntile_rows(counts: DataFrame, keys: list[str], order: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Counted values (keys, order columns, ..., cnt) with the ``bucket`` of NTILE and the group's rows ``n``; a value that lies in several buckets comes once for each.

    The first and last row of each bucket are looked up among the cumulated counts. A group's values are spread by ranges,
    and each range starts from the counts of those below it, so no group is sorted in one task. Null keys are keys.
    """
    # written, as ranges are sampled and must not be drawn again
    ranged = written(counts.repartitionByRange(*keys, *order).withColumn("part", F.spark_partition_id()), "profile-ranges")
    by_key = Window.partitionBy(*keys)
    sizes = ranged.groupBy(*keys, "part").agg(F.sum("cnt").alias("size"), F.min(F.struct(*order)).alias("least"))
    before = F.coalesce(F.sum("size").over(by_key.orderBy("least").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = small_side(sizes.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("part").alias("_part"), before.alias("before"), F.sum("size").over(by_key).alias("n")), "profile-starts")
    inside = Window.partitionBy(*keys, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("part") == F.col("_part")]
    placed = ranged.withColumn("within", F.sum("cnt").over(inside)).join(starts, same).withColumn("upto", F.col("before") + F.col("within"))
    return placed.withColumn("bucket", F.explode(F.sequence(F.expr(ntile("(upto - cnt)", buckets)), F.expr(ntile("(upto - 1)", buckets))))).withColumn("bucket", F.col("bucket").cast("int"))


def bucket_rows(buckets: int = BUCKETS) -> Column:
    """The number of rows of a bucket, from ``n`` and ``bucket`` of its values."""
    return F.max(F.expr(f"n div {buckets} + if(bucket <= n % {buckets}, 1, 0)")).cast("long")


def exact_histogram(counts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(dataset, name, bucket, lo, hi, cnt) of NTILE buckets, from value frequencies of numbers."""
    met = ntile_rows(counts.select(*KEY, F.col("v").cast("double").alias("x"), "cnt"), KEY, ["x"], buckets)
    return met.groupBy(*KEY, "bucket").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), bucket_rows(buckets).alias("cnt"))


def cut_histogram(df: DataFrame, columns: list[str], dataset: str = "", buckets: int = BUCKETS) -> DataFrame:
    """The same shape for sketched columns: cut points from mergeable percentile summaries, then one pass of bucket counts."""
    values = long_values(df, columns, dataset, lambda d, c: quoted(c).cast("double"), "x")
    cuts = values.groupBy(*KEY).agg(F.percentile_approx("x", [k / buckets for k in range(1, buckets)], 10_000).alias("cuts"))
    placed = values.join(F.broadcast(cuts), KEY)  # one row for each column of the schema
    bucket = F.size(F.filter("cuts", lambda c: c < F.col("x"))) + 1
    return placed.groupBy(*KEY, bucket.alias("bucket")).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("cnt"))


def sketched_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, ranked) of the approximately most frequent values, from mergeable sketches in one pass.

    Columns without frequent values may get fewer or none.
    """
    tops = [F.struct(F.lit(c).alias("name"), F.expr(f"approx_top_k(v{i}, {SAMPLES}, 10000)").alias("t")).alias(f"t{i}") for i, c in enumerate(columns)]
    one = df.select(*(as_text(df, c).alias(f"v{i}") for i, c in enumerate(columns))).agg(*tops)
    rows = one.select(F.explode(F.array(*(F.col(f"t{i}") for i in range(len(columns))))).alias("s")).select("s.name", F.col("s.t").alias("t"))
    return rows.select("name", F.transform(F.filter("t", lambda x: x["item"].isNotNull()), lambda x, i: F.struct((i + 1).cast("int").alias("r"), x["item"].alias("v"), x["count"].alias("cnt"))).alias("ranked"))


PROFILE = """dataset_id string, name string, dtype string, n_rows bigint, missing_rate double, unique_rate double, n_unique bigint, min_val double,
    max_val double, mean_val double, top_values array<string>, sample_values array<string>, inferred_role string, pii_risk boolean,
    histogram array<struct<lo: double, hi: double, cnt: bigint>>, value_counts map<string, bigint>"""


def profile(df: DataFrame, dataset_id: str, key_suffixes: bool = False, exact_distinct: int | None = None) -> DataFrame:
    """A row for each column with the fields of a column profile; an empty table gives rates of 0 and empty lists.

    Everything is exact at any size. Only where ``exact_distinct`` is given, columns of more distinct values (estimated)
    are profiled by sketches instead.
    Ties among frequent values are ranked by value; samples are the smallest values; nested columns have role UNKNOWN.
    """
    return profile_many({dataset_id: df}, key_suffixes, exact_distinct)


def profile_many(tables: dict[str, DataFrame], key_suffixes: bool = False, exact_distinct: int | None = None) -> DataFrame:
    """The profiles of several data sets by the same few jobs, so that small data sets cost next to nothing.

    Only finished measures come to the driver: a bounded number of values for each column of the schemas.
    """
    tables = {d: spread(df) for d, df in tables.items() if df.columns}
    if not tables:
        raise ValueError("nothing to profile")
    spark = next(iter(tables.values())).sparkSession
    base = {(r["dataset"], r["name"]): r for r in reduce(DataFrame.union, [scalars(df, d, exact_distinct is not None) for d, df in tables.items()]).collect()}
    types = {(d, f.name): logical(f.dataType) for d, df in tables.items() for f in df.schema.fields}
    exact = {d: [c for c in df.columns if exact_distinct is None or base[d, c]["guessed"] <= exact_distinct] for d, df in tables.items()}
    sketched = {d: [c for c in df.columns if c not in exact[d]] for d, df in tables.items()}
    if any(exact.values()):
        counts = written(value_frequencies(tables, exact), "profile-values")
    else:
        counts = spark.createDataFrame([], "dataset string, name string, v string, cnt bigint")
    # distinct counts, frequent values and samples by one job over the counts; a window is cut before its shuffle
    by_count, by_value = Window.partitionBy(*KEY).orderBy(F.desc("cnt"), "v"), Window.partitionBy(*KEY).orderBy("v")
    kind = lambda k: F.lit(k).alias("kind")
    ranked = lambda k, order, n: counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).select(kind(k), *KEY, "v", "cnt", "r")
    distinct = counts.groupBy(*KEY).agg(F.count("*").alias("cnt")).select(kind("n"), *KEY, F.lit(None).cast("string").alias("v"), "cnt", F.lit(0).alias("r"))
    unique: dict[tuple[str, str], int] = {}
    top: dict[tuple[str, str], list] = {}
    samples: dict[tuple[str, str], list[str]] = {}
    for r in distinct.union(ranked("top", by_count, KEYS)).union(ranked("sample", by_value, SAMPLES)).collect():
        k = r["dataset"], r["name"]
        if r["kind"] == "n":
            unique[k] = r["cnt"]
        elif r["kind"] == "top":
            top.setdefault(k, []).append(r)
        else:
            samples.setdefault(k, []).append(r["v"])
    for d, columns in sketched.items():
        for r in sketched_values(tables[d], columns).collect() if columns else []:
            k = (d, r["name"])
            unique[k] = min(base[k]["guessed"], base[k]["n_values"])
            top[k], samples[k] = r["ranked"], sorted(x["v"] for x in r["ranked"])
    numbers = [k for k, t in types.items() if t in NUMERIC and unique.get(k, 0) > FEW]
    small = [k for k in numbers if k[1] in exact[k[0]]]
    hists = []
    if small:
        picked = spark.createDataFrame(small, "dataset string, name string")  # some columns of the schemas
        hists.append(exact_histogram(counts.join(F.broadcast(picked), KEY, "left_semi")))
    for d, df in tables.items():
        if large := [c for c in df.columns if (d, c) in numbers and (d, c) not in small]:
            hists.append(cut_histogram(df, large, d))
    hist: dict[tuple[str, str], list] = {}
    for r in reduce(DataFrame.unionByName, hists).collect() if hists else []:
        hist.setdefault((r["dataset"], r["name"]), []).append(r)
    rows = []
    for k, t in types.items():
        b, n, u, ranked = base[k], base[k]["n_rows"], unique.get(k, 0), sorted(top.get(k, []), key=lambda r: r["r"])
        rate = u / n if n else 0.0
        few = t == "object" and u <= KEYS
        rows.append((
            *k, t, n, round(1 - b["n_values"] / n, 4) if n else 0.0, round(rate, 4), u, b["min_val"], b["max_val"],
            round(b["mean_val"], 4) if b["mean_val"] is not None else None, [r["v"] for r in ranked[:TOP]], sorted(samples.get(k, [])),
            role_of(k[1], t, u, rate, key_suffixes), pii_risk(k[1]),
            [(h["lo"], h["hi"], h["cnt"]) for h in sorted(hist[k], key=lambda h: h["bucket"])] if k in hist else None,
            {r["v"]: r["cnt"] for r in ranked} if few else None,
        ))
    return spark.createDataFrame(rows, PROFILE)
