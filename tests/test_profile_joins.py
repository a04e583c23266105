"""Profiles, roles, join discovery, vectors, streaming."""

from __future__ import annotations

import math
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakelens.functions import lexicon
from lakelens.functions.types import logical, pii_risk, role_of
from lakelens.operators import joins, vectors
from lakelens.operators import profile as prof
from lakelens.operators.profile import exact_histogram, profile, profile_many
from lakelens.streaming.ingest import merged_counts, value_counts_to


def test_profile_edges(spark):
    df = spark.createDataFrame([(None, "a", 0.0, None), (None, "a", -0.0, [1]), (None, "b", float("nan"), None), (None, None, None, [1])], "`all null` int, s string, x double, arr array<int>")
    p = {r["name"]: r for r in profile(df, "t").collect()}
    assert (p["all null"]["missing_rate"], p["all null"]["n_unique"], p["all null"]["top_values"]) == (1.0, 0, [])
    assert (p["s"]["top_values"], p["s"]["value_counts"], p["s"]["missing_rate"]) == (["a", "b"], {"a": 2, "b": 1}, 0.25)
    assert p["x"]["n_unique"] == 2 and p["arr"]["inferred_role"] == "UNKNOWN"
    empty = {r["name"]: r for r in profile(df.limit(0), "t").collect()}
    assert empty["s"]["unique_rate"] == 0.0 and empty["s"]["sample_values"] == []


def test_sketched_columns(spark):
    df = spark.range(2000).select((F.col("id") % 7).alias("g"), F.col("id").alias("n"))
    p = {r["name"]: r for r in profile(df, "t", exact_distinct=100).collect()}
    assert p["g"]["n_unique"] == 7 and abs(p["n"]["n_unique"] - 2000) < 200 and sum(b["cnt"] for b in p["n"]["histogram"]) == 2000


def test_exact_by_default_at_any_size(spark, monkeypatch):
    plain = prof.scalars
    monkeypatch.setattr(prof, "scalars", lambda df, d="", guess=False: plain(df, d).withColumn("guessed", F.lit(10**9)))
    df = spark.range(3000).select((F.col("id") + 1000).alias("n"))
    p = profile(df, "t").first()
    assert (p.n_unique, p.unique_rate, p.top_values, p.sample_values) == (3000, 1.0, [str(1000 + i) for i in range(5)], [str(1000 + i) for i in range(8)])


def test_many_at_once(spark):
    tables = {"a": spark.range(30).toDF("x"), "b": spark.createDataFrame([("u",), ("u",)], "x string")}
    rows = {(r["dataset_id"], r["name"]): r for r in profile_many(tables).collect()}
    assert rows["a", "x"]["n_unique"] == 30 and rows["b", "x"]["top_values"] == ["u"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-5, 40), min_size=1, max_size=60))
def test_histogram_is_ntile(spark, values):
    counts = spark.createDataFrame([("d", "c", str(float(v)), values.count(v)) for v in set(values)], "dataset string, name string, v string, cnt long")
    got = sorted((r.bucket, r.lo, r.hi, r.cnt) for r in exact_histogram(counts).collect())
    ordered, n = sorted(values), len(values)
    want, at = [], 0
    for b in range(10):
        size = n // 10 + (b < n % 10)
        if size:
            part = ordered[at : at + size]
            want.append((b + 1, float(part[0]), float(part[-1]), size))
        at += size
    assert got == want


def test_histogram_of_many_rows_is_ntile(spark):
    n = 1_000_040
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000).alias("x"))
    got = [(b.lo, b.hi, b.cnt) for b in profile(df, "t").first().histogram]
    counts = sorted((r["x"], r["count"]) for r in df.groupBy("x").count().collect())
    ordered = [x for x, c in counts for _ in range(c)]
    assert got == [(float(ordered[b * n // 10]), float(ordered[(b + 1) * n // 10 - 1]), n // 10) for b in range(10)]


def test_roles():
    assert role_of("l_orderkey", "int64", 1000, 0.9) == "MEASURE" and role_of("l_orderkey", "int64", 1000, 0.9, True) == "IDENTIFIER"
    assert role_of("order_date", "object", 10, 0.1) == "TIME" and role_of("event_id", "int64", 10, 0.1) == "IDENTIFIER"
    assert role_of("x", "float64", 20, 0.9) == "DIMENSION" and role_of("x", "object", 500, 0.95) == "TEXT" and role_of("x", "nested", 0, 0) == "UNKNOWN"
    assert pii_risk("c_name") and pii_risk("credit_card") and not pii_risk("total")
    assert logical(T.DecimalType(5, 2)) == "float64" and logical(T.DayTimeIntervalType()) == "interval" and logical(T.ArrayType(T.FloatType())) == "nested"


def test_vocabulary():
    assert lexicon.canonical("qty") == "quantity" and lexicon.expand("cust_addr") == "customer address" and lexicon.contract("quantity") == "qty"
    assert all(sum(w in words.split() for words in lexicon.FAMILIES.values()) <= 2 for w in lexicon.reverse())
    assert lexicon.domain_of(["o_orderkey", "customer", "price"]) == "commerce" and lexicon.domain_of(["zzz"]) == "general"


def test_overlap_brute_force(spark):
    rng = random.Random(3)
    sets = {("a", "x"): [rng.randrange(40) for _ in range(60)], ("b", "y"): [rng.randrange(60) for _ in range(50)], ("b", "z"): list(range(5)), ("c", "w"): [None, 1, 2, 2]}
    rows = [(d, c, None if v is None else str(v)) for (d, c), vs in sets.items() for v in vs]
    values = spark.createDataFrame(rows, "dataset string, column string, v string").where("v is not null")
    got = {(r.left_dataset, r.left_column, r.right_dataset, r.right_column): (r.intersection_size, r.overlap_ratio, r.samples) for r in joins.overlap_edges(values, 0.3).collect()}
    want = {}
    for (d, c), x in sets.items():
        for (e, f), y in sets.items():
            x1, y1 = {str(v) for v in x if v is not None}, {str(v) for v in y if v is not None}
            if d < e and x1 & y1 and len(x1 & y1) / min(len(x1), len(y1)) >= 0.3:
                want[d, c, e, f] = (len(x1 & y1), round(len(x1 & y1) / min(len(x1), len(y1)), 4), sorted(x1 & y1)[:10])
    assert got == want
    assert joins.joinable(joins.overlap_edges(values, 0.3), "c").count() > 0


def test_value_of_very_many_columns(spark):
    """All pairs of its columns are made in pieces; columns of one data set aren't paired."""
    n = 300
    values = spark.range(n).selectExpr("concat('d', id div 2) AS dataset", "concat('c', id) AS column", "'1' AS v")
    edges = joins.overlap_edges(values)
    assert edges.count() == n * (n - 1) // 2 - n // 2 and edges.where("samples <> array('1') OR overlap_ratio <> 1.0").count() == 0
    groups = values.groupBy().agg(F.array_sort(F.collect_set(F.struct("dataset", "column"))).alias("cols"), F.lit(1).alias("n"), F.array(F.lit("1")).alias("some"))
    for piece in (1, 7, 1000):
        assert joins.column_pairs(groups, piece).count() == n * (n - 1) // 2 - n // 2


def test_minhash_is_near_jaccard(spark):
    a, b = [str(i) for i in range(300)], [str(i) for i in range(100, 400)]
    values = spark.createDataFrame([("a", "x", v) for v in a] + [("b", "y", v) for v in b * 2], "dataset string, column string, v string")
    s = {r["dataset"]: r["signature"] for r in joins.minhash(values).collect()}
    estimate = sum(x == y for x, y in zip(s["a"], s["b"])) / 128
    assert abs(estimate - 0.5) < 3 * math.sqrt(0.25 / 128)
    assert joins.lsh_pairs(joins.minhash(values)).count() <= 1


def test_nearest(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(900, None), (901, []), (902, [1.0, None] + [0.0] * 6), (903, [1.0])]
    df = spark.createDataFrame(rows, "i long, v array<double>")
    got = {(r.query_id, r.id) for r in vectors.nearest(df, df.where("i % 20 = 0"), "i", "v", 5, 0.0, block=2).collect()}
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    want = set()
    for q, v in rows[:60]:
        if q % 20 == 0:
            sims = sorted(((sum(x * y for x, y in zip(unit(v), unit(w))), -i) for i, w in rows[:60] if i != q), reverse=True)[:5]
            want |= {(q, -i) for s, i in sims if s >= 0}
    assert got == want


def test_stream_counts(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = T.StructType.fromDDL("s string")
    for batch in (["a", "a", None], ["a", "b"]):
        spark.createDataFrame([(v,) for v in batch], schema).coalesce(1).write.mode("append").parquet(src)
        value_counts_to(spark, src, schema, ["s"], out, state)
    assert {(r.v, r.cnt) for r in merged_counts(spark, out).collect()} == {("a", 3), ("b", 1)}
