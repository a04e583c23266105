"""Plan operators on tables with nulls, ties, repeated keys and odd names; cost and optimiser."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lakelens.operators.buckets import medians
from lakelens.operators.relational import PlanError
from lakelens.plans import optimize as opt
from lakelens.plans import plan as plan_module
from lakelens.plans.plan import Plan, PlanOp, compile_plan, execute
from lakelens.sources.catalog import Catalog


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("lake")
    a = spark.createDataFrame(
        [(1, "x", 10.0, "2024-01-31"), (2, "x", None, "no date"), (None, None, 5.0, None), (1, "y", 10.0, "2023-07-01"), (3, "y", 1.0, "2024-02-29")],
        "k int, `a b` string, v double, day string",
    )
    b = spark.createDataFrame([(1, "one"), (1, "uno"), (4, "four"), (None, "none")], "k int, v string")
    a.write.parquet(f"{root}/a.parquet")
    b.write.parquet(f"{root}/b.parquet")
    spark.createDataFrame([], "k int, v double").write.parquet(f"{root}/empty.parquet")
    return Catalog(spark, {n: f"{root}/{n}.parquet" for n in ("a", "b", "empty")})


def run(lake, *steps):
    return [tuple(r) for r in compile_plan(Plan.of(("SCAN", {"dataset": "a"}), *steps), lake).collect()]


@pytest.mark.parametrize(
    "op,value,n",
    [("=", 10, 2), ("!=", 10, 2), (">", 4, 3), ("<=", "5", 2), ("IN", [1, 10], 3), ("NOT IN", [1, 10], 1), ("!=", [1, 10], 1), ("IN", 5, 1),
     ("between", [1, 5], 2), ("=", None, 1), ("IS NOT", None, 4), ("IS", 5, 1), ("IN", [], 0)],
)
def test_filters(lake, op, value, n):
    assert len(run(lake, ("FILTER", {"column": "v", "op": op, "value": value}))) == n


def test_filter_errors(lake):
    for f in ({"column": "v", "op": "~", "value": 1}, {"column": "v", "op": "=", "value": "abc"}, {"column": "nope", "value": 1}):
        with pytest.raises(PlanError):
            run(lake, ("FILTER", f))
    assert execute(Plan.of(("SCAN", {"dataset": "a"}), ("SELECT", {"columns": ["nope"]})), lake).error
    with pytest.raises(PlanError):
        PlanOp("EXPLODE")


def test_groups_and_order(lake):
    group, total = ("GROUPBY", {"keys": ["a b"]}), ("AGGREGATE", {"metric": "v", "func": "sum"})
    assert run(lake, total, group, ("SORT", {"column": "v", "order": "asc"})) == [(None, 5.0), ("x", 10.0), ("y", 11.0)]
    assert set(run(lake, group)) == {("x",), ("y",), (None,)}
    assert run(lake, ("AGGREGATE", {"metric": "k", "func": "count_distinct"}), ("AGGREGATE", {"metric": "v", "func": "median"})) == [(3, 7.5)]
    assert run(lake, group, total, ("SORT", {"column": "v"}), ("LIMIT", {"n": 1})) == [("y", 11.0)]
    assert run(lake, ("SORT", {"column": "k", "order": "asc"}), ("SELECT", {"columns": ["k"]}))[-1] == (None,)


def test_dates(lake):
    steps = [("FILTER", {"column": "y", "value": 2024}), ("DERIVE_TIME", {"source": "day", "target": "y", "unit": "year"}), ("SELECT", {"columns": ["day", "y"]})]
    assert sorted(run(lake, *steps)) == [("2024-01-31", 2024), ("2024-02-29", 2024)]


def test_joins(lake):
    j = lambda how: ("JOIN", {"right_dataset": "b", "left_key": "k", "right_key": "k", "join_type": how})
    pick = ("SELECT", {"columns": ["k", "v", "b.v"]})
    sizes = {how: len(run(lake, j(how), pick)) for how in ("LEFT", "RIGHT", "INNER", "OUTER", "CROSS", "odd")}
    assert sizes == {"LEFT": 7, "RIGHT": 6, "INNER": 4, "OUTER": 9, "CROSS": 20, "odd": 7}
    df = compile_plan(Plan.of(("SCAN", {"dataset": "a"}), j("LEFT"), pick), lake)
    assert df.columns == ["k", "v", "b.v"]
    assert compile_plan(Plan.of(("SCAN", {"dataset": "a"}), j("LEFT")), lake).columns == ["k", "a b", "v", "day"]


@pytest.mark.parametrize("steps", [[], [("GROUPBY", {"keys": ["a b"]})], [("GROUPBY", {"keys": ["v"]})]])
def test_medians_from_bucket_counts(lake, monkeypatch, steps):
    """The same result from either way, next to other aggregates, with null groups and groups without values."""
    more = [*steps, ("AGGREGATE", {"metric": "v", "func": "median"}), ("AGGREGATE", {"metric": "k", "func": "median"}), ("AGGREGATE", {"metric": "v", "func": "sum"})]
    plain = run(lake, *more)
    monkeypatch.setattr(plan_module, "MEDIAN_BYTES", -1)
    assert sorted(map(str, run(lake, *more))) == sorted(map(str, plain))
    only = [*steps, ("AGGREGATE", {"metric": "v", "func": "median"})]
    assert len(run(lake, *only)) == len(plain)


def test_exact_medians(spark):
    rng = random.Random(2)
    rows = [(g, x) for g in (None, 1, 2) for x in [rng.gauss(0, 10**g if g else 1) for _ in range(400 + (g or 0))] + [1e300, -0.0, 0.0, 5.0, 5.0, None]]
    rows += [(3, None), (4, float("inf")), (4, float("-inf")), (4, float("nan")), (5, 7.0)]
    df = spark.createDataFrame(rows, "g int, x double")
    got = {r.g: r.m for r in medians(df, ["g"], "x", "m").collect()}
    want = {r.g: r.m for r in df.groupBy("g").agg(F.median("x").alias("m")).collect()}
    assert got == want and got[3] is None and got[4] == float("inf")
    assert medians(df.where("g is not null and g < 3"), [], "x", "m").collect() == df.where("g is not null and g < 3").agg(F.median("x").alias("m")).collect()


def test_years_are_pushed_down(spark, tmp_path):
    spark.sql("SELECT id, make_date(1990 + int(id), 12, 31) AS d FROM range(20)").write.parquet(f"{tmp_path}/t.parquet")
    lake = Catalog(spark, {"t": f"{tmp_path}/t.parquet"})
    base = [("SCAN", {"dataset": "t"}), ("DERIVE_TIME", {"source": "d", "target": "y", "unit": "year"})]
    for op, value, n in (("=", 1997, 1), (">", 2000, 9), (">=", "2000", 10), ("<", 1995, 5), ("<=", 1995, 6), ("between", [1991, 1993], 3), ("!=", 1997, 19), ("IN", [1991, 2005], 2)):
        df = compile_plan(Plan.of(*base, ("FILTER", {"column": "y", "op": op, "value": value})), lake)
        assert df.count() == n, op
        if op not in ("!=", "IN"):
            assert "PushedFilters: [IsNotNull(d), " in df._jdf.queryExecution().toString()


def test_limits(spark, tmp_path):
    spark.range(700).write.parquet(f"{tmp_path}/t.parquet")
    lake = Catalog(spark, {"t": f"{tmp_path}/t.parquet"})
    plan = Plan.of(("SCAN", {"dataset": "t"}), ("LIMIT", {"n": 650}))
    assert compile_plan(plan, lake).count() == 650 and execute(plan, lake).row_count == 500 and execute(plan, lake, 600).row_count == 600


def test_empty(lake):
    plan = Plan.of(("SCAN", {"dataset": "empty"}), ("GROUPBY", {"keys": ["k"]}), ("AGGREGATE", {"metric": "v"}))
    assert compile_plan(plan, lake).collect() == []


def test_catalyst_does_the_work(lake):
    plan = Plan.of(("SCAN", {"dataset": "a"}), ("FILTER", {"column": "v", "op": ">", "value": 1}), ("GROUPBY", {"keys": ["a b"]}), ("AGGREGATE", {"metric": "v"}), ("SORT", {"column": "v"}), ("LIMIT", {"n": 5}))
    text = compile_plan(plan, lake)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(v), GreaterThan(v,1.0)]" in text and "TakeOrderedAndProject" in text
    assert "ReadSchema: struct<a b:string,v:double>" in text


def test_edit_and_optimise():
    plan = Plan.of(("SCAN", {"dataset": "a"}), ("FILTER", {"column": "v", "op": ">", "value": 1}), ("JOIN", {"right_dataset": "b", "left_key": "k", "right_key": "k"}), ("FILTER", {"column": "v", "op": ">", "value": 1}))
    better, log = opt.optimize(plan)
    assert [s.op for s in better.steps] == ["SCAN", "JOIN", "FILTER"] and len(log) == 2
    assert plan.edit(0).to_dict() == plan.to_dict() and plan.edit(99).to_dict() == plan.to_dict()
    assert len(plan.edit(1).steps) == 3 and plan.edit(1, "modify", {"value": 2}).steps[1].params["value"] == 2
    assert Plan.from_dict(plan.to_dict()).to_dict() == plan.to_dict()


def test_selectivity_and_cost(tmp_path):
    p = {"n_rows": 200_000, "n_unique": 4, "value_counts": {"a": 3, "b": 1}, "histogram": None}
    h = {"n_rows": 200_000, "n_unique": 100, "value_counts": None, "histogram": [{"lo": 0.0, "hi": 10.0, "cnt": 50}, {"lo": 10.0, "hi": 20.0, "cnt": 50}]}
    assert opt.selectivity(p, "=", "a") == (0.75, "high") and opt.selectivity(p, "=", "z") == (0.001, "medium")
    assert opt.selectivity(h, "!=", 5) == (0.99, "medium") and opt.selectivity(h, ">", 15) == (0.25, "high")
    assert opt.selectivity(h, "between", [5, 15]) == (0.5, "high") and opt.selectivity(None, "=", 1)[1] == "low"
    plan = Plan.of(("SCAN", {"dataset": "t"}), ("FILTER", {"column": "h", "op": ">", "value": 15}), ("GROUPBY", {"keys": ["p"]}), ("AGGREGATE", {"metric": "h"}), ("SORT", {"column": "h"}))
    cost = opt.estimate(plan, {"h": h, "p": p})
    assert (cost.rows_out, cost.groups, cost.selectivity) == (4, 4, 0.25) and "sorts without a limit" in cost.warnings
    cache = opt.FeedbackCache(str(tmp_path / "f.json"))
    cache.record("t", "h", ">", 15, 100, 10, 0.25)
    assert opt.estimate(plan, {"h": h, "p": p}, opt.FeedbackCache(str(tmp_path / "f.json"))).selectivity == 0.1
