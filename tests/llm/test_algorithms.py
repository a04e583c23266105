"""Percentiles, overlaps and frequent values against brute force, with nulls, ties, repeated rows and empty tables."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from lakelens.llm import frequent, overlap, quantiles


@pytest.fixture(scope="module")
def readings(spark):
    rng = random.Random(2)
    rows = []
    for load in (1, 2, None):
        for _ in range(400):
            v = rng.choice([0.0, -rng.lognormvariate(0, 3), rng.lognormvariate(0, 3), None, float("nan"), 5.0])
            rows.append(("d", load, v, rng.randrange(3), "clash"))
    rows += [("d", 3, None, 1, "x")] * 5 + [("d", 4, 1e300, 1, "x"), ("d", 4, -1e-300, 1, "x"), ("d", 4, math.inf, 1, "x")]
    return rows, spark.createDataFrame(rows, "dataset_id string, load_id long, temperature_c double, day int, name string")


@pytest.mark.parametrize("alpha", [0.01, 0.1])
def test_percentiles_have_bounded_error(readings, alpha):
    rows, df = readings
    by = ["dataset_id", "load_id"]
    points = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    days = quantiles.sketch(df, [*by, "day"], ["temperature_c"], alpha)
    got = {(r.dataset_id, r.load_id): r for r in quantiles.percentiles(quantiles.merge(days, by), by, points, alpha).collect()}
    assert ("d", 3) not in got
    for load in (1, 2, None, 4):
        values = sorted(r[2] for r in rows if r[1] == load and r[2] is not None and not math.isnan(r[2]))
        assert got["d", load].n == len(values)
        for name, q in points.items():
            true, guess = values[math.floor(q * (len(values) - 1))], got["d", load][name]
            assert guess == true if math.isinf(true) else abs(guess - true) <= alpha * abs(true) * (1 + 1e-9)
    whole = quantiles.sketch(df, by, ["temperature_c"], alpha)
    assert sorted(map(str, whole.collect())) == sorted(map(str, quantiles.merge(days, by).select(whole.columns).collect()))
    assert quantiles.sketch(df.limit(0), by, ["temperature_c"]).count() == 0
    with pytest.raises(ValueError):
        quantiles.sketch(df, ["name"], ["temperature_c"])


def test_wrong_profiles(spark, readings):
    rows, df = readings
    rng, profiles, want = random.Random(4), [], set()
    for pid in range(60):
        load = rng.choice([1, 2, 3, 99])
        values = sorted(r[2] for r in rows if r[1] == load and r[2] is not None and not math.isnan(r[2])) or [0.0]
        shift = rng.choice([0, 0, 0.02, 0.049, 0.051, 0.3])
        cuts = [values[min(len(values) - 1, max(0, math.ceil((k / 10 + shift) * len(values)) - 1))] for k in range(1, 11)]
        mean = rng.choice([values[len(values) // 2], values[-1], None])
        profiles.append((pid, "d", load, "temperature_c", [(0.0, c, 1) for c in cuts] if pid % 7 else None, mean))
        if load in (1, 2) and pid % 7:
            n = len(values)
            share = lambda x: sum(v <= x for v in values)  # noqa: E731, B023
            if any(abs(20 * share(c) - 2 * k * n) > n for k, c in enumerate(cuts[:9], 1)) or mean is not None and not 0.05 * n <= share(mean) <= 0.95 * n:
                want.add(pid)
    table = spark.createDataFrame(profiles + profiles[:3], "profile_id long, dataset_id string, load_id long, name string, histogram array<struct<lo: double, hi: double, cnt: long>>, mean_val double")
    for alpha in (0.01, 0.5):  # coarse buckets leave more to the exact step, never another result
        got = [r.profile_id for r in quantiles.wrong_profiles(df, table, ["temperature_c"], alpha).collect()]
        assert sorted(got) == sorted(want)
    assert quantiles.wrong_profiles(df, table.limit(0), ["temperature_c"]).count() == 0


def pairs_of(members):
    sets = {}
    for v, s in members:
        sets.setdefault(s, set()).add(v)
    return {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b and sets[a] & sets[b]}, {s: len(v) for s, v in sets.items()}


def test_signed_deltas(spark):
    rng, state, members = random.Random(6), overlap.Overlaps.empty(spark), set()
    for _ in range(3):
        batch = [(rng.choice(["a", "b", "c", "d", "e", "hot"]), rng.randrange(5), rng.random() < 0.6) for _ in range(25)] + [(None, 1, True), ("x", None, True)]
        joins = {(v, s) for v, s, m in batch if m and v and s is not None}
        leaves = {(v, s) for v, s, m in batch if not m} - joins
        members = (members | joins) - leaves
        state = state.apply(spark.createDataFrame(batch * 2, "value string, set_id long, member boolean"))
        pairs, sizes = pairs_of(members)
        assert {(r.left_set, r.right_set): r.shared for r in state.pairs.collect()} == pairs
        assert {r.set_id: r.n for r in state.sizes.collect()} == sizes
    same = state.apply(spark.createDataFrame([], "value string, set_id long, member boolean"))
    assert sorted(map(str, same.candidates().collect())) == sorted(map(str, state.candidates().collect()))
    merged = state.compact()
    assert len(merged.members) == 1 and sorted(map(str, merged.candidates().collect())) == sorted(map(str, state.candidates().collect()))
    again = merged.apply(spark.createDataFrame([("hot", 77, True), ("a", 0, False)], "value string, set_id long, member boolean"))
    members = (members | {("hot", 77)}) - {("a", 0)}
    assert {(r.left_set, r.right_set): r.shared for r in again.pairs.collect()} == pairs_of(members)[0]


def test_identifier_in_very_many_sets(spark):
    """All pairs of its sets are made in pieces, and an increment adds segments of its own size only."""
    n = 2000
    rows = spark.range(n).selectExpr("'hot' AS value", "id AS set_id", "true AS member").union(spark.createDataFrame([("x", 1, True), ("x", 2, True)], "value string, set_id long, member boolean"))
    state = overlap.Overlaps.empty(spark).apply(rows)
    assert state.pairs.count() == n * (n - 1) // 2 and [r.shared for r in state.pairs.where("left_set = 1 and right_set = 2").collect()] == [2]
    after = state.apply(spark.createDataFrame([("hot", 5000, True), ("hot", 7, False), ("y", 3, True)], "value string, set_id long, member boolean"))
    assert after.members[0] is state.members[0] and after.pair_parts[0] is state.pair_parts[0]
    assert after.members[1].count() == 2 and after.pair_parts[1].count() == (n - 1) * 2 and after.size_parts[1].count() == 3
    assert after.pairs.where("left_set = 7 or right_set = 7").count() == 0 and after.pairs.where("right_set = 5000").count() == n - 1
    for piece in (1, 3, 10**6):
        some = state.spark.createDataFrame([([1, 2, 3], [4, 5, 6, 7], [8, 9], 2), ([], [1, 2], [], 1)], "kept array<bigint>, plus array<bigint>, minus array<bigint>, w bigint")
        got = sorted(tuple(r) for r in overlap.pair_deltas(some, piece).collect())
        want = [(min(p, q), max(p, q), 2) for p in (4, 5, 6, 7) for q in (1, 2, 3, *range(p + 1, 8))] + [(min(p, q), max(p, q), -2) for p in (8, 9) for q in (1, 2, 3, *range(p + 1, 10))] + [(1, 2, 1)]
        assert got == sorted(want)


def test_identifiers_and_days(spark):
    from datetime import datetime, timedelta

    t0, rows = datetime(2024, 1, 1), []
    for i in range(40):
        rows += [(1, f" K{i} ", t0 + timedelta(days=i % 20)), (2, f"k{i // 2}", t0 + timedelta(days=i % 9)), (3, None, t0)]
    rows.append((2, "late", None))
    df = spark.createDataFrame(rows, "set_id long, value string, seen_ts timestamp_ntz")
    members = {(v.strip().lower(), s) for s, v, _ in rows if v}
    got = overlap.overlaps_by_days(df)
    assert {(r.left_set, r.right_set): r.shared for r in got.pairs.collect()} == pairs_of(members)[0]
    last = max(t for *_, t in rows if t)
    recent = {(v.strip().lower(), s) for s, v, t in rows if v and t and t > last - timedelta(days=14)}
    got = overlap.overlaps_in_window(df)
    assert {(r.left_set, r.right_set): r.shared for r in got.pairs.collect()} == pairs_of(recent)[0] and {r.set_id: r.n for r in got.sizes.collect()} == pairs_of(recent)[1]
    assert overlap.overlaps_by_days(df.limit(0)).candidates().count() == 0 and overlap.overlaps_in_window(df.limit(0)).candidates().count() == 0


def test_frequent(spark):
    rng, rows = random.Random(8), []
    for g in (1, 2, None):
        rows += [(g, rng.choice(["hot", None, "", f"v{rng.randrange(300)}", f"v{rng.randrange(20)}"]), str(rng.randrange(4)), "clash") for _ in range(500)]
    rows += [(7, "a", None, "x"), (7, "b", None, "x"), (7, "c", None, "x"), (8, None, None, "x")]
    df = spark.createDataFrame(rows, "load_id long, a string, b string, extra string")
    counts = Counter((g, c, v) for g, a, b, _ in rows for c, v in (("a", a), ("b", b)) if v is not None)
    totals = Counter()
    for (g, c, _), n in counts.items():
        totals[g, c] += n
    for bits in ((2, 5), (12, 32)):
        got = {(r.load_id, r.column_name, r.value): r.cnt for r in frequent.frequent_values(df, ["load_id"], ["a", "b"], (1, 50), bits).collect()}
        assert got == {k: n for k, n in counts.items() if n * 50 >= totals[k[0], k[1]]}
        top = {(r.load_id, r.column_name, r["rank"]): (r.value, r.cnt) for r in frequent.top_values(df, ["load_id"], ["a", "b"], 3, bits[0]).collect()}
        want = {}
        for g, c in totals:
            own = sorted(((-n, v) for (h, d, v), n in counts.items() if (h, d) == (g, c)))[:3]
            want |= {(g, c, i + 1): (v, -n) for i, (n, v) in enumerate(own)}
        assert top == want
    assert frequent.frequent_values(df.limit(0), ["load_id"], ["a"]).count() == 0 and frequent.top_values(df.limit(0), ["load_id"], ["a"]).count() == 0


@pytest.mark.parametrize("counters", [1, 6, 22])
def test_top_values_of_a_flat_column(spark, monkeypatch, counters):
    """However many prefixes survive, and however far they are lengthened, the result is the same."""
    monkeypatch.setattr(frequent, "COUNTERS", counters)
    df = spark.range(3000).selectExpr("id % 2 AS load_id", "concat('v', id % 997) AS a", "'clash' AS b")
    got = [tuple(r) for r in frequent.top_values(df, ["load_id"], ["a"], 4, 2).orderBy("load_id", "rank").collect()]
    want = df.groupBy("load_id", "a").count().collect()
    for load in (0, 1):
        best = sorted((-r["count"], r.a) for r in want if r.load_id == load)[:4]
        assert [(v, n) for g, _, v, n, _ in got if g == load] == [(v, -n) for n, v in best]
