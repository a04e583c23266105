"""Footer profiles and records that fail to parse, against brute force and on awkward input."""

from __future__ import annotations

import math
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lakelens.operators import footer_profile, quality, records

ROWS = [
    (1, 1.0, "a"), (1, None, "a"), (1, 5.0, None), (1, -0.0, "B"), (1, 0.0, "a"),
    (2, None, None), (2, None, None), (None, 7.0, "c"), (2, float("nan"), "zz"), (1, 1.0, "a"),
]


def write(path, rows, group, **kw):
    t = pa.table({"load_id": pa.array([r[0] for r in rows], pa.int64()), "x": pa.array([r[1] for r in rows], pa.float64()), "s": pa.array([r[2] for r in rows], pa.string()), "name": pa.array(["clash"] * len(rows), pa.string())})
    pq.write_table(t, path, row_group_size=group, **kw)


@pytest.mark.parametrize("kw", [{}, {"write_statistics": False}, {"use_dictionary": False}])
@pytest.mark.parametrize("group", [1, 3, 100])
def test_profile_is_exact(spark, tmp_path, kw, group):
    path = str(tmp_path / "t.parquet")
    write(path, ROWS, group, **kw)
    specs = [footer_profile.ColumnSpec("x", cuts=[0.0, 2.0], distinct=True), footer_profile.ColumnSpec("s", pattern="[a-z]", keys=["a", "q"], distinct=True)]
    got = {(r.grp, r.name): r for r in footer_profile.profile_columns(spark, path, "load_id", specs).collect()}
    for g in {r[0] for r in ROWS}:
        own = [r for r in ROWS if r[0] == g]
        xs, ss = [r[1] for r in own if r[1] is not None], [r[2] for r in own if r[2] is not None]
        real = [x for x in xs if not math.isnan(x)]
        x, s = got[g, "x"], got[g, "s"]
        assert (x.n_rows, x.nulls, x.n_unique) == (len(own), len(own) - len(xs), len({repr(v + 0.0) for v in xs}))
        assert (x.low, x.high) == ((min(real), max(real)) if real else (None, None))
        assert list(x.upto) == [sum(v <= c for v in xs) for c in (0.0, 2.0)]
        assert (s.nulls, s.n_unique, s.odd, s.other) == (len(own) - len(ss), len(set(ss)), sum(len(v) != 1 or v.isupper() for v in ss), sum(v not in ("a", "q") for v in ss))
        assert list(s.per_key) == [ss.count("a"), 0]


def test_footers_rule_out_findings_of_mixed_row_groups(spark, tmp_path):
    """Nothing of a row group of two loads is decoded where its footer rules all findings out; the rest is."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    n, path = 100, f"{tmp_path}/t.parquet"
    make = lambda x, s: pa.table({"load_id": pa.array([1, 2] * (n // 2), pa.int64()), "x": pa.array(x, pa.float64()), "s": pa.array(s).dictionary_encode()})
    parts = [make([1.0 + i / n for i in range(n)], ["a"] * n), make([50.0 + i for i in range(n)], ["a", "b"] * (n // 2)), make([1.0] * (n - 1) + [None], ["?"] * n)]
    with pq.ParquetWriter(path, parts[0].schema) as w:
        for p in parts:
            w.write_table(p)
    specs = [footer_profile.ColumnSpec("x", cuts=[0.5, 10.0, 500.0], accepted=(0.0, 60.0)), footer_profile.ColumnSpec("s", pattern="[a-z]", keys=["a", "b"], distinct=True)]
    for size in (1, 1 << 20):  # a unit for each column, or one for the row group
        records = footer_profile.row_group_records(spark, path, "load_id", specs, size).where("n_rows is not null").collect()
        assert sorted((r.name, r.decoded) for r in records if r.decoded) == [("s", 1), ("x", 1), ("x", 1)] and all((r.read_bytes > 0) == (r.decoded > 0) for r in records)
    got = {(r.grp, r.name): r for r in footer_profile.profile_columns(spark, path, "load_id", specs).collect()}
    assert [got[g, "x"].upto for g in (1, 2)] == [[0, 100, 150], [0, 99, 149]] and [got[g, "x"].nulls for g in (1, 2)] == [0, 1] and got[2, "x"].high == 149.0
    assert [(r.per_key, r.other, r.odd, r.n_unique) for r in (got[1, "s"], got[2, "s"])] == [([100, 0], 50, 50, 2), ([50, 50], 50, 50, 3)]
    assert footer_profile.arrow_path("file:///a%20b/c.parquet") == (None, "/a b/c.parquet")
    fs, inner = footer_profile.arrow_path("s3a://bucket/key.parquet?region=eu-west-1")
    assert fs.type_name == "s3" and inner == "bucket/key.parquet"


def test_footers_do_without_values(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    write(path, [(1, float(i), "a") for i in range(50)] + [(2, float(i), None) for i in range(50)], 50)
    p = {(r.grp, r.name): r for r in footer_profile.profile_columns(spark, path, "load_id", [footer_profile.ColumnSpec("x"), footer_profile.ColumnSpec("s"), footer_profile.ColumnSpec("lacking")]).collect()}
    assert all(r.decoded == 0 for r in p.values()) and p[2, "s"].nulls == 50 and (p[1, "x"].low, p[1, "x"].high) == (0.0, 49.0) and p[1, "lacking"].nulls == 50
    assert quality.load_profile(spark, path, ["x"], by=None, distinct=False).first().n_rows == 100


def test_departures(spark, tmp_path):
    path, rows = str(tmp_path / "t.parquet"), [(1, float(i % 10), "a" if i % 2 else "b") for i in range(100)] + [(2, 3.0, "Q") for _ in range(40)] + [(2, None, "a")] * 10
    write(path, rows, 30)
    base = spark.createDataFrame(
        [("x", 0.0, 0.1, 0.0, 9.0, None, [(0.0, float(k), 10) for k in range(10)], None, 100), ("s", 0.0, 0.02, None, None, "[a-z]", None, {"a": 50, "b": 50}, 100)],
        "name string, missing_rate double, unique_rate double, min_val double, max_val double, value_pattern string, histogram array<struct<lo: double, hi: double, cnt: long>>, value_counts map<string, long>, row_count long",
    )
    got = {tuple(r) for r in quality.departures(spark, path, base).collect()}
    assert got == {(2, "x", "null_rate"), (2, "x", "distribution"), (2, "s", "pattern"), (2, "s", "distinct"), (2, "s", "distribution")}
    assert quality.departures(spark, path, base.limit(0)).count() == 0
    write(path, [], 1)
    assert quality.departures(spark, path, base).count() == 0


TYPES = ["int64", "float64", "bool", "date", "datetime64", "object"]
GOOD = {"int64": ["7", "-9223372036854775808", " +3 ", "007", ""], "float64": ["1", ".5", "1.", "-2e-3", " "], "bool": ["true", "FALSE"], "date": ["2024-02-29", ""], "datetime64": ["1999-12-31 23:59:59"], "object": ["é", 'a "q"', "x;y", "two\nlines", ""]}
BAD = {"int64": ["9223372036854775808", "1.0", "1 2", "٣", "+"], "float64": [".", "e5", "1e", "NaN", "1,5"], "bool": ["yes", "1"], "date": ["2023-02-29", "2024-1-01", "0000-01-01"], "datetime64": ["2024-01-01", "2024-01-01 24:00:00"], "object": []}


def quoted(v, d):
    return '"' + v.replace('"', '""') + '"' if any(c in v for c in (d, '"', "\n")) else v


def test_records(spark):
    rng, rows, want = random.Random(1), [], set()
    for n in range(2, 240):
        d = ";|,\t"[n % 4]
        kinds = ["ok", "value", "short", "quote"] if n % 2 else ["ok", "ok", "ok", "ok"]
        kind = rng.choice(kinds)
        values = [rng.choice(GOOD[t]) for t in TYPES]
        if kind == "value":
            k = rng.randrange(5)
            values[k] = rng.choice(BAD[TYPES[k]])
        cells = [quoted(v, d) if rng.random() < 0.7 or any(c in v for c in (d, '"')) else '"' + v.replace('"', '""') + '"' for v in values]
        if kind == "short":
            cells = cells[:-1]
        if kind == "quote":
            cells[rng.randrange(6)] = rng.choice(['"open', 'in"side', '"a"b', '"a" ', ' "a"', '"""', 'x""'])
        rows.append((f"f{n % 4}", n, d.join(cells)))
        if kind != "ok":
            want.add((f"f{n % 4}", n, {"value": "value", "short": "column_count", "quote": "quoting"}[kind]))
    rows += [("f0", 1, "header"), ("f0", 900, None), ("f0", 901, ""), ("f0", 902, '"\x01' + '""' * 5000 + '"' + ";" * 4), ("none", 5, "x")]
    want |= {("f0", 900, "column_count"), ("f0", 901, "column_count"), ("f0", 902, "column_count")}
    recs = spark.createDataFrame([(*r, "clash") for r in rows], "file_path string, line_no long, raw_record string, dataset_id string")
    cards = spark.createDataFrame([(i, "d", f"f{i % 4}", 5, ";|,\t"[i % 4], None) for i in range(8)], "card_id long, dataset_id string, file_path string, row_count long, delimiter string, created_at timestamp")
    cols = spark.createDataFrame([("d", i + 1, n, t) for i, (n, t) in enumerate(zip(["a", "A", "line_no", "d", "t", "o"], TYPES))], "dataset_id string, col_pos int, name string, dtype string")
    got = [tuple(r) for r in records.failures(recs, cards, cols).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    typed = records.typed_rows(recs, cards, cols, "d")
    assert typed.columns == ["file_path", "line_no", "a", "A_2", "line_no_3", "d", "t", "o"]
    assert typed.count() == 238 - (len(want) - 3) and typed.where("o = 'x;y'").count() > 0
    counts = {r.file_path: r for r in records.row_counts(recs, cards, cols).collect()}
    assert sum(r.row_count for r in counts.values()) == typed.count() and counts["f0"].claimed == 5
    assert records.failures(recs.limit(0), cards, cols).count() == 0 and records.failures(recs, cards.limit(0), cols).count() == 0


def test_every_column_of_every_load_has_its_distribution(spark):
    path = "/root/testdata/sf0.001/taxi_trips.parquet"
    df = spark.read.parquet(path)
    rows, stored = quality.load_distribution(spark, path).collect(), df.collect()
    loads = {r.load_id for r in stored}
    assert {(r.load_id, r.name) for r in rows} == {(x, c) for x in loads for c in df.columns}
    for load in loads:
        own = [r for r in stored if r.load_id == load]
        pickups = [r.pickup_ts for r in own if r.pickup_ts is not None]
        got = sorted((r for r in rows if r.load_id == load and r.name == "pickup_ts"), key=lambda r: r.bucket)
        assert (got[0].min_ts.replace(tzinfo=None), got[0].max_ts.replace(tzinfo=None)) == (min(pickups), max(pickups)) and sum(r.cnt for r in got) == len(pickups)
        fares = sorted(r.base_fare for r in own if r.base_fare is not None)
        got = sorted((r for r in rows if r.load_id == load and r.name == "base_fare"), key=lambda r: r.bucket)
        if not fares:
            assert [(r.bucket, r.missing_rate) for r in got] == [(None, 1.0)]
            continue
        assert [r.cnt for r in got] == [len(fares) // 10 + (b < len(fares) % 10) for b in range(min(10, len(fares)))]
        assert float(got[0].lo) == fares[0] and float(got[-1].hi) == fares[-1]
