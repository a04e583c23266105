"""Questions end to end over a small CSV lake: binding guards, corrections, audit, discovery."""

from __future__ import annotations

import os

import pytest

from lakelens.plans import engine as engine_module

from lakelens.plans.bind import Binding, zone
from lakelens.plans.discover import is_discovery
from lakelens.plans.engine import Engine
from lakelens.plans.route import route
from lakelens.sources.catalog import Catalog, sniff


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("lake")
    os.makedirs(root / "deep")
    (root / "wine.csv").write_text("alcohol,quality,color,made_on\n" + "".join(f"{9 + i % 30 / 10},{i % 6},{'red' if i % 3 else 'white'},20{20 + i % 4}-0{1 + i % 9}-11\n" for i in range(120)))
    (root / "deep" / "shops.csv").write_text("shop_id;city;turnover\n" + "".join(f"{i};City{i % 5};{i * 3.5}\n" for i in range(40)))
    (root / "deep" / "visits.csv").write_text("visit_id,shop_id,minutes\n" + "".join(f"{i},{i % 40},{i % 50 + 0.5}\n" for i in range(200)))
    (root / "broken.parquet").write_text("no parquet")
    return Engine(Catalog.of_lake(spark, str(root)), home=str(tmp_path_factory.mktemp("home"))).build()


def test_average(engine):
    out = engine.ask("average alcohol by quality")
    assert out["status"] == "done" and out["columns"] == ["quality", "avg_alcohol"] and out["row_count"] == 6
    assert "broken" in engine.errors and out["tokens"]["full_schema"] > out["tokens"]["used"]


def test_guard_holds_even_with_override(engine):
    engine.correct("alcohol", "color", "wine", "metric")
    out = engine.ask("average alcohol by quality", run=False)
    assert all(b["column"] != "color" for b in out["bindings"] if b["slot"] == "metric")
    engine.overrides.clear()
    out = engine.ask("average color by quality", run=False)
    assert out["status"] == "unbound" and any(b["column"] == "color" for b in out["blocked"])
    assert engine.ask("count color by quality")["status"] == "done"


def test_correction_applies(engine):
    out = engine.correct("strength", "alcohol", "wine", "metric", "average strength by color")["result"]
    assert [b["column"] for b in out["bindings"] if b["slot"] == "metric"] == ["alcohol"]
    rule = engine.overrides.active()[0]
    assert engine.overrides.remove(rule.id) and not engine.overrides.remove(rule.id)


def test_join_and_years(engine):
    out = engine.ask("average minutes by city")
    assert out["status"] == "done" and out["row_count"] == 5 and any(s["op"] == "JOIN" for s in out["plan"]["steps"])
    out = engine.ask("average alcohol by color in 2021")
    assert out["status"] == "done" and any(s["op"] == "DERIVE_TIME" for s in out["plan"]["steps"])


def test_filters_are_all_kept(engine):
    out = engine.ask("average alcohol by color where quality > 1 and quality < 4")
    assert sum(s["op"] == "FILTER" for s in out["plan"]["steps"]) == 2
    assert engine.feedback.stats()["entries"] >= 1


def test_rrf_and_edit(engine):
    out = engine.answer(engine.parse("average alcohol by quality"), run=False, method="rrf")
    assert out["status"] == "planned"
    result = engine.execute(out["plan"])
    assert result.error is None and result.row_count == 6
    assert engine.execute({"dataset_id": "wine", "steps": [{"op": "SCAN", "params": {"dataset": "nowhere"}}]}).error


def test_audit_and_reload(engine):
    key = engine.ask("average alcohol by color")["id"]
    assert engine.audit.load(key)["question"] == "average alcohol by color" and engine.audit.recent(5).count() == 5
    assert "plan:" in engine.audit.show(engine.audit.load(key))
    again = Engine(engine.catalog, engine.home).load()
    assert again.ask("average alcohol by quality")["row_count"] == 6 and again.edges == engine.edges


def test_discovery(engine):
    assert is_discovery("I want wine data to predict quality") and not is_discovery("average alcohol by quality")
    out = engine.handle("I want wine data to predict quality")
    assert out["datasets"][0]["dataset"] == "wine" and out["datasets"][0]["matches"]
    assert engine.choices(engine.parse("average alcohol"))["metrics"]


def test_nothing_fits(engine):
    assert engine.ask("")["status"] == "unbound"
    assert route(engine.parse("average alcohol"), engine.cards, "off").domain is None
    for mode in ("rule", "embedding", "auto", "plug-in"):
        route(engine.parse("average alcohol"), engine.cards, mode, lambda i, d: "nonsense")


def test_zones():
    assert zone(1.0, [1.0, 0.2]) == "accept" and zone(0.25, [1.0, 0.25]) == "reject" and zone(0.5, [1.0, 0.5]) == "uncertain" and zone(0, []) == "reject"
    assert Binding("metric", "h", "c", "d", 1.0, "accept", "int64").evidence == []


def test_paths(engine, tmp_path):
    with pytest.raises(KeyError):
        engine.catalog.resolve("/etc/passwd")
    with pytest.raises(KeyError):
        engine.catalog.resolve("../../secret")
    assert engine.catalog.resolve("wine.csv").endswith("wine.csv")
    engine.catalog.download("wine", str(tmp_path / "out"), 7)
    assert sum(1 for p in (tmp_path / "out").glob("*.csv") for _ in open(p)) == 8


def test_large_lakes_plan_alike(engine, monkeypatch, spark):
    """A lake whose index stays in Spark gives the same plans, costs and matches."""
    monkeypatch.setattr(engine_module, "LOCAL_COLUMNS", 2)
    monkeypatch.setattr(engine_module, "LOCAL_EDGES", 0)
    large = Engine(engine.catalog)
    large.profiles = engine.profiles
    large._load()
    large._take_edges(spark.createDataFrame(engine.edges)) if engine.edges else None
    assert large.columns is None and large.cards is None and large.rows == {}
    for question in ("average alcohol by quality", "average alcohol by color where alcohol > 9"):
        a, b = engine.ask(question, run=False), large.ask(question, run=False)
        assert a["plan"] == b["plan"] and a["bindings"] == b["bindings"] and a["cost"]["rows_scanned"] == b["cost"]["rows_scanned"] > 0
    task = "I want wine data to predict quality"
    assert [(d["dataset"], d["score"], d["stats"]) for d in engine.discover(task)["datasets"]] == [(d["dataset"], d["score"], d["stats"]) for d in large.discover(task)["datasets"]]


def test_feedback_without_a_second_scan(engine):
    first = engine.ask("average alcohol by color where alcohol > 11")
    assert first["status"] == "done"
    again = engine.ask("average alcohol by color where alcohol > 11", run=False)["cost"]
    known = engine.feedback.entries
    assert known and again["confidence"] == "high" and any(abs(again["selectivity"] - e["selectivity"]) < 1e-3 for e in known.values())


def test_plug_ins_and_their_cache(engine, tmp_path):
    calls = []

    def namer(column):
        calls.append(column)
        return ["vino strength"] if column == "alcohol" else 1 / 0

    home = str(tmp_path / "home")
    e = Engine(engine.catalog, home, namer=namer, encoder="idf", domains=lambda intent, names: names[0], domain_mode="plug-in").build(False)
    assert "vino strength" in next(c for c in e.columns if c.name == "alcohol").aliases and e.encode.name == "idf"
    n = len(calls)
    again = Engine(engine.catalog, home, encoder="idf").load()
    assert len(calls) == n and again.encode.idf == e.encode.idf and "vino strength" in next(c for c in again.columns if c.name == "alcohol").aliases
    assert again.index.count() == e.index.count() and again.card_table.count() == len(e.cards)
    assert e.ask("average alcohol by quality", run=False)["domain"]["method"] == "plug-in"
    near = e.similar_columns(e.cards[0].dataset_id, least=0.1).collect()
    assert all(r.dataset_id != r.query_dataset_id and r.similarity >= 0.1 for r in near)


def test_encoders():
    from lakelens.functions import similarity as s

    idf = s.fitted(["wine quality", "wine colour", "wine alcohol"])
    far = lambda e: sum(x * y for x, y in zip(e("wine quality"), e("wine colour")))
    assert far(idf) < far(s.vector) and s.encoder("hash") is s.vector and s.encoder("auto", lambda t: 1 / 0) is s.vector
    assert s.encoder("auto", lambda t: [1.0])("x") == [1.0] and s.encoder("auto", None, ["a b"]).name == "idf"
    with pytest.raises(ValueError):
        s.encoder("idf")


def test_sniffing(spark, tmp_path):
    write = lambda name, text: (tmp_path / name).write_text(text, encoding="utf-8") and str(tmp_path / name)
    late = write("late.csv", "a;b\n" + "1;2,5\n" * 3000 + '"x;y";3\n')
    assert sniff(spark, late)["sep"] == ";" and sniff(spark, late)["multiLine"] == "false" and sniff(spark, late)["header"] == "true"
    assert sniff(spark, write("open.csv", 'a,b\n' + "1,2\n" * 3000 + '"two\nlines",3\n'))["multiLine"] == "true"
    assert sniff(spark, write("bare.csv", "1\t2\n3\t4\n")) | {"header": "", "sep": ""} == sniff(spark, late) | {"header": "", "sep": ""}
    assert sniff(spark, str(tmp_path / "bare.csv"))["header"] == "false" and sniff(spark, write("empty.csv", "\n"))["sep"] == ","
    lake = Catalog.of_lake(spark, str(tmp_path))
    assert sorted(lake) == ["bare", "empty", "late", "open"] and lake.scan("late").count() == 3001 and lake.scan("open").count() == 3001
    assert sorted(Catalog.of_lake(spark, f"file://{tmp_path}")) == sorted(lake)


def test_binding_accuracy(spark):
    from conftest import DATA
    from lakelens.accuracy import measure
    from lakelens.core_queries import STAR
    from lakelens.plans.engine import engine_for_tables

    found = measure(engine_for_tables(spark, DATA, STAR, True))
    assert found["table"] >= 0.9 and found["metric"] >= 0.8 and found["dimension"] >= 0.8 and found["binding"] >= 0.75, found


def test_service(engine):
    import json
    import threading
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    from lakelens.serve import server

    service = server(engine, 0)
    threading.Thread(target=service.serve_forever, daemon=True).start()

    def call(method, path, body=None):
        data = None if body is None else json.dumps(body).encode() if isinstance(body, dict) else body
        try:
            with urlopen(Request(f"http://127.0.0.1:{service.server_port}{path}", data, method=method)) as r:
                return r.status, json.loads(r.read())
        except HTTPError as e:
            return e.code, json.loads(e.read())

    try:
        status, out = call("POST", "/ask", {"question": "average alcohol by quality"})
        assert status == 200 and out["row_count"] == 6
        assert call("POST", "/intent", {"question": "average alcohol by quality"})[1]["agg_func_hint"] == "avg"
        edited = call("POST", "/edit", {"plan": out["plan"], "index": 0})[1]
        assert edited == out["plan"] and call("POST", "/execute", {"plan": edited})[1]["row_count"] == 6
        rule = call("POST", "/correct", {"hint": "h", "column": "alcohol"})[1]["rule"]["id"]
        assert rule in [r["id"] for r in call("GET", "/overrides")[1]] and call("DELETE", f"/overrides/{rule}")[1] == {"removed": True}
        assert call("POST", "/discover", {"question": "I want wine data to predict quality"})[1]["datasets"][0]["dataset"] == "wine" and "wine" in call("GET", "/datasets")[1]
        assert call("GET", "/nope")[0] == 404 and call("POST", "/ask", {})[0] == 400 and call("POST", "/ask", b"{")[0] == 400 and call("GET", "/audits")[0] == 200
    finally:
        service.shutdown()
