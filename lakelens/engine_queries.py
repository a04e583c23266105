"""Queries of the engine's planning layers, each with what it must give, stated by hand or worked out in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.core_queries import STAR, Query, catalog, engine
from lakelens.functions import lexicon
from lakelens.functions.types import logical
from lakelens.plans import optimize as opt
from lakelens.plans.bind import zone
from lakelens.plans.discover import is_discovery
from lakelens.plans.intent import build_intent
from lakelens.plans.plan import Plan, execute
from lakelens.plans.retrieve import candidates_table
from lakelens.plans.route import by_rules
from lakelens.plans.tokens import TokenUsage, count, ddl
from lakelens.runtime import shared_dir, table
from lakelens.sources.questions import gold_parts
from lakelens.sources.stores import AuditLog, OverrideStore

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def values(columns: str, *rows: tuple) -> str:
    """SQL of a table that is stated row by row."""
    text = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS t({columns})"


def query(sql: str):
    def register(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# questions

ASKED = (
    ("average l_extendedprice by l_returnflag", "aggregate", "avg", "l_extendedprice", "l_returnflag", "", None, False),
    ("top 7 products by price", "ranking", None, "price", "products", "", 7, False),
    ("how many orders per customer in 1997", "aggregate", "count", "orders", "customer", "year = 1997", None, False),
    ("total revenue by region where quantity > 5 and discount between 0.02 and 0.05", "filter", "sum", "revenue", "region", "discount between [0.02, 0.05], quantity > 5", None, False),
    ("what are the best", "ranking", None, "", "", "", 10, True),
)


@query(values("question, intent, func, metrics, dimensions, filters, n, unclear", *ASKED))
def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule parser, its defaults and its ambiguities; of signals that weigh the same the one listed first counts."""
    rows = []
    for q, *_ in ASKED:
        i = build_intent(q)
        filters = ", ".join(sorted(f"{f.field_hint} {f.op} {f.value}" for f in i.filter_hints))
        rows.append((q, i.intent_type, i.agg_func_hint, " ".join(i.metric_hints), " ".join(i.dimension_hints), filters, i.limit_hint, i.needs_clarification))
    return local(spark, rows, "question string, intent string, func string, metrics string, dimensions string, filters string, n int, unclear boolean")


TERMS = (("sales", "revenue", True), ("cust", "customer", True), ("vendor", "supplier", True), ("temp", "temperature", True), ("zip", "postcode", True), ("abv", "alcohol", True), ("qwerty", "qwerty", False))


@query(values("term, canonical, known", *TERMS))
def synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical forms of words and abbreviations, and whether the vocabulary knows them."""
    return local(spark, [(t, lexicon.canonical(t), bool(lexicon.synonyms(t))) for t, *_ in TERMS], "term string, canonical string, known boolean")


ROUTED = (
    ("average temperature and vibration of each machine sensor", "machines"), ("gpa and gmat of admission applicants", "education"), ("charges by smoker and bmi of the policy", "insurance"),
    ("fare and distance of taxi trips by pickup vehicle", "transport"), ("alcohol and acidity of wine by quality", "food"), ("salary by department of each employee", "people"), ("xyzzy", None),
)


@query(values("question, domain", *ROUTED))
def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains of questions by rules."""
    return local(spark, [(q, by_rules(build_intent(q)).domain) for q, _ in ROUTED], "question string, domain string")


MODES = (("find me data to predict churn", True), ("I want wine data to predict quality", True), ("which datasets cover energy", True), ("average price by region", False), ("", False))


@query(values("question, discovery", *MODES))
def modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return local(spark, [(q, is_discovery(q)) for q, _ in MODES], "question string, discovery boolean")


# retrieval, binding


def _best(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    e = engine(spark, sf_dir)
    ranked = candidates_table(e.index, e.parse("average price by order status"), method)
    return ranked.where("rank = 1 AND dataset IN ('orders', 'lineitem', 'part')").select("slot", "hint", "dataset", "column")


# of each data set the column that a reader of its schema would name
BEST = (
    ("metric", "price", "lineitem", "l_extendedprice"), ("metric", "price", "orders", "o_totalprice"), ("metric", "price", "part", "p_retailprice"),
    ("dimension", "status", "lineitem", "l_linestatus"), ("dimension", "status", "orders", "o_orderstatus"),
)


@query(values('slot, hint, dataset, "column"', *BEST))
def weighted_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _best(spark, sf_dir, "weighted")
    return found.where("hint IN ('price', 'status') AND NOT (hint = 'status' AND dataset = 'part')")


@query(values('slot, hint, dataset, "column"', *BEST))
def rrf_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _best(spark, sf_dir, "rrf")
    return found.where("hint IN ('price', 'status') AND NOT (hint = 'status' AND dataset = 'part')")


BLOCKED = (
    ("average l_returnflag by l_linestatus", "metric", "l_returnflag", "lineitem", "l_returnflag", "avg needs a number, not object"),
    ("average l_tax by l_quantity", "dimension", "l_quantity", "lineitem", "l_quantity", "a numeric measure can't be grouped by"),
    ("l_returnflag by l_linestatus", "metric", "l_returnflag", "lineitem", "l_returnflag", "text can't be measured"),
)


@query(values('question, slot, hint, dataset, "column", reason', *BLOCKED))
def blocked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that are named outright and can't fill their slot, with the reason."""
    e = engine(spark, sf_dir)
    rows = [(q, c["slot"], c["hint"], c["dataset"], c["column"], c["reason"]) for q in dict.fromkeys(r[0] for r in BLOCKED) for c in e.ask(q, run=False)["blocked"] if c["hint"] == c["column"]]
    return local(spark, rows, "question string, slot string, hint string, dataset string, column string, reason string")


BOUND = (
    ("average price by return flag", "metric", "lineitem", "l_extendedprice"), ("average price by return flag", "dimension", "lineitem", "l_returnflag"),
    ("total o_totalprice by c_mktsegment", "metric", "orders", "o_totalprice"), ("total o_totalprice by c_mktsegment", "dimension", "customer", "c_mktsegment"),
    ("count event_type by user_id", "metric", "events", "event_type"), ("count event_type by user_id", "dimension", "events", "user_id"),
)


@query(values('question, slot, dataset, "column"', *BOUND))
def bound_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, True)
    rows = [(q, b.slot, b.dataset_id, b.column) for q in dict.fromkeys(r[0] for r in BOUND) for b in e.plan_for(e.parse(q))[0].entries]
    return local(spark, rows, "question string, slot string, dataset string, column string")


# worked out by the rules of zones: the bar is 0.7 of the best, raised by 0.1 for a close second, lowered by 0.05 for a far one
ZONES = (("0.9 of 1.0, 0.9", "accept"), ("0.75 of 1.0, 0.98", "uncertain"), ("0.66 of 1.0, 0.66", "accept"), ("0.2 of 1.0, 0.2", "reject"), ("0 of 0", "reject"), ("0.68 of 1.0, 0.8", "uncertain"))


@query(values("scores, zone", *ZONES))
def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for text, _ in ZONES:
        score, others = text.split(" of ")
        rows.append((text, zone(float(score), [float(x) for x in others.split(", ")])))
    return local(spark, rows, "scores string, zone string")


CORRECTED = (("before", "l_extendedprice", False), ("corrected", "l_discount", True), ("forbidden", "l_extendedprice", False), ("removed", "l_extendedprice", False))


@query(values('state, "column", noted', *CORRECTED))
def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correction moves a hint to another column of the right type, never to a forbidden one, and ends with its removal."""
    e = engine(spark, sf_dir)
    store, rows = OverrideStore(), []

    def bound(state: str) -> None:
        from lakelens.plans.bind import bind

        intent = e.parse("average price by return flag")
        before = e.overrides
        e.overrides = store
        try:
            b, _, _ = e.plan_for(intent)
        finally:
            e.overrides = before
        rows.append((state, b.of("metric")[0].column, any("corrected" in n for n in b.notes)))

    bound("before")
    rule = store.add("price", "l_discount", "lineitem", "metric")
    bound("corrected")
    store.remove(rule.id)
    rule = store.add("price", "l_returnflag", "lineitem", "metric")
    bound("forbidden")
    store.remove(rule.id)
    bound("removed")
    return local(spark, rows, "state string, column string, noted boolean")


# plans


def _edited() -> Plan:
    plan = Plan.of(
        ("SCAN", {"dataset": "orders"}), ("FILTER", {"column": "o_totalprice", "op": ">", "value": 100_000}), ("FILTER", {"column": "o_orderstatus", "op": "=", "value": "F"}),
        ("GROUPBY", {"keys": ["o_orderpriority"]}), ("AGGREGATE", {"metric": "o_totalprice", "func": "sum"}), ("LIMIT", {"n": 1}),
    )
    plan = plan.edit(1, "modify", {"value": 200_000}).edit(5).edit(2).edit(0).edit(99)
    return Plan.from_dict(plan.to_dict())


@query(values("step, op", (0, "SCAN"), (1, "FILTER"), (2, "GROUPBY"), (3, "AGGREGATE")))
def plan_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan after a change, two removals, the refused removal of its scan and an index out of range."""
    return local(spark, [(s["step"], s["op"]) for s in _edited().display()], "step int, op string")


@query("SELECT o_orderpriority, round(sum(o_totalprice), 2) AS sum_o_totalprice FROM orders WHERE o_totalprice > 200000 GROUP BY 1")
def execute_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = execute(_edited(), catalog(spark, sf_dir))
    return spark.createDataFrame([tuple(r) for r in out.rows], out.df.schema).withColumn("sum_o_totalprice", F.round("sum_o_totalprice", 2))


@query("SELECT 'ZERO' AS state, 0 AS n_rows, false AS failed UNION ALL SELECT 'CAPPED', 500, false UNION ALL SELECT 'BROKEN', 0, true")
def execute_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results at the edge: none, more than the cap, and an error that is given back instead of raised."""
    lake = catalog(spark, sf_dir)
    none = Plan.of(("SCAN", {"dataset": "orders"}), ("FILTER", {"column": "o_totalprice", "op": "<", "value": 0}))
    many, broken = Plan.of(("SCAN", {"dataset": "lineitem"})), Plan.of(("SCAN", {"dataset": "orders"}), ("AGGREGATE", {"metric": "o_totalprice", "func": "nonsense"}))
    rows = [(name, r.row_count, r.error is not None) for name, r in (("ZERO", execute(none, lake)), ("CAPPED", execute(many, lake)), ("BROKEN", execute(broken, lake)))]
    return local(spark, rows, "state string, n_rows int, failed boolean")


TESTS = [("l_quantity", ">", 30), ("l_quantity", "between", [10, 20]), ("l_returnflag", "=", "R"), ("l_discount", "<", 0.05), ("l_shipdate", ">", "1998-01-01"), ("l_linestatus", "!=", "F")]
_REAL = {
    "l_quantity > 30": "l_quantity > 30", "l_quantity between [10, 20]": "l_quantity BETWEEN 10 AND 20", "l_returnflag = R": "l_returnflag = 'R'", "l_discount < 0.05": "l_discount < 0.05",
    "l_shipdate > 1998-01-01": "l_shipdate > TIMESTAMP '1998-01-01'", "l_linestatus != F": "l_linestatus <> 'F'",
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS predicate, round(count(*) FILTER (WHERE {v}) / count(*), 4) AS real, true AS near FROM lineitem" for k, v in _REAL.items()))
def selectivity_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real shares of predicates, all observed in one pass, and whether the estimate is near (0.06) or a probe made it so (0.1)."""
    e = engine(spark, sf_dir)
    p = e.rows["lineitem"]
    df, seen = opt.observed_filters(table(spark, sf_dir, "lineitem"), [{"column": c, "op": o, "value": v} for c, o, v in TESTS])
    df.write.format("noop").mode("overwrite").save()
    rows = []
    for i, (c, o, v) in enumerate(TESTS):
        guess, sure = opt.selectivity(p.get(c), o, v)
        real = seen.get[f"f{i}"] / max(1, seen.get["rows"])
        if sure == "low":
            some, part = e.catalog.sample("lineitem")
            guess = opt.probe(some, c, o, v, int(seen.get["rows"] * part))
        rows.append((f"{c} {o} {v}", round(real, 4), abs(guess - real) <= (0.1 if sure == "low" else 0.06)))
    return local(spark, rows, "predicate string, real double, near boolean")


_COST = "round(greatest(0, least(n / 10000, 30) + {sort} + least(g / 100, 20) + {scan} - 5), 2) AS score, {out} AS rows_out, '{rewrites}' AS rewrites FROM (SELECT count(*) AS n, count(DISTINCT {key}) AS g FROM {table})"


@query(
    "SELECT 'average l_extendedprice by l_returnflag' AS question, " + _COST.format(sort=0, scan=20, out="g", rewrites="reads 2 of 11 columns", key="l_returnflag", table="lineitem")
    + " UNION ALL SELECT 'top 5 c_mktsegment by c_acctbal', " + _COST.format(sort=15, scan=20, out="least(g, 5)", rewrites="top-5 without a full sort; reads 2 of 5 columns", key="c_mktsegment", table="customer")
    + " UNION ALL SELECT 'average l_extendedprice by l_returnflag where l_linestatus = F', " + _COST.format(sort=0, scan=0, out="g", rewrites="reads 3 of 11 columns", key="l_returnflag", table="lineitem")
)
def plan_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cost score by its terms: rows, order, groups, full scan, pruned columns."""
    e = engine(spark, sf_dir)
    questions = ("average l_extendedprice by l_returnflag", "top 5 c_mktsegment by c_acctbal", "average l_extendedprice by l_returnflag where l_linestatus = F")
    rows = []
    for q in questions:
        out = e.ask(q, run=False)
        rows.append((q, float(out["cost"]["score"]), out["cost"]["rows_out"], "; ".join(out["rewrites"])))
    return local(spark, rows, "question string, score double, rows_out long, rewrites string")


@query("SELECT 'before' AS state, 'high' AS confidence, NULL::DOUBLE AS selectivity UNION ALL SELECT 'after', 'high', round(count(*) FILTER (WHERE l_quantity > 30) / count(*), 4) FROM lineitem")
def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a question really kept replaces the estimate of the next one."""
    e = engine(spark, sf_dir)
    kept, e.feedback = e.feedback, opt.FeedbackCache()
    try:
        q = "average l_extendedprice by l_returnflag where l_quantity > 30"
        rows = [("before", e.ask(q)["cost"]["confidence"], None)]
        after = e.ask(q, run=False)["cost"]
        rows.append(("after", after["confidence"], after["selectivity"]))
    finally:
        e.feedback = kept
    return local(spark, rows, "state string, confidence string, selectivity double")


# discovery, catalog, stores

FOUND = ((1, "customer", "c_acctbal"), (2, "supplier", "s_acctbal"))


@query(values('rank, dataset, "column"', *FOUND))
def dataset_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two data sets that have an account balance come first, with that column."""
    found = engine(spark, sf_dir).discover("I want customer data to predict acctbal")["datasets"]
    rows = [(i, d["dataset"], next(m["column"] for m in d["matches"] if m["desired"] == "acctbal")) for i, d in enumerate(found[:2], 1)]
    return local(spark, rows, "rank int, dataset string, column string")


_LAKE = [*STAR, "taxi_trips", "sensor_readings", "order_items"]


@query(
    f"""SELECT table_name AS dataset, column_name AS "column", CASE WHEN data_type IN ('BIGINT', 'INTEGER', 'SMALLINT', 'TINYINT') THEN 'int64' WHEN data_type IN ('DOUBLE', 'FLOAT') OR data_type LIKE 'DECIMAL%' THEN 'float64'
        WHEN data_type = 'VARCHAR' THEN 'object' WHEN data_type = 'BOOLEAN' THEN 'bool' WHEN data_type LIKE 'TIMESTAMP%' OR data_type = 'DATE' THEN 'datetime64' ELSE 'nested' END AS dtype
        FROM information_schema.columns WHERE table_name IN ({', '.join(repr(t) for t in _LAKE)})"""
)
def catalog_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logical type of every column of the lake."""
    c = catalog(spark, sf_dir)
    return local(spark, [(d, f.name, logical(f.dataType)) for d in c for f in c.scan(d).schema.fields], "dataset string, column string, dtype string")


LOGGED = (("average l_extendedprice by l_returnflag", "planned", "average l_extendedprice by l_returnflag"), ("maximum o_totalprice by o_orderpriority", "planned", "maximum o_totalprice by o_orderpriority"))


@query(values("question, status, loaded", *LOGGED))
def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit records after they were stored: listed, and loaded one by one."""
    log = AuditLog(spark, f"{shared_dir(spark)}/lakelens/audit-{uuid.uuid4().hex}")
    e = engine(spark, sf_dir)
    for q, *_ in LOGGED:
        log.save({k: v for k, v in e.ask(q, run=False).items() if k != "id"})
    rows = [(r.question, r.status, log.load(r.id)["question"]) for r in log.recent().collect()]
    return local(spark, rows, "question string, status string, loaded string")


GOLD = (
    ("SELECT T1.name, count(*) FROM customers AS T1 INNER JOIN orders AS T2 ON T1.id = T2.cust_id WHERE T2.total > 5 GROUP BY T1.name", "customers orders", "cust_id id name total"),
    ("SELECT `Free Meal` FROM schools WHERE city = 'Fresno'", "schools", "Free Meal city"),
    ("SELECT a FROM t WHERE b IN (SELECT c FROM u)", "t u", "a b c"),
)


@query(values("sql, tables, columns", *GOLD))
def gold_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables and columns of reference answers, by Spark's own parser."""
    rows = []
    for sql, *_ in GOLD:
        tables, columns = gold_parts(spark, sql)
        rows.append((sql, " ".join(sorted(tables)), " ".join(sorted(columns))))
    return local(spark, rows, "sql string, tables string, columns string")


@query(values("measure, ok", ("full is ddl, question and overhead", True), ("pruned is smaller", True), ("saved share", True)))
def token_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt sizes of a question: with the whole schema, with the chosen data sets, and as used."""
    e = engine(spark, sf_dir)
    q = "average l_extendedprice by l_returnflag"
    usage = TokenUsage()
    usage.add("question", q)
    columns = [{"dataset_id": d, "name": n, "dtype": p["dtype"]} for d, cs in e.rows.items() for n, p in cs.items()]
    r = usage.report(q, columns, ["lineitem"])
    rows = [("full is ddl, question and overhead", r["full_schema"] == count(ddl(columns)) + count(q) + 550), ("pruned is smaller", r["pruned_schema"] < r["full_schema"]), ("saved share", r["saved_share"] == round(1 - r["used"] / r["full_schema"], 4))]
    return local(spark, rows, "measure string, ok boolean")
