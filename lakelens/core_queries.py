"""Queries for every operator of the engine and their SQL; all run over whole tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.functions.similarity import cosine
from lakelens.functions.types import name_parts
from lakelens.operators import joins, vectors
from lakelens.operators import profile as prof
from lakelens.plans.engine import Engine, engine_for_tables
from lakelens.plans.plan import Plan, compile_plan, execute
from lakelens.runtime import shared_dir, table
from lakelens.sources.catalog import Catalog
from lakelens.streaming.ingest import windowed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

STAR = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog(spark, {t: f"{sf_dir}/{t}.parquet" for t in [*STAR, "taxi_trips", "sensor_readings", "order_items"]})


def tidy(df: DataFrame, digits: int = 2) -> DataFrame:
    """Doubles rounded, so that the order of partial sums doesn't show; dates as text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.simpleString()
        out.append((F.round(c, digits) if kind == "double" else F.date_format(c, "yyyy-MM-dd HH:mm:ss") if kind.startswith("timestamp") else c).alias(f.name))
    return df.select(*out)


def planned(name: str, sql: str, *steps: tuple[str, dict], digits: int = 2) -> None:
    """Register a plan and the SQL that must give the same rows."""
    plan = Plan.of(*steps)
    QUERIES[name] = lambda spark, sf_dir: tidy(compile_plan(plan, catalog(spark, sf_dir)), digits)
    ORACLES[name] = sql


def scan(t: str) -> tuple[str, dict]:
    return ("SCAN", {"dataset": t})


def where(column: str, op: str, value=None) -> tuple[str, dict]:
    return ("FILTER", {"column": column, "op": op, "value": value})


def agg(metric: str, func: str) -> tuple[str, dict]:
    return ("AGGREGATE", {"metric": metric, "func": func})


def group(*keys: str) -> tuple[str, dict]:
    return ("GROUPBY", {"keys": list(keys)})


def select(*columns: str) -> tuple[str, dict]:
    return ("SELECT", {"columns": list(columns)})


def join(right: str, left_key: str, right_key: str, how: str = "LEFT") -> tuple[str, dict]:
    return ("JOIN", {"right_dataset": right, "left_key": left_key, "right_key": right_key, "join_type": how})


ORDER = select("o_orderkey", "o_custkey", "o_totalprice")
ORDER_SQL = "SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice FROM orders"
planned("scan_project", ORDER_SQL, scan("orders"), ORDER)
planned("select_distinct_keys", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", scan("orders"), group("o_orderstatus", "o_orderpriority"), select("o_orderstatus", "o_orderpriority"))
planned("filter_eq", f"{ORDER_SQL} WHERE o_orderstatus = 'F'", scan("orders"), where("o_orderstatus", "=", "F"), ORDER)
planned("filter_ne", f"{ORDER_SQL} WHERE o_orderstatus <> 'F'", scan("orders"), where("o_orderstatus", "!=", "F"), ORDER)
planned("filter_gt", f"{ORDER_SQL} WHERE o_totalprice > 250000", scan("orders"), where("o_totalprice", ">", "250000"), ORDER)
planned("filter_lt", f"{ORDER_SQL} WHERE o_totalprice < 50000", scan("orders"), where("o_totalprice", "<", 50000), ORDER)
planned("filter_ge_le_range", f"{ORDER_SQL} WHERE o_totalprice >= 100000 AND o_totalprice <= 150000", scan("orders"), where("o_totalprice", ">=", 100000), where("o_totalprice", "<=", 150000), ORDER)
planned("filter_like", f"{ORDER_SQL} WHERE o_orderpriority LIKE '%URG%'", scan("orders"), where("o_orderpriority", "LIKE", "%URG%"), ORDER)
planned("filter_in_list", f"{ORDER_SQL} WHERE o_orderstatus IN ('F', 'P')", scan("orders"), where("o_orderstatus", "IN", ["F", "P"]), ORDER)
planned("filter_not_in_list", f"{ORDER_SQL} WHERE o_orderstatus NOT IN ('F', 'P')", scan("orders"), where("o_orderstatus", "NOT IN", ["F", "P"]), ORDER)
planned("filter_between", f"{ORDER_SQL} WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'", scan("orders"), where("o_orderdate", "between", ["1996-01-01", "1996-12-31"]), ORDER)
TRIP_SQL = "SELECT trip_id, load_id, round(trip_price, 2) AS trip_price FROM taxi_trips"
TRIP = select("trip_id", "load_id", "trip_price")
planned("filter_is_null", f"{TRIP_SQL} WHERE weather IS NULL", scan("taxi_trips"), where("weather", "IS", None), TRIP)
planned("filter_is_not_null", f"{TRIP_SQL} WHERE weather IS NOT NULL", scan("taxi_trips"), where("weather", "IS NOT", None), TRIP)
planned("filter_conjunction", f"{ORDER_SQL} WHERE o_orderstatus = 'O' AND o_totalprice > 100000 AND o_orderpriority <> '5-LOW'", scan("orders"), where("o_orderstatus", "=", "O"), where("o_totalprice", ">", 100000), where("o_orderpriority", "!=", "5-LOW"), ORDER)

planned("derive_year_filter", f"{ORDER_SQL} WHERE year(o_orderdate) = 1997", scan("orders"), ("DERIVE_TIME", {"source": "o_orderdate", "target": "y", "unit": "year"}), where("y", "=", 1997), ORDER)
for unit in ("month", "quarter"):
    planned(
        f"derive_{unit}_group", f"SELECT {unit}(o_orderdate)::INTEGER AS u, round(sum(o_totalprice), 2) AS sum_o_totalprice FROM orders GROUP BY 1",
        scan("orders"), ("DERIVE_TIME", {"source": "o_orderdate", "target": "u", "unit": unit}), group("u"), agg("o_totalprice", "sum"),
    )
planned("derive_text", "SELECT p_size::VARCHAR AS size_text, count(p_partkey) AS count_p_partkey FROM part GROUP BY 1", scan("part"), ("DERIVE_TIME", {"source": "p_size", "target": "size_text", "unit": "text"}), group("size_text"), agg("p_partkey", "count"))

for func, expr in {
    "sum": "round(sum({c}), 2)", "avg": "round(avg({c}), 2)", "count": "count({c})", "min": "round(min({c}), 2)", "max": "round(max({c}), 2)",
    "median": "round(median({c}), 2)", "count_distinct": "count(DISTINCT {c})",
}.items():
    planned(f"agg_{func}", f"SELECT load_id, {expr.format(c='trip_price')} AS {func}_trip_price FROM taxi_trips GROUP BY 1", scan("taxi_trips"), group("load_id"), agg("trip_price", func))
planned("agg_global", "SELECT round(sum(l_extendedprice), 2) AS sum_l_extendedprice, count(l_orderkey) AS count_l_orderkey FROM lineitem", scan("lineitem"), agg("l_extendedprice", "sum"), agg("l_orderkey", "count"))
planned(
    "agg_multi_metric", "SELECT l_returnflag, round(sum(l_quantity), 2) AS sum_l_quantity, round(avg(l_discount), 2) AS avg_l_discount, max(l_shipdate)::VARCHAR AS max_l_shipdate FROM lineitem GROUP BY 1",
    scan("lineitem"), group("l_returnflag"), agg("l_quantity", "sum"), agg("l_discount", "avg"), agg("l_shipdate", "max"),
)
planned("agg_multi_key", "SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 2) AS avg_l_extendedprice FROM lineitem GROUP BY 1, 2", scan("lineitem"), group("l_returnflag", "l_linestatus"), agg("l_extendedprice", "avg"))
planned("agg_null_group", "SELECT weather, count(trip_id) AS count_trip_id FROM taxi_trips GROUP BY 1", scan("taxi_trips"), group("weather"), agg("trip_id", "count"))

for how, sql in {"left": "LEFT", "right": "RIGHT", "inner": "INNER", "full": "FULL"}.items():
    planned(
        f"join_{how}", f"SELECT c_custkey, c_name, o_orderkey FROM customer {sql} JOIN (SELECT * FROM orders) o ON c_custkey = o_custkey",
        scan("customer"), join("orders", "c_custkey", "o_custkey", how), select("c_custkey", "c_name", "o_orderkey"),
    )
planned("join_cross", "SELECT a.r_name AS r_name, n_name FROM region a CROSS JOIN nation", scan("region"), join("nation", "", "", "CROSS"), select("r_name", "n_name"))
planned(
    "join_star", "SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
    scan("orders"), join("customer", "o_custkey", "c_custkey"), join("nation", "c_nationkey", "n_nationkey"), join("region", "n_regionkey", "r_regionkey"),
    select("o_orderkey", "customer.c_name", "n_name", "region.r_name"),
)
planned(
    "join_group_agg", "SELECT n_name, round(sum(o_totalprice), 2) AS sum_o_totalprice FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    scan("orders"), join("customer", "o_custkey", "c_custkey"), join("nation", "c_nationkey", "n_nationkey"), group("n_name"), agg("o_totalprice", "sum"),
)
planned("sort_asc_nulls_last", "SELECT weather, count(trip_id) AS count_trip_id FROM taxi_trips GROUP BY 1 ORDER BY weather ASC NULLS LAST", scan("taxi_trips"), group("weather"), agg("trip_id", "count"), ("SORT", {"column": "weather", "order": "asc"}))
planned(
    "topk_by_agg", "SELECT l_suppkey, round(sum(l_extendedprice), 2) AS sum_l_extendedprice FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    scan("lineitem"), group("l_suppkey"), agg("l_extendedprice", "sum"), ("SORT", {"column": "l_extendedprice", "order": "desc"}), ("LIMIT", {"n": 10}),
)
BIG_LIMIT = (
    scan("orders"), group("o_custkey"), agg("o_orderkey", "count"), ("SORT", {"column": "o_orderkey", "order": "desc"}), ("LIMIT", {"n": 800}),
)
_BIG_LIMIT = "SELECT o_custkey, count(o_orderkey) AS count_o_orderkey FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT "
planned("limit_uncapped", _BIG_LIMIT + "800", *BIG_LIMIT)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


@query("limit_capped", _BIG_LIMIT + "500")
def limit_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same plan at the edge, where at most 500 rows are given out."""
    out = execute(Plan.of(*BIG_LIMIT), catalog(spark, sf_dir))
    return spark.createDataFrame([tuple(r) for r in out.rows], out.df.schema)


@query("scan_csv_roundtrip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV lake of one data set, read through the recursive locator with sniffed options and a stored schema."""
    root = f"{shared_dir(spark)}/lakelens/csv-{uuid.uuid4().hex}"
    table(spark, sf_dir, "nation").coalesce(1).write.options(header="true", sep=";").csv(f"{root}/deep/nation.csv")  # 25 rows
    return compile_plan(Plan.of(scan("nation")), Catalog.of_lake(spark, root))


# profiles

PROFILED = ["trip_distance", "base_fare", "trip_price", "weather", "traffic_conditions", "day_of_week", "vehicle_code"]
_TEXTS = ", ".join(f"{c}::VARCHAR AS {c}" for c in PROFILED)
_LONG = f"(SELECT {_TEXTS} FROM taxi_trips) UNPIVOT INCLUDE NULLS (v FOR name IN ({', '.join(PROFILED)}))"


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "taxi_trips").select(*PROFILED)


def trip_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prof.profile(trips(spark, sf_dir), "taxi_trips")


@query(
    "profile_missing_unique",
    f"""SELECT 'taxi_trips' AS dataset_id, name, count(*) AS n_rows, round(1 - count(v) / count(*), 4) AS missing_rate,
        count(DISTINCT CASE WHEN v = '-0.0' THEN '0.0' ELSE v END) AS n_unique,
        round(count(DISTINCT CASE WHEN v = '-0.0' THEN '0.0' ELSE v END) / count(*), 4) AS unique_rate FROM {_LONG} GROUP BY name""",
)
def profile_missing_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trip_profile(spark, sf_dir).select("dataset_id", "name", "n_rows", "missing_rate", "n_unique", "unique_rate")


@query("profile_min_max_mean", " UNION ALL ".join(f"SELECT '{c}' AS name, min({c}) AS min_val, max({c}) AS max_val, round(avg({c}), 3) AS mean_val FROM taxi_trips" for c in PROFILED[:3]))
def profile_min_max_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = trip_profile(spark, sf_dir).where(F.col("name").isin(PROFILED[:3]))
    return p.select("name", "min_val", "max_val", F.round("mean_val", 3).alias("mean_val"))


@query(
    "profile_top_values",
    f"""WITH c AS (SELECT name, CASE WHEN v = '-0.0' THEN '0.0' ELSE v END AS v, count(*) AS cnt FROM {_LONG} WHERE v IS NOT NULL GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY cnt DESC, v)::INTEGER AS rank FROM c)
        SELECT name, rank, v AS value FROM r WHERE rank <= 5""",
)
def profile_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trip_profile(spark, sf_dir).select("name", F.posexplode("top_values").alias("p", "value")).select("name", (F.col("p") + 1).alias("rank"), "value")


@query(
    "profile_samples",
    f"""WITH c AS (SELECT DISTINCT name, CASE WHEN v = '-0.0' THEN '0.0' ELSE v END AS v FROM {_LONG} WHERE v IS NOT NULL),
        r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY v) AS k FROM c) SELECT name, v AS value FROM r WHERE k <= 8""",
)
def profile_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trip_profile(spark, sf_dir).select("name", F.explode("sample_values").alias("value"))


@query(
    "profile_value_counts",
    "SELECT name, v AS value, count(*) AS cnt FROM (SELECT weather, traffic_conditions, day_of_week FROM taxi_trips) UNPIVOT (v FOR name IN (weather, traffic_conditions, day_of_week)) GROUP BY 1, 2",
)
def profile_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = trip_profile(spark, sf_dir).where("value_counts is not null and name in ('weather', 'traffic_conditions', 'day_of_week')")
    return few.select("name", F.explode("value_counts").alias("value", "cnt"))


@query(
    "profile_histogram",
    """WITH v AS (SELECT name, x FROM (SELECT trip_distance, base_fare, trip_price FROM taxi_trips) UNPIVOT (x FOR name IN (trip_distance, base_fare, trip_price))),
        t AS (SELECT name, x, ntile(10) OVER (PARTITION BY name ORDER BY x) AS bucket FROM v)
        SELECT name, bucket::INTEGER AS bucket, min(x) AS lo, max(x) AS hi, count(*) AS cnt FROM t GROUP BY 1, 2""",
)
def profile_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = trip_profile(spark, sf_dir).where(F.col("name").isin(PROFILED[:3]))
    return p.select("name", F.posexplode("histogram").alias("k", "h")).select("name", (F.col("k") + 1).alias("bucket"), "h.lo", "h.hi", "h.cnt")


def _role_sql() -> str:
    """The role rules in SQL over counted distinct values, for orders and lineitem."""
    kinds = {
        "orders": "o_orderkey:int64 o_custkey:int64 o_orderstatus:object o_totalprice:float64 o_orderdate:datetime64 o_orderpriority:object",
        "events": "event_id:int64 ts:datetime64 user_id:int64 event_type:object value:float64 props:object",
        "nation": "n_nationkey:int64 n_name:object n_regionkey:int64",
    }
    parts = []
    for t, cols in kinds.items():
        for c, dtype in (x.split(":") for x in cols.split()):
            n, u = f"count(DISTINCT {c})", f"(count(DISTINCT {c}) / count(*))"
            words = set(name_parts(c))
            if dtype == "datetime64" or words & {"date"}:
                role = "'TIME'"
            elif words & {"id"}:
                role = "'IDENTIFIER'"
            elif dtype in ("int64", "float64"):
                role = f"CASE WHEN {u} > 0.5 AND {n} > 20 THEN 'MEASURE' WHEN {n} <= 20 THEN 'DIMENSION' ELSE 'MEASURE' END"
            else:
                role = f"CASE WHEN {u} > 0.8 AND {n} > 100 THEN 'TEXT' ELSE 'DIMENSION' END"
            parts.append(f"SELECT '{t}' AS dataset_id, '{c}' AS name, '{dtype}' AS dtype, {role} AS inferred_role, {str('name' in words).lower()} AS pii_risk FROM {t} HAVING count(*) >= 0")
    return " UNION ALL ".join(parts)


@query("profile_roles", _role_sql())
def profile_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: table(spark, sf_dir, t) for t in ("orders", "events", "nation")}
    return prof.profile_many(tables).select("dataset_id", "name", "dtype", "inferred_role", "pii_risk")


# join discovery and vectors

# every column of the lake that the roles make a key or a dimension
KEYS = {
    "nation": ["n_nationkey", "n_name", "n_regionkey"], "region": ["r_regionkey", "r_name"], "customer": ["c_custkey", "c_nationkey", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_nationkey", "s_name"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_tax", "l_returnflag", "l_linestatus"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type"], "events": ["event_id", "user_id", "event_type", "props"],
}
_SETS = " UNION ALL ".join(f"SELECT DISTINCT '{t}' AS d, '{c}' AS c, {c}::VARCHAR AS v FROM {t} WHERE {c} IS NOT NULL" for t, cs in KEYS.items() for c in cs)


def key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.column_values({t: table(spark, sf_dir, t) for t in KEYS}, KEYS)


@query(
    "join_overlap_exact",
    f"""WITH s AS ({_SETS}), n AS (SELECT d, c, count(*) AS n FROM s GROUP BY 1, 2),
        p AS (SELECT a.d AS ld, a.c AS lc, b.d AS rd, b.c AS rc, count(*) AS shared FROM s a JOIN s b ON a.v = b.v AND (a.d < b.d) GROUP BY 1, 2, 3, 4)
        SELECT ld AS left_dataset, lc AS left_column, rd AS right_dataset, rc AS right_column, round(shared / least(x.n, y.n), 4) AS overlap_ratio,
            x.n AS left_distinct, y.n AS right_distinct, shared AS intersection_size
        FROM p JOIN n x ON x.d = ld AND x.c = lc JOIN n y ON y.d = rd AND y.c = rc WHERE shared / least(x.n, y.n) >= 0.5""",
)
def join_overlap_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.overlap_edges(key_values(spark, sf_dir)).drop("samples", "evidence")


_SHARED = f"""WITH s AS ({_SETS}), n AS (SELECT d, c, count(*) AS n FROM s GROUP BY 1, 2),
    p AS (SELECT a.d AS ld, a.c AS lc, b.d AS rd, b.c AS rc, count(*) AS shared FROM s a JOIN s b ON a.v = b.v AND a.d <> b.d GROUP BY 1, 2, 3, 4),
    e AS (SELECT p.*, x.n AS ln, y.n AS rn, shared / least(x.n, y.n) AS ratio, shared / (x.n + y.n - shared) AS jaccard
          FROM p JOIN n x ON x.d = ld AND x.c = lc JOIN n y ON y.d = rd AND y.c = rc)"""


@query(
    "join_best_partners",
    _SHARED + """, r AS (SELECT *, row_number() OVER (PARTITION BY lc ORDER BY round(ratio, 4) DESC, levenshtein(lc, rc), rn DESC, rd, rc)::INTEGER AS rank FROM e WHERE ld = 'orders' AND ratio >= 0.5)
        SELECT lc AS left_column, rd AS right_dataset, rc AS right_column, round(ratio, 4) AS overlap_ratio, rank FROM r WHERE rank <= 5""",
)
def join_best_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each key of orders the five best partners."""
    best = joins.joinable(joins.overlap_edges(key_values(spark, sf_dir)), "orders", top_k=5)
    return best.select("left_column", "right_dataset", "right_column", "overlap_ratio", "rank")


@query("join_index_stats", f"WITH s AS ({_SETS}) SELECT d AS dataset, c AS \"column\", count(*) AS n_distinct FROM s GROUP BY 1, 2")
def join_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.index_stats(key_values(spark, sf_dir))


def _pair_similarity(values: DataFrame) -> DataFrame:
    """(left_*, right_*, jaccard): the exact Jaccard similarity of columns that share a value, from exact overlaps."""
    edges = joins.overlap_edges(values, 0.0)
    both, either = F.col("intersection_size"), F.col("left_distinct") + F.col("right_distinct") - F.col("intersection_size")
    return edges.select("left_dataset", "left_column", "right_dataset", "right_column", (both / either).alias("jaccard"))


@query("minhash_signature", _SHARED + " SELECT ld AS left_dataset, lc AS left_column, rd AS right_dataset, rc AS right_column, round(jaccard, 4) AS jaccard, true AS near FROM e WHERE ld < rd")
def minhash_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures against exact similarities: ``near`` where the estimate lies within four standard errors."""
    values = key_values(spark, sf_dir)
    signed = joins.minhash(values)
    a = signed.select(F.col("dataset").alias("left_dataset"), F.col("column").alias("left_column"), F.col("signature").alias("s"))
    b = signed.select(F.col("dataset").alias("right_dataset"), F.col("column").alias("right_column"), F.col("signature").alias("t"))
    pairs = _pair_similarity(values).join(a, ["left_dataset", "left_column"]).join(b, ["right_dataset", "right_column"])
    error = F.sqrt(F.col("jaccard") * (1 - F.col("jaccard")) / joins.HASHES)
    near = F.abs(joins.jaccard("s", "t") - F.col("jaccard")) <= 4 * error + 1 / joins.HASHES
    return pairs.select("left_dataset", "left_column", "right_dataset", "right_column", F.round("jaccard", 4).alias("jaccard"), near.alias("near"))


@query("lsh_candidates", _SHARED + " SELECT ld AS left_dataset, lc AS left_column, rd AS right_dataset, rc AS right_column, round(jaccard, 4) AS jaccard FROM e WHERE ld < rd AND jaccard >= 0.9")
def lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of banding whose exact similarity is 0.9 or more; banding misses one of these in 10,000."""
    values = key_values(spark, sf_dir)
    found = joins.lsh_pairs(joins.minhash(values)).drop("jaccard")
    exact = _pair_similarity(values).where("jaccard >= 0.9")
    return exact.join(found, ["left_dataset", "left_column", "right_dataset", "right_column"], "left_semi").withColumn("jaccard", F.round("jaccard", 4))


@query(
    "similar_of_others",
    """WITH q AS (SELECT vec_id AS qi, label AS ql, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 100 = 0),
        s AS (SELECT qi, vec_id, list_cosine_similarity(qv, embedding::DOUBLE[]) AS sim FROM q JOIN embeddings ON ql <> label),
        r AS (SELECT *, row_number() OVER (PARTITION BY qi ORDER BY sim DESC, vec_id)::INTEGER AS rank FROM s WHERE sim >= 0.05)
        SELECT qi AS query_vec_id, vec_id, round(sim, 4) AS similarity, rank FROM r WHERE rank <= 10""",
)
def similar_of_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every row whose id is divisible by 100 the ten nearest rows of other groups, as columns of other data sets are found."""
    rows = table(spark, sf_dir, "embeddings")
    return vectors.similar_of_others(rows, rows.where("vec_id % 100 = 0"), ["vec_id"], "label", "embedding", 10, 0.05).withColumn("similarity", F.round("similarity", 4))


@query(
    "semantic_topk",
    """WITH q AS (SELECT vec_id AS qi, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 100 = 0),
        s AS (SELECT qi, vec_id, list_cosine_similarity(qv, embedding::DOUBLE[]) AS sim FROM q JOIN embeddings ON qi <> vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY qi ORDER BY sim DESC, vec_id)::INTEGER AS rank FROM s WHERE sim >= 0.1)
        SELECT qi AS query_id, vec_id AS id, round(sim, 4) AS similarity, rank FROM r WHERE rank <= 10""",
)
def semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of every row whose id is divisible by 100, against all rows."""
    rows = table(spark, sf_dir, "embeddings")
    return vectors.nearest(rows, rows.where("vec_id % 100 = 0"), "vec_id", "embedding", 10, 0.1).withColumn("similarity", F.round("similarity", 4))


@query(
    "cosine_pairs",
    """SELECT a.vec_id AS vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS similarity
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with its successor."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(after, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 4).alias("similarity"))


# questions

_engines: dict[tuple[str, str], Engine] = {}


def engine(spark: SparkSession, sf_dir: str, with_joins: bool = False) -> Engine:
    """The engine over the tables of a folder, built once for a session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _engines:
        _engines[key] = engine_for_tables(spark, sf_dir, STAR)
    if with_joins and not _engines[key].edges:
        _engines[key].build_joins()
    return _engines[key]


def asked(name: str, question: str, sql: str | None, with_joins: bool = False) -> None:
    QUERIES[name] = lambda spark, sf_dir: tidy(engine(spark, sf_dir, with_joins).frame(question))
    if sql:
        ORACLES[name] = sql


asked("nl_avg_by", "average l_extendedprice by l_returnflag", "SELECT l_returnflag, round(avg(l_extendedprice), 2) AS avg_l_extendedprice FROM lineitem GROUP BY 1")
asked("nl_total_by", "total l_quantity by l_linestatus", "SELECT l_linestatus, round(sum(l_quantity), 2) AS sum_l_quantity FROM lineitem GROUP BY 1")
asked("nl_max_by", "maximum o_totalprice by o_orderpriority", "SELECT o_orderpriority, round(max(o_totalprice), 2) AS max_o_totalprice FROM orders GROUP BY 1")
asked("nl_top_n", "top 3 c_mktsegment by c_acctbal", "SELECT c_mktsegment, round(sum(c_acctbal), 2) AS sum_c_acctbal FROM customer GROUP BY 1 ORDER BY sum(c_acctbal) DESC, 1 LIMIT 3")
asked("nl_count_text", "count event_type by user_id", "SELECT user_id, count(event_type) AS count_event_type FROM events GROUP BY 1")
asked("nl_filter_gt", "average l_extendedprice by l_returnflag where l_quantity > 30", "SELECT l_returnflag, round(avg(l_extendedprice), 2) AS avg_l_extendedprice FROM lineitem WHERE l_quantity > 30 GROUP BY 1")
asked("nl_filter_range", "total l_extendedprice by l_returnflag where l_discount between 0.02 and 0.05", "SELECT l_returnflag, round(sum(l_extendedprice), 2) AS sum_l_extendedprice FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.05 GROUP BY 1")
asked("nl_year_filter", "total o_totalprice by o_orderstatus in 1997", "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS sum_o_totalprice FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1")
asked("nl_value_of_events", "average value of events by event_type", "SELECT event_type, round(avg(value), 2) AS avg_value FROM events GROUP BY 1")
asked("nl_cross_dataset", "total o_totalprice by c_mktsegment", "SELECT c_mktsegment, round(sum(o_totalprice), 2) AS sum_o_totalprice FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1", True)
asked("nl_trend", "monthly trend of o_totalprice", "SELECT month(o_orderdate)::INTEGER AS o_orderdate_month, round(sum(o_totalprice), 2) AS sum_o_totalprice FROM orders GROUP BY 1")


@query(
    "stream_daily_events",
    "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
)
def stream_daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, counted by day of event time; the table is replaced with every batch."""
    base = f"{shared_dir(spark)}/lakelens/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    whole = f"{sf_dir}/events.parquet"
    reader = spark.readStream.schema(schema)
    stream = reader.parquet(whole) if os.path.isdir(whole) else reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    counted = windowed(stream, "ts", ["event_type"], "value")
    counted.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(
        lambda batch, _: batch.write.mode("overwrite").parquet(f"{base}/out")
    ).start().awaitTermination()
    return tidy(spark.read.parquet(f"{base}/out"))
