"""The linear plan and its compilation to one lazy DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.observation import Observation

from lakelens.operators.buckets import medians
from lakelens.operators.relational import PlanError, aggregate, condition, derive_time, join_type, ordering, quoted, year_condition
from lakelens.runtime import bytes_of
from lakelens.sources.catalog import Catalog

OPS = ("SCAN", "JOIN", "DERIVE_TIME", "FILTER", "GROUPBY", "AGGREGATE", "SORT", "LIMIT", "SELECT")
MAX_ROWS = 500
#: Input beyond which medians are taken from bucket counts.
MEDIAN_BYTES = 256 << 20


@dataclass
class PlanOp:
    op: str
    params: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.op = self.op.upper()
        if self.op not in OPS:
            raise PlanError(f"unknown step {self.op}")


@dataclass
class Plan:
    dataset_id: str
    steps: list[PlanOp] = field(default_factory=list)

    @classmethod
    def of(cls, *steps: tuple[str, dict]) -> Plan:
        ops = [PlanOp(o, dict(p)) for o, p in steps]
        return cls(next(s.params["dataset"] for s in ops if s.op == "SCAN"), ops)

    @classmethod
    def from_dict(cls, d: dict) -> Plan:
        return cls(d["dataset_id"], [PlanOp(s["op"], dict(s["params"])) for s in d["steps"]])

    def to_dict(self) -> dict:
        return {"dataset_id": self.dataset_id, "steps": [{"op": s.op, "params": s.params} for s in self.steps]}

    def display(self) -> list[dict]:
        return [{"step": i, "op": s.op, "params": s.params} for i, s in enumerate(self.steps)]

    def edit(self, index: int, action: str = "remove", params: dict | None = None) -> Plan:
        """Remove or modify a step; SCAN can't be removed, and an index out of range changes nothing."""
        steps = [PlanOp(s.op, dict(s.params)) for s in self.steps]
        if 0 <= index < len(steps):
            if action == "modify":
                steps[index].params |= params or {}
            elif action == "remove" and steps[index].op != "SCAN":
                del steps[index]
        return Plan(self.dataset_id, steps)

    def all(self, op: str) -> list[dict]:
        return [s.params for s in self.steps if s.op == op]

    def last(self, op: str) -> dict | None:
        return (self.all(op) or [None])[-1]


class Frame:
    """The joined data with its columns under unique inner names, addressed by owner: ``column`` or ``dataset.column``."""

    def __init__(self, df: DataFrame, owners: list[tuple[str, list[str]]]):
        self.df, self.owners = df, owners
        self.derived: list[str] = []

    @staticmethod
    def inner(k: int, column: str) -> str:
        return f"t{k + 1}.{column}"

    def name(self, ref: str) -> str:
        if ref in self.derived:
            return ref
        for k, (_, columns) in enumerate(self.owners):
            if ref in columns:
                return self.inner(k, ref)
        for k, (dataset, columns) in enumerate(self.owners):
            if ref.startswith(dataset + ".") and ref[len(dataset) + 1 :] in columns:
                return self.inner(k, ref[len(dataset) + 1 :])
        low = [self.inner(k, c) for k, (_, cs) in enumerate(self.owners) for c in cs if c.lower() == ref.lower()]
        if len(low) == 1:
            return low[0]
        raise PlanError(f"no column {ref!r}")

    def col(self, ref: str) -> Column:
        return quoted(self.name(ref))

    def kind(self, ref: str):
        return self.df.schema[self.name(ref)].dataType


def renamed(df: DataFrame, k: int) -> DataFrame:
    return df.select(*(quoted(c).alias(Frame.inner(k, c)) for c in df.columns))


def scanned(plan: Plan, catalog: Catalog) -> Frame:
    scan = plan.last("SCAN")
    dataset = scan["dataset"] if scan else plan.dataset_id
    first = catalog.scan(dataset)
    frame = Frame(renamed(first, 0), [(dataset, first.columns)])
    for k, p in enumerate(plan.all("JOIN"), 1):
        right = catalog.scan(p["right_dataset"])
        other = renamed(right, k)
        how = join_type(p.get("join_type"))
        if how == "cross":
            frame.df = frame.df.crossJoin(other)
        else:
            if p["right_key"] not in right.columns:
                raise PlanError(f"no column {p['right_key']!r} in {p['right_dataset']}")
            frame.df = frame.df.join(other, frame.col(p["left_key"]) == quoted(Frame.inner(k, p["right_key"])), how)
        if how not in ("left_semi", "left_anti"):
            frame.owners.append((p["right_dataset"], right.columns))
        else:
            frame.owners.append((p["right_dataset"], []))
    return frame


def aggregated(frame: Frame, by: list[str], aggregates: dict[str, tuple[str, str]]) -> DataFrame:
    """The groups with their aggregates by name.

    A median over more than ``MEDIAN_BYTES`` of input is taken from bucket counts, as the aggregate function keeps the
    distinct values of a group in one buffer; the result is the same.
    """
    apart = {n: m for n, (m, f) in aggregates.items() if f == "median"}
    if not apart or bytes_of(frame.df) <= MEDIAN_BYTES:
        apart = {}
    rest = [aggregate(frame.col(m), f).alias(n) for n, (m, f) in aggregates.items() if n not in apart]
    plain = {f"k{i}": k for i, k in enumerate(by)}
    keyed = frame.df.select(*(quoted(k).alias(p) for p, k in plain.items()), *{i: quoted(i).alias(i) for i in map(frame.name, apart.values()) if i not in by}.values()) if apart else None
    out = frame.df.groupBy(*map(quoted, by)).agg(*rest) if rest or not apart else None
    for n, m in apart.items():
        inner = frame.name(m)
        one = medians(keyed, list(plain), next((p for p, k in plain.items() if k == inner), inner), n)
        if out is None:
            out = one.withColumnsRenamed(plain)
        elif not by:
            out = out.crossJoin(F.broadcast(one))  # one row each
        else:
            out = out.join(one, [quoted(k).eqNullSafe(one[p]) for p, k in plain.items()]).drop(*plain)
    return out.select(*map(quoted, by), *map(quoted, aggregates))


def compile_plan(plan: Plan, catalog: Catalog, observe: Observation | None = None) -> DataFrame:
    """One lazy DataFrame: joins, derivations, filters, grouping, order, limit, projection, whatever the steps' order.

    Filters are conjunctive and always apply before aggregation. A sort on an aggregated metric orders by its
    aggregate; group keys break ties, so that a limit is repeatable. No row cap is applied unless a LIMIT says so.
    """
    frame = scanned(plan, catalog)
    years: dict[str, str] = {}
    for p in plan.all("DERIVE_TIME"):
        target = p["target"]
        if p.get("unit", "year") == "year":
            years[target] = p["source"]
        frame.df = frame.df.withColumn(target, derive_time(frame.col(p["source"]), p.get("unit", "year")))
        frame.derived.append(target)
    for p in plan.all("FILTER"):
        op, value = p.get("op", "="), p.get("value")
        source = years.get(p["column"])
        bounds = year_condition(frame.col(source), frame.kind(source), op, value) if source else None
        frame.df = frame.df.where(condition(frame.col(p["column"]), frame.kind(p["column"]), op, value) if bounds is None else bounds)
    if observe is not None:
        frame.df = frame.df.observe(observe, F.count(F.lit(1)).alias("kept"))
    keys = (plan.last("GROUPBY") or {}).get("keys", [])
    metrics = list({(p["metric"], p.get("func", "sum").lower()): None for p in plan.all("AGGREGATE")})
    select = (plan.last("SELECT") or {}).get("columns") or []
    shown: dict[str, str] = {}  # output name -> inner name
    inner = {r: frame.name(r) for r in [*keys, *(m for m, _ in metrics)]}

    def show(ref: str) -> None:
        """Under the bare column name, or the whole reference where that name is taken."""
        at = frame.name(ref)
        bare = ref if at == ref else at.split(".", 1)[1]
        shown.setdefault(bare if shown.get(bare, at) == at else ref, at)

    if metrics:
        names = {m: [f"{f}_{inner[m].split('.', 1)[-1]}" for n, f in metrics if n == m] for m, _ in metrics}
        for k in keys:
            show(k)
        out = aggregated(frame, list(shown.values()), {f"{f}_{inner[m].split('.', 1)[-1]}": (m, f) for m, f in metrics})
        shown |= {n: n for n in out.columns if n not in shown.values()}
    elif keys:
        for k in keys:
            show(k)
        out = frame.df.select(*(quoted(i) for i in shown.values())).distinct()
    else:
        for c in select or [*frame.owners[0][1], *frame.derived]:
            show(c)
        out = frame.df
    if sort := plan.last("SORT"):
        wanted = sort["column"]
        own = names.get(wanted) if metrics else None
        target = own[0] if own else shown.get(wanted) or frame.name(wanted)
        if target not in out.columns:
            raise PlanError(f"can't sort by {wanted!r}: it is neither grouped nor aggregated")
        ties = [quoted(inner[k]).asc_nulls_last() for k in keys if inner[k] != target]
        out = out.orderBy(ordering(quoted(target), sort.get("order", "desc")), *ties)
    if limit := plan.last("LIMIT"):
        out = out.limit(max(0, int(limit["n"])))
    return out.select(*(quoted(i).alias(n) for n, i in shown.items()))


@dataclass
class QueryResult:
    """Columns and rows as the API gives them, or the error; ``df`` stays lazy and uncapped."""

    columns: list[str] = field(default_factory=list)
    rows: list[list] = field(default_factory=list)
    row_count: int = 0
    plan_text: str = ""
    error: str | None = None
    df: DataFrame | None = None


def execute(plan: Plan, catalog: Catalog, cap: int = MAX_ROWS, observe: Observation | None = None) -> QueryResult:
    """Run a plan; at most ``cap`` rows come to the driver; errors are returned, not raised.

    ``observe`` counts the rows that pass the filters (``kept``) while the query runs; it needs no further scan and leaves
    the filters where the scan can use them.
    """
    try:
        df = compile_plan(plan, catalog, observe)
        rows = [list(r) for r in df.limit(cap).collect()]
        return QueryResult(df.columns, rows, len(rows), df._jdf.queryExecution().simpleString(), None, df)
    except Exception as e:  # noqa: BLE001 - the API returns errors
        return QueryResult(error=f"{type(e).__name__}: {e}")


