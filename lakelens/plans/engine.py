"""The engine: index a lake, answer questions about it, recommend data sets."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.observation import Observation

from lakelens.functions.similarity import Encode, Encoder, encoder, vector
from lakelens.functions.types import DIMENSION, IDENTIFIER
from lakelens.operators import cards as card_ops
from lakelens.operators import joins, vectors
from lakelens.operators.profile import profile_many
from lakelens.plans import discover as disc
from lakelens.plans import optimize as opt
from lakelens.plans.bind import BindingResult, bind, build_plan
from lakelens.plans.intent import Intent, build_intent
from lakelens.plans.plan import MAX_ROWS, Plan, QueryResult, compile_plan, execute
from lakelens.plans.retrieve import LOCAL_COLUMNS, Card, Column, boosted_score, dot, retrieve_columns, retrieve_datasets, slots
from lakelens.plans.route import route
from lakelens.plans.tokens import TokenUsage
from lakelens.runtime import file_system, written
from lakelens.sources.catalog import Catalog
from lakelens.sources.stores import AliasCache, AuditLog, OverrideStore, save_table

#: Join edges that the driver holds, and cards of a large lake that are looked at for each score.
LOCAL_EDGES, POOL_CARDS = 100_000, 50
#: Data sets profiled by the same jobs.
AT_ONCE = 40


class Engine:
    """A lake with its profiles, cards, column index and join edges.

    ``home``, a folder on any file system, keeps them between sessions. The driver holds cards, index and edges of lakes of
    up to ``LOCAL_COLUMNS`` columns. Of larger lakes it fetches what a question needs: the cards that score best, the
    profiles and index entries of the chosen data sets, the edges between these; all scores and costs are the same.
    Plug-ins, all optional: ``parser`` (question -> intent), ``domains`` (intent, names -> domain), ``remote`` (text ->
    vector), ``namer`` (column -> aliases). ``encoder`` is ``hash``, ``idf``, ``remote`` or ``auto``.
    """

    def __init__(
        self, catalog: Catalog, home: str | None = None, parser: Callable[[str], dict] | None = None, key_suffixes: bool = True, domain_mode: str = "auto",
        domains: Callable[[Intent, list[str]], str] | None = None, remote: Callable[[str], list[float]] | None = None, namer: Callable[[str], list[str]] | None = None, encoder: str = "hash",
    ):
        self.catalog, self.spark, self.home = catalog, catalog.spark, home
        self.parser, self.key_suffixes, self.domain_mode = parser, key_suffixes, domain_mode
        self.domains, self.remote, self.encoder_mode = domains, remote, encoder
        kept = lambda name: f"{home}/{name}" if home else None
        self.overrides = OverrideStore(kept("overrides.json"), self.spark)
        self.feedback = opt.FeedbackCache(kept("feedback.json"), self.spark)
        self.aliases = AliasCache(namer, kept("aliases.json"), self.spark)
        self.audit = AuditLog(self.spark, f"{home}/audit") if home else None
        self.encode: Encode = vector
        self.profiles: DataFrame | None = None
        self.index: DataFrame | None = None
        self.card_table: DataFrame | None = None
        self.edge_table: DataFrame | None = None
        self.cards: list[Card] | None = []
        self.columns: list[Column] | None = []
        self.rows: dict[str, dict[str, dict]] = {}
        self.edges: list[dict] | None = []
        self.errors: dict[str, str] = {}

    # offline: index

    def build(self, with_joins: bool = True) -> Engine:
        """Profile every data set; one that can't be read is noted and left out."""

        names = list(self.catalog)
        parts = []
        for i in range(0, len(names), AT_ONCE):
            parts += self._profiles(names[i : i + AT_ONCE])
        if not parts:
            raise ValueError("nothing in this lake can be read")
        self.profiles = reduce(DataFrame.unionByName, parts)
        if self.home:
            save_table(self.profiles, f"{self.home}/profiles")
            self.profiles = self.spark.read.parquet(f"{self.home}/profiles")
        else:
            self.profiles = self.profiles.cache()
        self._load()
        if with_joins:
            self.build_joins()
        return self

    def _profiles(self, names: list[str]) -> list[DataFrame]:
        """The profiles of some data sets together; if that fails, of each alone, to find the broken ones."""
        try:
            return [profile_many({n: self.catalog.scan(n) for n in names}, self.key_suffixes)]
        except Exception as e:  # noqa: BLE001 - a lake may hold broken files
            if len(names) == 1:
                self.errors[names[0]] = str(e)[:300]
                return []
            return [p for n in names for p in self._profiles([n])]

    def load(self) -> Engine:
        """Take profiles, cards, index and edges of an earlier session from ``home``; nothing is computed again."""
        self.profiles = self.spark.read.parquet(f"{self.home}/profiles")
        self._load(stored=True)
        fs, at = file_system(self.spark, f"{self.home}/edges")
        if fs.exists(at):
            self._take_edges(self.spark.read.parquet(f"{self.home}/edges"))
        return self

    def _load(self, stored: bool = False) -> None:
        """Cards and index as tables, kept under ``home``; those of a lake of up to ``LOCAL_COLUMNS`` columns come to the driver."""
        known = opt.TextFile(f"{self.home}/encoder.json" if self.home else None, self.spark)
        if stored and self.encoder_mode != "remote" and (text := known.read()):
            kept = json.loads(text)
            self.encode = Encoder({int(k): v for k, v in kept["idf"].items()}, kept["unseen"], kept["name"])
        else:
            corpus = self.profiles.selectExpr("concat_ws(' ', name, array_join(top_values, ' ')) AS text") if self.encoder_mode in ("idf", "auto") else None
            self.encode = encoder(self.encoder_mode, self.remote, corpus)
            if isinstance(self.encode, Encoder):
                known.write(json.dumps({"idf": self.encode.idf, "unseen": self.encode.unseen, "name": self.encode.name}))
        head = self.profiles.limit(LOCAL_COLUMNS + 1).collect()
        small = len(head) <= LOCAL_COLUMNS
        if small and self.aliases.make is not None:
            for r in head:
                self._named(r["name"])
            self.aliases.save()
        names = dict(self.aliases.known)
        more = (lambda column: names.get(column, [])) if names else None
        self.index, self.card_table = card_ops.column_index(self.profiles, self.encode, more), card_ops.dataset_cards(self.profiles, self.encode)
        if self.home:
            for name, df in (("index", self.index), ("cards", self.card_table)):
                if not stored:
                    save_table(df, f"{self.home}/{name}")
            self.index, self.card_table = self.spark.read.parquet(f"{self.home}/index"), self.spark.read.parquet(f"{self.home}/cards")
        self.rows = {}
        if not small:
            self.columns = self.cards = None
            if not self.home:  # written, as every question reads them
                self.index, self.card_table = written(self.index, "index"), written(self.card_table, "cards")
            return
        for r in head:
            self.rows.setdefault(r["dataset_id"], {})[r["name"]] = r.asDict(recursive=True)
        self.columns = [Column(**card_ops.entry_of(p, self.encode, more)) for own in self.rows.values() for p in own.values()]
        self.cards = [self._card(card_ops.card_of(list(own.values()), self.encode)) for own in self.rows.values()]

    def _named(self, column: str) -> list[str]:
        try:
            return self.aliases(column)
        except Exception:  # noqa: BLE001 - a plug-in may fail in any way
            return []

    @staticmethod
    def _card(card: dict) -> Card:
        return Card(**{k: card[k] for k in Card.__dataclass_fields__})

    def build_joins(self, least: float = 0.5) -> list[dict] | None:
        """Edges between key and dimension columns with at least two values; either direction."""
        chosen = self.profiles.where((self.profiles["inferred_role"].isin(IDENTIFIER, DIMENSION)) & (self.profiles["n_unique"] >= 2))
        columns: dict[str, list[str]] = {}
        for r in chosen.select("dataset_id", "name").collect():
            columns.setdefault(r["dataset_id"], []).append(r["name"])
        if len(columns) > 1:
            values = joins.column_values({d: self.catalog.scan(d) for d in columns}, columns)
            edges = written(joins.both_ways(joins.overlap_edges(values, least)), "edges")
            if self.home:
                save_table(edges, f"{self.home}/edges")
                edges = self.spark.read.parquet(f"{self.home}/edges")
            self._take_edges(edges)
        return self.edges

    def _take_edges(self, edges: DataFrame) -> None:
        head = [r.asDict(recursive=True) for r in edges.limit(LOCAL_EDGES + 1).collect()]
        self.edge_table, self.edges = edges, head if len(head) <= LOCAL_EDGES else None

    # what a question needs of a lake, from the driver or from Spark

    def rows_of(self, datasets: list[str]) -> dict[str, dict[str, dict]]:
        """The profiles of some data sets, by data set and column."""
        if self.columns is not None:
            return {d: self.rows.get(d, {}) for d in datasets}
        out: dict[str, dict[str, dict]] = {d: {} for d in datasets}
        for r in self.profiles.where(self.profiles["dataset_id"].isin(datasets)).collect():
            out[r["dataset_id"]][r["name"]] = r.asDict(recursive=True)
        return out

    def columns_of(self, datasets: list[str]) -> list[Column]:
        """The index entries of some data sets."""
        if self.columns is not None:
            return [c for c in self.columns if c.dataset_id in datasets]
        return [Column(**{k: r[k] for k in Column.__dataclass_fields__}) for r in self.index.where(self.index["dataset_id"].isin(datasets)).collect()]

    def cards_for(self, *scores: Callable[[Card], float]) -> list[Card]:
        """All cards of a small lake; of a large one the ``POOL_CARDS`` best by each score, which is all that rankings look at."""
        if self.cards is not None:
            return self.cards
        fields = list(Card.__dataclass_fields__)

        def scored(frames):
            for f in frames:
                cards = [Card(**{k: list(v) if hasattr(v, "__len__") and not isinstance(v, str) else v for k, v in r.items()}) for r in f[fields].to_dict("records")]
                for i, score in enumerate(scores):
                    f[f"s{i}"] = [float(score(c)) for c in cards]
                yield f[["dataset_id", *(f"s{i}" for i in range(len(scores)))]]

        table = written(self.card_table.mapInPandas(scored, "dataset_id string, " + ", ".join(f"s{i} double" for i in range(len(scores)))), "card-scores")
        best = {r["dataset_id"] for i in range(len(scores)) for r in table.orderBy(F.desc(f"s{i}"), "dataset_id").limit(POOL_CARDS).collect()}
        return [self._card(r.asDict()) for r in self.card_table.where(self.card_table["dataset_id"].isin(sorted(best))).collect()]

    def edges_among(self, datasets: list[str]) -> list[dict]:
        if self.edges is not None:
            return self.edges
        e = self.edge_table
        return [r.asDict(recursive=True) for r in e.where(e["left_dataset"].isin(datasets) & e["right_dataset"].isin(datasets)).collect()]

    def similar_columns(self, dataset: str, column: str | None = None, top_k: int = 10, least: float = 0.4) -> DataFrame:
        """(query_dataset_id, query_name, dataset_id, name, similarity, rank): columns of other data sets that resemble a data set's."""
        own = self.index.where(self.index["dataset_id"] == dataset)
        if column:
            own = own.where(own["name"] == column)
        return vectors.similar_of_others(self.index, own, ["dataset_id", "name"], "dataset_id", "embedding", top_k, least)

    # questions

    def parse(self, question: str) -> Intent:
        return build_intent(question, self.parser)

    def plan_for(self, intent: Intent, method: str = "weighted") -> tuple[BindingResult, Plan | None, dict]:
        asked = self.encode(" ".join([intent.raw_query, *(h for _, h in slots(intent))]))
        near = self.cards_for(lambda c: dot(asked, c.summary_embedding))
        domain = route(intent, near, self.domain_mode, self.domains, self.encode)
        prior = domain.domain if domain.confidence >= 0.3 else None
        cards = self.cards_for(lambda c: boosted_score(c, intent, prior))
        datasets = retrieve_datasets(cards, intent, prior, encode=self.encode)
        candidates = retrieve_columns(self.columns_of(datasets), datasets, intent, method, self.encode)
        binding = bind(intent, datasets, candidates, self.edges_among(datasets), self.overrides.boost)
        info = {"domain": domain.__dict__, "datasets": datasets, "candidates": len(candidates)}
        missing = [h for h in intent.metric_hints if not binding.of("metric")]
        if binding.dataset_id is None or not binding.entries or missing and intent.agg_func_hint:
            return binding, None, info
        return binding, build_plan(intent, binding), info

    def ask(self, question: str, run: bool = True) -> dict:
        return self.answer(self.parse(question), run)

    def answer(self, intent: Intent, run: bool = True, method: str = "weighted") -> dict:
        """Everything about one question: intent, binding, plan, cost, and with ``run`` the rows. Errors are returned."""
        usage = TokenUsage()
        usage.add("question", intent.raw_query)
        binding, plan, info = self.plan_for(intent, method)
        out = {"question": intent.raw_query, "intent": intent.to_dict(), **info, "bindings": [vars(e) for e in binding.entries], "blocked": [vars(c) for c in binding.blocked],
               "rejected": [vars(e) for e in binding.rejected], "notes": binding.notes}
        if plan is None:
            return self._audited(out | {"status": "unbound", "error": "no column fits the question"})
        own = self.rows_of([plan.dataset_id])[plan.dataset_id]
        plan, log = opt.optimize(plan, len(own) or None)
        cost = opt.estimate(plan, own, self.feedback, lambda: self.catalog.sample(plan.dataset_id))
        out |= {"plan": plan.to_dict(), "rewrites": log, "cost": opt.cost_dict(cost), "status": "planned"}
        shown = self.rows if self.columns is not None else self.rows_of(info["datasets"])
        out["tokens"] = usage.report(intent.raw_query, [{"dataset_id": d, "name": n, "dtype": p["dtype"]} for d, cs in shown.items() for n, p in cs.items()], info["datasets"])
        if run:
            seen = self._watched(plan, cost)
            result = execute(plan, self.catalog, observe=seen)
            out |= {"columns": result.columns, "rows": result.rows, "row_count": result.row_count, "status": "failed" if result.error else "done", "error": result.error}
            if seen is not None and not result.error:
                self.learn(plan, cost, seen.get["kept"])
        return self._audited(out)

    @staticmethod
    def _watched(plan: Plan, cost: opt.PlanCost) -> Observation | None:
        """A counter of the rows that pass the filters, where a plan has some on one table and reads all of it."""
        return Observation("kept") if plan.all("FILTER") and plan.all("AGGREGATE") and not plan.all("JOIN") and cost.rows_scanned else None

    def learn(self, plan: Plan, cost: opt.PlanCost, kept: int) -> None:
        """Record what the filters together really kept; of a single filter that is its own selectivity."""
        filters = plan.all("FILTER")
        if len(filters) == 1:
            column, op, value = filters[0]["column"], filters[0].get("op", "="), filters[0].get("value")
        else:
            column, op, value = opt.FeedbackCache.together(filters)
        self.feedback.record(plan.dataset_id, column, op, value, cost.rows_scanned, kept, cost.selectivity)

    def _audited(self, record: dict) -> dict:
        if self.audit is not None:
            record["id"] = self.audit.save({k: v for k, v in record.items() if k != "rows"})
        return record

    def frame(self, question: str) -> DataFrame:
        """The answer as a lazy DataFrame without the row cap."""
        _, plan, _ = self.plan_for(self.parse(question))
        if plan is None:
            raise ValueError(f"no column fits the question {question!r}")
        return compile_plan(opt.optimize(plan)[0], self.catalog)

    def execute(self, plan: Plan | dict, cap: int = MAX_ROWS) -> QueryResult:
        return execute(plan if isinstance(plan, Plan) else Plan.from_dict(plan), self.catalog, cap)

    def correct(self, hint: str, column: str, dataset: str | None = None, slot: str | None = None, question: str | None = None) -> dict:
        """Store a correction, and answer the question again if one is given."""
        rule = self.overrides.add(hint, column, dataset, slot)
        return {"rule": vars(rule)} | ({"result": self.ask(question)} if question else {})

    def choices(self, intent: Intent) -> dict[str, list[str]]:
        """What a person could choose from to make an ambiguous question clear."""
        cards = self.cards_for(lambda c: boosted_score(c, intent, None))
        near = set(retrieve_datasets(cards, intent, encode=self.encode))
        own = [c for c in cards if c.dataset_id in near]
        take = lambda name, n: sorted({x for c in own for x in getattr(c, name)})[:n]
        return {"metrics": take("measure_columns", 8), "dimensions": take("dimension_columns", 8), "times": take("time_columns", 5), "aggregates": ["sum", "avg", "count", "max", "min", "median"]}

    # discovery

    def discover(self, question: str, plug_in: Callable[[str], dict] | None = None) -> dict:
        schema = disc.desired_schema(question, plug_in)
        asked = self.encode(schema.raw_query)
        found = disc.discover(schema, self.cards_for(lambda c: disc.nearness(schema, c, asked)), self.columns_of, self.encode)
        rows = self.rows_of([d.dataset for d in found])
        for d in found:
            own = rows[d.dataset]
            d.stats = [{k: own[m.column][k] for k in ("name", "dtype", "inferred_role", "missing_rate", "unique_rate", "min_val", "max_val", "mean_val")} for m in d.matches if m.column in own]
        return {"question": question, "domain": schema.domain, "task": schema.task, "desired": [vars(c) for c in schema.columns], "datasets": disc.as_dict(found)}

    def handle(self, question: str) -> dict:
        """Discovery or an analytic answer, as the question asks."""
        return self.discover(question) if disc.is_discovery(question) else self.ask(question)


def engine_for_tables(spark: SparkSession, sf_dir: str, names: list[str], with_joins: bool = False) -> Engine:
    """An engine over Parquet tables of a folder."""
    return Engine(Catalog(spark, {n: f"{sf_dir}/{n}.parquet" for n in names})).build(with_joins)
