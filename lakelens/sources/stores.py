"""Small stores: overrides, audit records, card and alias caches."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.functions import lexicon
from lakelens.plans.retrieve import Candidate
from lakelens.runtime import file_system, read_text, write_text

#: What a correction adds to the corrected column, if the hard constraints left it among the candidates.
BOOST = 5.0


@dataclass
class OverrideRule:
    hint: str
    column: str
    dataset: str | None = None
    slot: str | None = None
    id: str = field(default_factory=lambda: uuid.uuid4().hex[:12])
    active: bool = True
    used: int = 0
    created: float = field(default_factory=time.time)


class TextFile:
    """A small text file on any file system; one that has no path keeps nothing."""

    def __init__(self, path: str | None, spark: SparkSession | None = None):
        self.path, self.spark = path, spark

    def read(self) -> str | None:
        if self.path is None:
            return None
        if self.spark is not None:
            return read_text(self.spark, self.path)
        return open(self.path, encoding="utf-8").read() if os.path.exists(self.path) else None

    def write(self, text: str) -> None:
        if self.path is None:
            return
        if self.spark is not None:
            write_text(self.spark, self.path, text)
            return
        os.makedirs(os.path.dirname(os.path.abspath(self.path)), exist_ok=True)
        with open(self.path, "w", encoding="utf-8") as f:
            f.write(text)


class AliasCache:
    """Aliases that a plug-in gave, by column name, in one JSON file; the plug-in is asked once a name, and again with ``refresh``."""

    def __init__(self, make: Callable[[str], list[str]] | None, path: str | None = None, spark: SparkSession | None = None, refresh: bool = False):
        self.make, self.file = make, TextFile(path, spark)
        self.known: dict[str, list[str]] = {} if refresh else json.loads(self.file.read() or "{}")
        self.asked = 0

    def __call__(self, column: str) -> list[str]:
        if column not in self.known:
            if self.make is None:
                return []
            self.asked += 1
            self.known[column] = [str(a) for a in self.make(column)]
        return self.known[column]

    def save(self) -> None:
        if self.asked:
            self.file.write(json.dumps(self.known, indent=1, sort_keys=True, ensure_ascii=False))


class OverrideStore:
    """Corrections of bindings, in one JSON file: added or updated, looked up exactly and then by synonym, never erased."""

    def __init__(self, path: str | None = None, spark: SparkSession | None = None):
        self.file = TextFile(path, spark)
        stored = json.loads(self.file.read() or "[]")
        self.rules = [OverrideRule(**r) for r in stored]

    def save(self) -> None:
        self.file.write(json.dumps([asdict(r) for r in self.rules], indent=1))

    def add(self, hint: str, column: str, dataset: str | None = None, slot: str | None = None) -> OverrideRule:
        for r in self.rules:
            if r.active and (r.hint, r.dataset, r.slot) == (hint.lower(), dataset, slot):
                r.column = column
                break
        else:
            r = OverrideRule(hint.lower(), column, dataset, slot)
            self.rules.append(r)
        self.save()
        return r

    def remove(self, rule_id: str) -> bool:
        for r in self.rules:
            if r.id == rule_id and r.active:
                r.active = False
                self.save()
                return True
        return False

    def clear(self) -> None:
        for r in self.rules:
            r.active = False
        self.save()

    def active(self) -> list[OverrideRule]:
        return [r for r in self.rules if r.active]

    def find(self, hint: str, slot: str | None = None) -> OverrideRule | None:
        own = [r for r in self.active() if r.slot in (None, slot)]
        exact = next((r for r in own if r.hint == hint.lower()), None)
        return exact or next((r for r in own if lexicon.canonical(r.hint) == lexicon.canonical(hint)), None)

    def boost(self, candidates: list[Candidate]) -> list[str]:
        """Raise corrected columns among the candidates that passed the constraints; notes what was applied."""
        notes = []
        for slot, hint in dict.fromkeys((c.slot, c.hint) for c in candidates):
            rule = self.find(hint, slot)
            if rule is None:
                continue
            hit = next((c for c in candidates if (c.slot, c.hint, c.column) == (slot, hint, rule.column) and rule.dataset in (None, c.dataset)), None)
            if hit is None:
                notes.append(f"the correction {hint} -> {rule.column} doesn't fit here")
                continue
            hit.score += BOOST
            hit.evidence = ["override", "name=exact", *hit.evidence]
            rule.used += 1
            notes.append(f"corrected {hint} -> {rule.column}")
        self.save()
        return notes


AUDIT = "id string, timestamp double, question string, status string, record string"


class AuditLog:
    """One row for each question, appended as JSON files in batches of ``batch``; listed newest first.

    Rows that wait are written before anything is read; ``flush`` writes them at once.
    """

    def __init__(self, spark: SparkSession, path: str, batch: int = 50):
        self.spark, self.path, self.batch = spark, path, batch
        self.waiting: list[tuple] = []

    def save(self, record: dict) -> str:
        key = record.setdefault("id", uuid.uuid4().hex)
        row = (key, float(record.setdefault("timestamp", time.time())), record.get("question"), record.get("status"), json.dumps(record, default=str))
        self.waiting.append(row)
        if len(self.waiting) >= self.batch:
            self.flush()
        return key

    def flush(self) -> None:
        if self.waiting:
            self.spark.createDataFrame(self.waiting, AUDIT).coalesce(1).write.mode("append").json(self.path)
            self.waiting = []

    def frame(self) -> DataFrame:
        """All rows; an empty log has none."""
        self.flush()
        if not file_system(self.spark, self.path)[0].exists(file_system(self.spark, self.path)[1]):
            return self.spark.createDataFrame([], AUDIT)
        return self.spark.read.schema(AUDIT).json(self.path)

    def recent(self, limit: int = 20) -> DataFrame:
        return self.frame().select("id", "timestamp", "question", "status").orderBy(F.desc("timestamp"), "id").limit(limit)

    def load(self, key: str) -> dict | None:
        row = self.frame().where(F.col("id") == key).first()
        return json.loads(row.record) if row else None

    @staticmethod
    def show(record: dict) -> str:
        """A record as readable text."""
        lines = [f"question: {record.get('question')}", f"status: {record.get('status')}"]
        for part in ("intent", "datasets", "bindings", "blocked", "plan", "rewrites", "cost"):
            if record.get(part):
                lines.append(f"{part}: {json.dumps(record[part], ensure_ascii=False, default=str)}")
        return "\n".join(lines)


def save_table(df: DataFrame, path: str) -> None:
    """Profiles, cards and the column index persist as Parquet."""
    df.write.mode("overwrite").parquet(path)
