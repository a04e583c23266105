"""Prompt sizes: what a model would read with a full schema, with a pruned one, and with intents alone."""

from __future__ import annotations

from dataclasses import dataclass, field

CHARS_PER_TOKEN = 4
PROMPT_OVERHEAD = 550


def count(text: str) -> int:
    """Tokens of a text, at four characters each where no tokenizer is at hand."""
    return max(1, len(text) // CHARS_PER_TOKEN) if text else 0


def ddl(columns: list[dict]) -> str:
    """CREATE TABLE statements for column profiles (dataset_id, name, dtype)."""
    tables: dict[str, list[str]] = {}
    for c in columns:
        tables.setdefault(c["dataset_id"], []).append(f"  {c['name']} {c['dtype']}")
    return "\n".join(f"CREATE TABLE {t} (\n" + ",\n".join(cs) + "\n);" for t, cs in sorted(tables.items()))


@dataclass
class TokenUsage:
    used: int = 0
    calls: list[tuple[str, int]] = field(default_factory=list)

    def add(self, step: str, text: str) -> None:
        n = count(text)
        self.used += n
        self.calls.append((step, n))

    def report(self, question: str, columns: list[dict], datasets: list[str]) -> dict:
        full = count(ddl(columns)) + count(question) + PROMPT_OVERHEAD
        pruned = count(ddl([c for c in columns if c["dataset_id"] in datasets])) + count(question) + PROMPT_OVERHEAD
        return {"used": self.used, "full_schema": full, "pruned_schema": pruned, "saved_share": round(1 - self.used / full, 4)}
