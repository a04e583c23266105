"""The domain of a question: by words, by vectors, or by a plug-in."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from lakelens.functions import lexicon
from lakelens.functions.similarity import Encode, vector
from lakelens.plans.intent import Intent
from lakelens.plans.retrieve import Card, dot, slots

# fixed values
FACTOR, HIGHEST, CLOSE, UNSURE, NEIGHBOURS = 3.0, 0.95, 0.05, 0.3, 5


@dataclass
class Routing:
    domain: str | None = None
    confidence: float = 0.0
    method: str = "off"
    ambiguous: bool = False
    scores: dict[str, float] = field(default_factory=dict)


def _of_scores(scores: dict[str, float], method: str, factor: float = 1.0) -> Routing:
    ranked = sorted(scores.items(), key=lambda kv: (-kv[1], kv[0]))
    if not ranked or ranked[0][1] <= 0:
        return Routing(method=method, scores=scores)
    gap = ranked[0][1] - (ranked[1][1] if len(ranked) > 1 else 0.0)
    return Routing(ranked[0][0], min(factor * ranked[0][1], HIGHEST), method, gap < CLOSE, scores)


def by_rules(intent: Intent) -> Routing:
    hints = " ".join(lexicon.canonical(h) + " " + h for _, h in slots(intent))
    return _of_scores(lexicon.domain_scores(f"{intent.raw_query} {hints}"), "rule", FACTOR)


def by_vectors(intent: Intent, cards: list[Card], encode: Encode = vector) -> Routing:
    """Cosines of the nearest data sets, summed by their domain; the confidence is the winner's share."""
    asked = encode(" ".join([intent.raw_query, *(h for _, h in slots(intent))]))
    near = sorted(((max(0.0, dot(asked, c.summary_embedding)), c.domain) for c in cards), reverse=True)[:NEIGHBOURS]
    total = sum(s for s, _ in near)
    scores: dict[str, float] = {}
    for s, d in near:
        scores[d] = scores.get(d, 0.0) + (s / total if total else 0.0)
    return _of_scores(scores, "embedding")


def route(intent: Intent, cards: list[Card], mode: str = "auto", plug_in: Callable[[Intent, list[str]], str] | None = None, encode: Encode = vector) -> Routing:
    """``off``, ``rule``, ``embedding``, ``plug-in``, or ``auto``: vectors, and rules where these are unsure."""
    if mode == "off":
        return Routing()
    if mode == "plug-in" and plug_in is not None:
        try:
            domain = plug_in(intent, sorted(lexicon.DOMAINS))
        except Exception:  # noqa: BLE001 - a plug-in may fail in any way
            domain = None
        return Routing(domain, 1.0, "plug-in") if domain in lexicon.DOMAINS else by_rules(intent)
    if mode == "rule":
        return by_rules(intent)
    found = by_vectors(intent, cards, encode)
    return found if mode == "embedding" or found.confidence >= UNSURE and not found.ambiguous else max(by_rules(intent), found, key=lambda r: r.confidence)
