"""Discovery: which data sets and columns suit a described task."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from lakelens.functions import lexicon
from lakelens.functions.similarity import Encode, ratio, vector
from lakelens.functions.types import DIMENSION, IDENTIFIER, MEASURE, TIME
from lakelens.plans.retrieve import PLAIN_WORDS, Card, Column, dot

# fixed values: weights of the match, and how many data sets are looked at and shown
POOL = SHOWN = 10
NAME_EXACT, NAME_PART, NAME_FUZZY, FUZZY_FROM = 1.0, 0.6, 0.5, 0.6
ALIAS_EXACT, ALIAS_PART, ALIAS_IN_TEXT = 0.8, 0.4, 0.3
TYPE_FITS, TYPE_DIFFERS, ROLE_FITS, VECTOR_SHARE, VECTOR_FROM, LEAST = 0.3, -0.2, 0.2, 0.4, 0.3, 0.2
ID_WORD, DOMAIN_PREFILTER, DOMAIN_IN_ID, DOMAIN_FITS, FAILED = 0.3, 0.2, 2.0, 1.5, 0.5
TYPES = {"numeric": ("int64", "float64"), "categorical": ("object", "bool"), "datetime": ("datetime64",), "text": ("object",)}
ROLES = {"feature": (MEASURE, DIMENSION), "target": (MEASURE, DIMENSION), "identifier": (IDENTIFIER,), "time": (TIME,)}

PHRASES = (
    "find me data", "find data", "find dataset", "find datasets", "need data", "need a dataset", "want data", "want a dataset", "data to predict", "dataset to predict",
    "data for predicting", "to predict", "to train", "training data", "looking for data", "looking for a dataset", "which dataset", "which datasets", "recommend", "discover",
    "suitable data", "build a model",
)
TASKS = {"forecast": "forecast future trend", "classification": "classify classification predict whether churn detect", "regression": "predict regression estimate price amount", "clustering": "cluster segment group"}


@dataclass
class DesiredColumn:
    name: str
    description: str = ""
    role: str = "feature"
    expected_dtype: str = "numeric"
    required: bool = False


@dataclass
class DesiredSchema:
    raw_query: str
    domain: str | None
    task: str
    columns: list[DesiredColumn] = field(default_factory=list)
    least_rows: int | None = None


@dataclass
class Match:
    desired: str
    dataset: str
    column: str
    score: float
    evidence: list[str]


@dataclass
class Discovered:
    dataset: str
    score: float
    coverage: float
    matches: list[Match]
    failed: list[str] = field(default_factory=list)
    stats: list[dict] = field(default_factory=list)


def is_discovery(question: str) -> bool:
    q = question.lower()
    return any(re.search(rf"\b{re.escape(p)}\b", q) for p in PHRASES) or bool(re.search(r"\b(want|need|find)\b.*\bdata(set|sets)?\b.*\b(predict|train|model|analy[sz]e)", q))


def desired_schema(question: str, plug_in: Callable[[str], dict] | None = None) -> DesiredSchema:
    """What the asker needs; a plug-in (such as a language model) is tried first, words otherwise."""
    if plug_in is not None:
        try:
            raw = plug_in(question)
            return DesiredSchema(question, raw.get("domain"), raw.get("task", "analysis"), [DesiredColumn(**c) for c in raw["columns"]], raw.get("least_rows"))
        except Exception:  # noqa: BLE001 - a plug-in may fail in any way
            pass
    q = question.lower()
    scores = lexicon.domain_scores(q)
    domain = max(scores, key=scores.get) if max(scores.values()) > 0 else None
    task = next((t for t, words in TASKS.items() if any(re.search(rf"\b{w}\b", q) for w in words.split())), "analysis")
    skip = PLAIN_WORDS | set("need looking model build train training using use recommend suitable discover least rows about datasets".split())
    target = re.search(r"\b(?:predict|predicting|forecast|estimate|classify)\s+(?:the\s+)?([a-z_][a-z0-9_]*)", q)
    words = [w for w in re.findall(r"[a-z_][a-z0-9_]+", q) if w not in skip and not any(w in t.split() for t in TASKS.values() if w != "price")]
    columns = [DesiredColumn(w, q, "target" if target and w == target[1] else "feature", "numeric", bool(target and w == target[1])) for w in dict.fromkeys(words)]
    rows = re.search(r"at least\s+([\d,]+)\s+rows", q)
    return DesiredSchema(question, domain, task, columns[:8], int(rows[1].replace(",", "")) if rows else None)


def match_score(want: DesiredColumn, asked: list[float], c: Column) -> tuple[float, list[str]]:
    name, why, score = want.name.lower(), [], 0.0
    if name in (c.lexical_key, c.name.lower()):
        score, why = NAME_EXACT, ["name=exact"]
    elif name in c.lexical_key or c.lexical_key in name:
        score, why = NAME_PART, ["name~part"]
    elif (r := ratio(name, c.lexical_key)) > FUZZY_FROM:
        score, why = NAME_FUZZY * r, [f"name~{r:.2f}"]
    known = [a.lower() for a in c.aliases]
    if name in known:
        score, why = score + ALIAS_EXACT, [*why, "alias=exact"]
    elif part := next((a for a in known if len(a) > 2 and (name in a or a in name)), None):
        score, why = score + ALIAS_PART, [*why, f"alias~{part}"]
    elif told := next((a for a in known if len(a) > 3 and re.search(rf"\b{re.escape(a)}\b", want.description.lower())), None):
        score, why = score + ALIAS_IN_TEXT, [*why, f"text~{told}"]
    if kinds := TYPES.get(want.expected_dtype):
        score += TYPE_FITS if c.dtype in kinds else TYPE_DIFFERS
    if c.role in ROLES.get(want.role, ()):
        score += ROLE_FITS
    if (sim := dot(asked, c.embedding)) > VECTOR_FROM:
        score, why = score + VECTOR_SHARE * sim, [*why, f"cosine={sim:.3f}"]
    return score, why


def nearness(schema: DesiredSchema, card: Card, asked: list[float]) -> float:
    q = schema.raw_query.lower()
    named = any(len(t) > 2 and t in q for t in card.dataset_id.lower().replace("-", "_").split("_"))
    return dot(asked, card.summary_embedding) + ID_WORD * named + DOMAIN_PREFILTER * bool(schema.domain and card.domain == schema.domain)


def discover(schema: DesiredSchema, cards: list[Card], columns_of: Callable[[list[str]], list[Column]], encode: Encode = vector) -> list[Discovered]:
    """The ten best data sets with their column matches; ties by name. ``columns_of`` gives the index entries of data sets."""
    asked = encode(schema.raw_query)
    q = schema.raw_query.lower()
    wanted = [(w, encode(w.name)) for w in schema.columns]
    out = []
    pool = sorted(cards, key=lambda c: (-nearness(schema, c, asked), c.dataset_id))[:POOL]
    columns = columns_of([c.dataset_id for c in pool])
    for card in pool:
        own = [c for c in columns if c.dataset_id == card.dataset_id]
        matches = []
        for want, v in wanted:
            scored = sorted(((*match_score(want, v, c), c) for c in own), key=lambda x: (-x[0], x[2].name))
            if scored and scored[0][0] > LEAST:
                matches.append(Match(want.name, card.dataset_id, scored[0][2].name, round(scored[0][0], 4), scored[0][1]))
        failed = [f"has {card.row_count} rows"] if schema.least_rows and card.row_count < schema.least_rows else []
        n = max(1, len(wanted))
        named = any(len(t) > 2 and t in q for t in card.dataset_id.lower().replace("-", "_").split("_"))
        bonus = DOMAIN_IN_ID * named + DOMAIN_FITS * bool(schema.domain and card.domain == schema.domain)
        score = sum(m.score for m in matches) / n + bonus + len(matches) / n - FAILED * len(failed)
        out.append(Discovered(card.dataset_id, round(score, 4), round(len(matches) / n, 4), matches, failed))
    return sorted(out, key=lambda d: (-d.score, d.dataset))[:SHOWN]


def as_dict(found: list[Discovered]) -> list[dict]:
    return [asdict(d) for d in found]
