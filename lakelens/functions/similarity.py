"""Text similarity for names: Ratcliff-Obershelp ratio, and encoders of texts as vectors."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 256
#: Places of the table of inverse document frequencies.
SLOTS = 1 << 16

Encode = Callable[[str | None], list[float]]


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def ngrams(text: str) -> Counter:
    grams: Counter = Counter()
    for word in text.lower().replace("_", " ").split():
        padded = f" {word} "
        for n in (2, 3, 4):
            grams.update(padded[i : i + n] for i in range(max(1, len(padded) - n + 1)))
    return grams


@dataclass
class Encoder:
    """Normalised hashed vectors of a text's character 2- to 4-grams with sublinear counts; zeros for none.

    ``idf`` has weights for places of the gram's hash; places it lacks weigh ``unseen``.
    """

    idf: dict[int, float] = field(default_factory=dict)
    unseen: float = 1.0
    name: str = "hash"

    def __call__(self, text: str | None) -> list[float]:
        out = [0.0] * DIM
        for gram, n in ngrams(text or "").items():
            h = zlib.crc32(gram.encode())
            weight = self.idf.get(h % SLOTS, self.unseen) if self.idf else 1.0
            out[h % DIM] += (1 + math.log(n)) * weight * (1 if h & 0x10000 else -1)
        size = math.sqrt(sum(x * x for x in out))
        return [x / size for x in out] if size else out


#: The encoder that needs no corpus.
vector = Encoder()


def fitted(texts: DataFrame | Iterable[str], column: str = "text") -> Encoder:
    """An encoder that weighs grams by how few texts hold them, log((1 + n) / (1 + df)) + 1.

    Over a table the counts come from Spark; what reaches the driver is bounded by ``SLOTS``.
    """
    if isinstance(texts, DataFrame):

        def slots(frames):
            for frame in frames:
                places = [sorted({zlib.crc32(g.encode()) % SLOTS for g in ngrams(t or "")}) for t in frame[column]]
                frame = frame.assign(slot=places)[["slot"]]
                yield frame

        held = texts.select(column).mapInPandas(slots, "slot array<int>")
        n = texts.count()
        df = {r.slot: r["count"] for r in held.select(F.explode("slot").alias("slot")).groupBy("slot").count().collect()}
    else:
        every = list(texts)
        n, df = len(every), Counter(s for t in every for s in {zlib.crc32(g.encode()) % SLOTS for g in ngrams(t or "")})
    return Encoder({s: math.log((1 + n) / (1 + d)) + 1 for s, d in df.items()}, math.log(1 + n) + 1, "idf")


def encoder(mode: str = "auto", remote: Callable[[str], list[float]] | None = None, corpus: DataFrame | Iterable[str] | None = None) -> Encode:
    """The encoder of a mode: ``remote`` (a plug-in, tried once), ``idf`` (needs a corpus), ``hash``, or the first of these that works."""
    if remote is not None and mode in ("auto", "remote"):
        try:
            if remote("probe"):
                return remote
        except Exception:  # noqa: BLE001 - a plug-in may fail in any way
            pass
    if mode == "remote":
        raise ValueError("the remote encoder doesn't answer")
    if corpus is not None and mode in ("auto", "idf"):
        return fitted(corpus)
    if mode == "idf":
        raise ValueError("an encoder with document frequencies needs a corpus")
    return vector


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of equal length, 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)
