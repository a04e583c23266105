"""Problem 7: held-out passages inside a corpus, by a Wu-Manber multi-pattern search over words.

The patterns are all runs of ``run`` consecutive words of all passages, so all have one length m. A block is
``BLOCK`` words. For each block the shift table tells how far the search may jump: m - BLOCK + 1 for a block of no
pattern, else the least distance of the block from a pattern's end. Where the shift is 0, the suffix-hash bucket of
that block selects the patterns to compare word by word. The stream of all documents of a batch is cut into lanes
that advance together in numpy, each by its own shifts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelens.llm.codebook import Codebook, slices
from lakelens.llm.words import words
from lakelens.runtime import spread, written

BLOCK = 3
LANE = 512
#: Passages are searched in blocks of about this many characters, so that the broadcast patterns stay bounded.
ITEM_CHARS = 8_000_000
#: Candidates compared at once.
CANDIDATES = 2_000_000


class WuManber:
    """Searches streams of word ids for runs; ids are those of the patterns' own vocabulary, 0 for other words.

    The patterns are not copied out: they are the places in the passages' own stream of ids where a run ends.
    """

    def __init__(self, items: list[tuple[object, list[str]]], run: int):
        self.m, self.block = run, min(BLOCK, run)
        self.vocabulary: dict[str, int] = {}
        known = self.vocabulary
        self.items = [item for item, _ in items]
        sizes = np.fromiter((len(ws) for _, ws in items), np.int64, len(items))
        total = int(sizes.sum())
        self.passages = np.fromiter((known.setdefault(w, len(known) + 1) for _, ws in items for w in ws), np.int32, total)
        owner = np.repeat(np.arange(len(items)), sizes)
        place = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)  # of each word in its passage
        bits = int(np.clip(np.ceil(np.log2(max(1, total) * 8)), 16, 26))
        self.drop = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, min(run - self.block + 1, 32_767), np.int16)
        # passages too short for a run hold no pattern
        ends = np.flatnonzero((place >= self.block - 1) & (sizes[owner] >= run))
        np.minimum.at(self.shift, self._hash_at(self.passages, ends), np.minimum(np.maximum(run - 1 - place[ends], 0), 32_767).astype(np.int16))
        self.ends = np.flatnonzero(place >= run - 1)
        suffix = self._hash_at(self.passages, self.ends)
        order = np.argsort(suffix, kind="stable")
        self.ends, self.suffix = self.ends[order], suffix[order]
        self.owner = owner[self.ends]

    def _hash_at(self, stream: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The hash of the block of words that ends at each position."""
        h = np.zeros(len(at), np.uint64)
        for j in range(self.block):
            h = (h + stream[at - self.block + 1 + j].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return (h * np.uint64(0xBF58476D1CE4E5B9) >> self.drop).astype(np.int64)

    def search(self, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end positions, item indices) of all occurrences."""
        none = np.zeros(0, np.int64)
        if len(stream) < self.m or not len(self.ends):
            return none, none
        first = np.arange(0, len(stream), LANE)
        stop = np.minimum(first + LANE, len(stream))
        at = np.maximum(first, self.m - 1)
        live = at < stop
        at, stop = at[live], stop[live]
        ends: list[np.ndarray] = []
        while len(at):
            jump = self.shift[self._hash_at(stream, at)]
            stays = jump == 0
            if stays.any():
                ends.append(at[stays])
            at = at + np.maximum(jump, 1)
            live = at < stop
            if not live.all():
                at, stop = at[live], stop[live]
        if not ends:
            return none, none
        end = np.sort(np.concatenate(ends))
        suffix = self._hash_at(stream, end)
        lo, hi = np.searchsorted(self.suffix, suffix, "left"), np.searchsorted(self.suffix, suffix, "right")
        found_at, found_item = [none], [none]
        # candidates are compared in slices, so that a run which many passages share doesn't multiply memory
        upto = np.cumsum(hi - lo)
        for part in np.split(np.arange(len(end)), np.searchsorted(upto, np.arange(CANDIDATES, int(upto[-1]), CANDIDATES))):
            n = (hi - lo)[part]
            pos = np.repeat(end[part], n)
            pattern = np.repeat(lo[part] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            for j in range(self.m):  # direct comparison, word by word
                same = stream[pos - self.m + 1 + j] == self.passages[self.ends[pattern] - self.m + 1 + j]
                pos, pattern = pos[same], pattern[same]
            found_at.append(pos)
            found_item.append(self.owner[pattern])
        return np.concatenate(found_at), np.concatenate(found_item)


class LeakFinder:
    """Turns texts into streams of word ids and searches them."""

    def __init__(self, engine: WuManber):
        self.engine = engine
        ids = self.engine.vocabulary.get
        self.book = Codebook(lambda tokens: [[ids(w, 0) for w in words(t)] for t in tokens])

    def find(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text index, item index) pairs."""
        tokens: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                found = text.split()
                counts[i] = len(found)
                tokens += found
        ids, n = self.book.ids(tokens, counts)
        # one unknown word between texts: no run crosses it
        ends = np.cumsum(n)
        stream = np.insert(ids, ends[:-1], 0) if len(ends) > 1 else ids
        pos, item = self.engine.search(stream)
        doc = np.searchsorted(ends + np.arange(len(ends)), pos, "right")
        pairs = np.unique(np.stack([doc, item], axis=1), axis=0)
        return pairs[:, 0], pairs[:, 1]


def item_blocks(items: DataFrame, id_col: str, text_col: str, chars: int = ITEM_CHARS) -> Iterator[tuple[list[tuple[object, str]], bool]]:
    """The non-null passages in blocks of about ``chars`` characters, by a hash of id and passage: bounded on the driver.

    With each block whether there are several.
    """
    picked = items.select(items[id_col].alias("i"), items[text_col].alias("p")).where("i is not null and p is not null")
    total = picked.agg(F.coalesce(F.sum(F.length("p")), F.lit(0))).first()[0]
    n = int(total // chars) + 1
    for b in range(n):
        block = picked if n == 1 else picked.where(F.pmod(F.xxhash64("i", "p"), F.lit(n)) == b)
        yield [(r.i, r.p) for r in block.distinct().collect()], n > 1


_finders: dict[str, LeakFinder] = {}


def finder(key: str, shared: Broadcast) -> LeakFinder:
    """The finder of a block of passages, made once for each worker process; it keeps one block only."""
    if key not in _finders:
        _finders.clear()
        _finders[key] = LeakFinder(shared.value)
    return _finders[key]


def leaked_items(
    docs: DataFrame,
    items: DataFrame,
    run: int = 12,
    doc_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    passage_col: str = "passage",
    item_chars: int = ITEM_CHARS,
) -> DataFrame:
    """Distinct (doc id, item id): the document's text and the item's passage share ``run`` consecutive words.

    Null and empty texts or passages, and passages of fewer than ``run`` words, match nothing; rows stored twice
    count once; a null item id is left out; an empty table on either side gives an empty result; other columns are
    not read. The tables of a block of passages are built once, on the driver, and broadcast; the corpus is scanned once
    for each block, without a shuffle of texts. Of several blocks only one is broadcast at a time: its hits are written
    before the next is made.
    """
    spark = docs.sparkSession
    picked = spread(docs.select(docs[doc_col].alias("d"), docs[text_col].alias("t")).where(F.length("t") > 0))
    doc_type, item_type = picked.schema["d"].dataType, items.schema[item_col].dataType
    arrow_item = pa.string() if item_type.simpleString() == "string" else pa.int64() if item_type.simpleString() == "bigint" else pa.int32()
    parts: list[DataFrame] = []
    many = None
    for block, more in item_blocks(items, item_col, passage_col, item_chars):
        many = more if many is None else many
        engine = WuManber([(i, words(p)) for i, p in block], run)
        shared, key = spark.sparkContext.broadcast(engine), uuid.uuid4().hex

        def run_block(batches: Iterator[pa.RecordBatch], shared=shared, key=key) -> Iterator[pa.RecordBatch]:
            search = finder(key, shared)
            ids = pa.array(search.engine.items, arrow_item)
            for batch in batches:
                texts = batch.column(1).to_pylist()
                for a, b in slices(texts):
                    doc, item = search.find(texts[a:b])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc + a)), ids.take(pa.array(item))], names=["d", "i"])

        hits = picked.mapInArrow(run_block, f"d {doc_type.simpleString()}, i {item_type.simpleString()}")
        if many:
            hits = written(hits, "p7-block")
            shared.destroy()
        parts.append(hits)
    return reduce(DataFrame.union, parts).distinct().withColumnsRenamed({"d": doc_col, "i": item_col})
