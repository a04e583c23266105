"""Problem 6: byte-level BPE of a whole corpus with a public vocabulary.

Distinct pretokens are encoded together: they are bucketed by byte length into padded matrices of ids, and in each
round every row merges its leftmost pair of minimum rank (and the further, non-overlapping occurrences of that very
pair: a merged token's own pairs always rank later, so the order of merges is the same). Pair ranks come from a
hashed pair table; finished rows leave the matrix and merged rows are compacted to the left.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lakelens.llm.codebook import Codebook, slices
from lakelens.runtime import spread

TOKENIZER_DIR = os.environ.get("LAKELENS_TOKENIZERS", "/opt/tokenizers")

# fixed values: the public split pattern of this vocabulary family
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# A piece never runs from a non-space into a space, so a text may be cut before every single space between two
# non-spaces. Texts in which white space stands beside a space are split as a whole.
WORD = re.compile(r" ?[^ ]+").findall
UNEVEN = re.compile(r"\s |^ | \Z").search

NONE = np.int32(2**31 - 1)
WIDTHS = (2, 4, 6, 8, 12, 16, 24, 32, 64, 128)
CELLS = 1_000_000


class PairTable:
    """Open-addressing hash table from a pair of ids to the rank (= id) of their merge."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        bits = max(8, int(np.ceil(np.log2(max(1, len(rank)) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, NONE, np.int32)
        keys = (left.astype(np.int64) << 32) | right
        slot, todo, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(todo):
            self.probes += 1
            free = self.keys[slot[todo]] < 0
            take = todo[free]
            _, first = np.unique(slot[take], return_index=True)  # one winner for each free slot
            won = take[first]
            self.keys[slot[won]], self.ranks[slot[won]] = keys[won], rank[won]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, NONE where there is no merge or a side is padding."""
        keys = (left.astype(np.int64) << 32) | right
        out = np.full(keys.shape, NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = keys.ravel()[todo]
        slot, flat = self._slot(keys), out.ravel()
        for _ in range(self.probes):
            at = self.keys[slot]
            hit = at == keys
            flat[todo[hit]] = self.ranks[slot[hit]]
            more = ~hit & (at >= 0)
            if not more.any():
                break
            todo, keys, slot = todo[more], keys[more], (slot[more] + 1) & self.mask
        return flat.reshape(out.shape)


class BytePairEncoder:
    """Encoder for one ``.tiktoken`` rank file; ``encode`` takes texts, ``encode_pretokens`` their pieces."""

    def __init__(self, path: str):
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [
            (ranks[t[:k]], ranks[t[k:]], r)
            for t, r in ranks.items()
            for k in range(1, len(t))
            if t[:k] in ranks and t[k:] in ranks
        ]
        self.table = PairTable(*np.array(pairs, np.int32).T)
        self.split = regex.compile(SPLIT).findall
        self.pieces = Codebook(self.encode_pretokens)
        self.words = Codebook(self.encode_words)

    def encode_pretokens(self, pieces: list[str]) -> list[np.ndarray]:
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(raw)
        bucket = np.searchsorted(np.array(WIDTHS), sizes)
        long = np.flatnonzero(bucket == len(WIDTHS))
        groups = [np.flatnonzero(bucket == b) for b in range(len(WIDTHS))] + [long[i : i + 1] for i in range(len(long))]
        for rows in groups:
            if not len(rows):
                continue
            width = int(sizes[rows].max())
            step = max(1, CELLS // max(1, width))
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                self._merge(part, raw, sizes[part], width, out)
        return out

    def _merge(self, rows: np.ndarray, raw: list[bytes], sizes: np.ndarray, width: int, out: list[np.ndarray]) -> None:
        ids = np.full((len(rows), width), -1, np.int32)
        ids[np.arange(width) < sizes[:, None]] = self.byte_ids[np.frombuffer(b"".join(raw[r] for r in rows), np.uint8)]
        while len(rows):
            if ids.shape[1] > 1:
                rank = self.table.lookup(ids[:, :-1], ids[:, 1:])
                best = rank.min(axis=1)
            else:
                best = np.full(len(rows), NONE, np.int32)
            done = best == NONE
            if done.any():
                finished = ids[done]
                lens = (finished >= 0).sum(axis=1)
                for r, row, n in zip(rows[done].tolist(), finished, lens.tolist()):
                    out[r] = row[:n].copy()
                rows, ids, rank, best = rows[~done], ids[~done], rank[~done] if ids.shape[1] > 1 else ids[~done], best[~done]
                if not len(rows):
                    break
            hit = rank == best[:, None]
            # in a run of overlapping hits (equal symbols) only each second one merges, from the left
            at = np.arange(hit.shape[1])
            last_miss = np.maximum.accumulate(np.where(hit, -1, at), axis=1)
            hit &= (at - last_miss) % 2 == 1
            ids[:, :-1][hit] = np.broadcast_to(best[:, None], hit.shape)[hit]
            keep = ids >= 0
            keep[:, 1:] &= ~hit
            place = np.cumsum(keep, axis=1) - 1
            width = int(place[:, -1].max()) + 1
            merged = np.full((len(rows), width), -1, np.int32)
            r, c = np.nonzero(keep)
            merged[r, place[r, c]] = ids[r, c]
            ids = merged

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        split = [self.split(w) for w in words]
        ids, counts = self.pieces.ids([p for s in split for p in s], np.fromiter(map(len, split), np.int64, len(split)))
        return np.split(ids, np.cumsum(counts)[:-1])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and the number of ids of each; none for empty and null texts."""
        words: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                found = self.split(text) if UNEVEN(text) else WORD(text)
                counts[i] = len(found)
                words += found
        return self.words.ids(words, counts)


_encoders: dict[str, BytePairEncoder] = {}


def encoder(path: str) -> BytePairEncoder:
    if path not in _encoders:
        _encoders[path] = BytePairEncoder(path)
    return _encoders[path]


def token_ids(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = "byte_bpe_50k",
    tokenizer_dir: str = TOKENIZER_DIR,
) -> DataFrame:
    """(id, ids array<int>) of every row of ``docs``.

    Null and empty texts get an empty list; repeated rows are encoded as often as they are stored; a null id stays
    null; strings that look like special tokens are ordinary text; an empty table gives an empty result. Only the two
    columns named are read, so other columns may have any name. One narrow stage without a shuffle.
    """
    path = f"{tokenizer_dir}/{vocabulary}.tiktoken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                ids, counts = bpe.encode(texts[a:b])
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["id", "ids"])

    picked = spread(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")))
    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)
