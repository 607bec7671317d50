"""Benchmark decontamination by Wu-Manber search over words.

Patterns are windows of consecutive benchmark words. A shift table indexed by a block of two
words says how far the search may jump; positions with shift 0 look up the bucket of patterns
that end in that block, and the bytes of the words are compared before a hit counts. Many
stretches of text advance side by side, so each step is a few numpy operations.
"""

from __future__ import annotations

import math
import pickle
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltrace.llm.arrow import SMALL, in_text_parts
from siltrace.llm.words import ALNUM, joined, mix, words
from siltrace.session import small_batches, stored

_K = np.uint64(0xD6E8FEB86659FD93)
SEGMENT = 256  # end positions that one lane searches


def _spelled(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: int, n: int) -> bytes:
    return b" ".join(low[starts[k] : ends[k]].tobytes() for k in range(first, first + n))


class WuManber:
    """Finds all occurrences of word patterns that share one length.

    Pattern p is the ``m`` words from ``first[p]`` on in ``codes``, a flat array of word codes;
    no pattern is copied. Patterns are distinct.
    """

    def __init__(self, codes: np.ndarray, first: np.ndarray, m: int):
        self.codes, self.first, self.m = codes, first, m
        self.block = min(2, m)
        self.default = m - self.block + 1
        blocks = np.unique(self._hash(codes, np.unique(first[:, None] + np.arange(self.block - 1, m))))
        self.mask = np.uint64((1 << max(10, math.ceil(math.log2(8 * len(blocks))))) - 1)
        self.shift = np.full(int(self.mask) + 1, min(255, self.default), np.uint8)
        for end in range(self.block - 1, m):
            np.minimum.at(self.shift, self._slots(codes, first + end), min(255, m - 1 - end))
        suffix = self._slots(codes, first + m - 1)
        self.order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.order]

    def _hash(self, codes: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(codes[end] if self.block == 1 else codes[end - 1] * _K + codes[end])

    def _slots(self, codes: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Table slots of the blocks that end at words ``end``."""
        return (self._hash(codes, end) & self.mask).astype(np.int64)

    def search(self, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of candidates; no occurrence spans two texts of ``bounds``."""
        lo = bounds[:-1] + self.m - 1
        lanes = np.maximum(0, -(-(bounds[1:] - lo) // SEGMENT))
        owner = np.repeat(np.arange(len(lo)), lanes)
        at = lo[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * SEGMENT
        stop = np.minimum(at + SEGMENT, bounds[1:][owner])
        found = []
        while len(at):
            shift = self.shift[self._slots(codes, at)]
            found.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        at = np.concatenate(found) if found else np.zeros(0, np.int64)
        slot = self._slots(codes, at)
        left = np.searchsorted(self.suffix, slot, "left")
        many = np.searchsorted(self.suffix, slot, "right") - left
        at = np.repeat(at, many)
        pattern = self.order[np.repeat(left, many) + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)]
        ok = np.ones(len(at), bool)
        for k in range(self.m):  # the other words, nearest to the start first
            ok[ok] = codes[at[ok] - self.m + 1 + k] == self.codes[self.first[pattern[ok]] + k]
        return at[ok] - self.m + 1, pattern[ok]


class Patterns:
    """The windows of one block of items, as flat arrays: searchers by window length, the bytes of
    the items' words, and the items of each pattern."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        data, at = joined(pa.array([t for _, t in items], pa.large_string()))
        codes, starts, ends, before = words(data, at, ALNUM)
        self.low, self.starts, self.ends = ALNUM[data], starts.astype(np.int64), ends.astype(np.int64)
        self.names = sorted({i for i, _ in items})
        number = {n: k for k, n in enumerate(self.names)}
        counts = np.diff(before)
        lengths = np.minimum(counts, window)
        self.searchers: list[tuple[WuManber, np.ndarray, np.ndarray]] = []
        for m in np.unique(lengths[lengths > 0]).tolist():
            own = np.flatnonzero(lengths == m)
            many = counts[own] - m + 1
            first = np.repeat(before[:-1][own], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            owner = np.repeat(np.array([number[items[k][0]] for k in own], np.int64), many)
            code = np.full(len(first), m, np.uint64)
            for k in range(m):
                code = mix(code * _K + codes[first + k])
            _, kept, which = np.unique(code, return_index=True, return_inverse=True)
            same = np.ones(len(first), bool)
            for k in range(m):
                same &= codes[first + k] == codes[first[kept][which] + k]
            # a window that only shares the code of another stays a pattern of its own
            odd = np.flatnonzero(~same)
            which[odd] = len(kept) + np.arange(len(odd))
            kept = np.concatenate([kept, odd])
            pairs = np.unique(which * len(self.names) + owner)
            of = np.searchsorted(pairs // len(self.names), np.arange(len(kept) + 1))
            self.searchers.append((WuManber(codes, first[kept], m), of, pairs % len(self.names)))

    def spelled(self, searcher: WuManber, pattern: int) -> bytes:
        return _spelled(self.low, self.starts, self.ends, int(searcher.first[pattern]), searcher.m)

    def found(self, codes, bounds, low, starts, ends):
        """(first word, length, items) of each occurrence, after its bytes are compared."""
        for searcher, of, owners in self.searchers:
            first, pattern = searcher.search(codes, bounds)
            for a, p in zip(first.tolist(), pattern.tolist()):
                if _spelled(low, starts, ends, a, searcher.m) == self.spelled(searcher, p):
                    yield a, searcher.m, owners[of[p] : of[p + 1]]


def _built(rows: pd.DataFrame, window: int) -> pd.DataFrame:
    rows = rows.sort_values(["i", "t"])
    return pd.DataFrame({"tables": [pickle.dumps(Patterns(list(zip(rows["i"], rows["t"])), window), protocol=5)]})


def _marked(batch: pa.RecordBatch, patterns: Patterns, text: str) -> pa.RecordBatch:
    """Adds this block of patterns' hits to ``_words``, ``_spans`` and ``_items``."""
    data, at = joined(batch.column(batch.schema.get_field_index(text)))
    codes, starts, ends, first = words(data, at, ALNUM)
    low = ALNUM[data]
    hit = np.zeros(len(codes) + 1, np.int64)
    items: dict[int, set[int]] = {}
    for a, m, owners in patterns.found(codes, first, low, starts, ends):
        hit[a] += 1
        hit[a + m] -= 1
        items.setdefault(int(np.searchsorted(first, a, "right")) - 1, set()).update(owners.tolist())
    is_hit = np.cumsum(hit)[:-1] > 0
    before_spans, before_items = (batch.column(batch.schema.get_field_index(x)) for x in ("_spans", "_items"))
    spans, named = [], []
    for d in range(batch.num_rows):
        own = is_hit[first[d] : first[d + 1]]
        old = before_spans[d].as_py() or []
        if old:
            own = own.copy()
            for a, b in zip(old[::2], old[1::2]):
                own[a:b] = True
        spans.append(np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]))).tolist() if own.any() else old)
        named.append(sorted({*(before_items[d].as_py() or []), *(patterns.names[k] for k in items.get(d, ()))}))
    columns = {n: c for n, c in zip(batch.schema.names, batch.columns)}
    columns |= {"_words": pa.array(np.diff(first).astype(np.int64)), "_spans": pa.array(spans, pa.list_(pa.int64())), "_items": pa.array(named, pa.list_(pa.string()))}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` with ``_words`` long, ``_spans`` array<long> and ``_items`` array<string>.

    ``_spans`` alternates the first hit word and the word after the last one of each hit
    stretch; ``_items`` are the sorted distinct ids (as strings) of items with an occurring
    window. An item with fewer than ``window`` words is one window; null and empty items have
    none, and a null item id counts as the empty string. Null and empty documents have no
    words. Repeated rows are judged one by one. Columns of ``docs`` that begin with one of
    the three result names are replaced.

    Texts and items of any length are searched whole. Items are searched for in blocks of about ``block_bytes`` of text (an item is never
    parted). Executors build a block's tables as flat arrays, some ten times the text, and one
    block at a time goes through the driver to the executors; between blocks the documents
    are written to the shared folder, so no worker holds two. With one block nothing is
    written, and documents are never shuffled.
    """
    items = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(item_text).alias("t")).where("t is not null")
    size = items.agg(F.sum(F.octet_length("t") + F.lit(64))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    small_batches(docs.sparkSession)
    out = docs.drop("_words", "_spans", "_items").select("*", F.lit(0).cast("bigint").alias("_words"), F.lit(None).cast("array<bigint>").alias("_spans"), F.lit(None).cast("array<string>").alias("_items"))
    dealt = items.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(blocks))).repartition(blocks, "b")
    tables = dealt.groupBy("b").applyInPandas(lambda rows: _built(rows.drop(columns="b"), window).assign(b=rows["b"].iloc[0]), "tables binary, b bigint")
    tables = tables if blocks == 1 else stored(tables, "decontam-tables")
    empty = pickle.dumps(Patterns([], window), protocol=5)
    for b in range(blocks):
        row = tables.where(F.col("b") == b).select("tables").first()
        sent = docs.sparkSession.sparkContext.broadcast(bytes(row[0]) if row else empty)
        name = uuid.uuid4().hex
        mark = in_text_parts(lambda batch, s=sent, n=name: _marked(batch, _opened(s, n), text), text, most=SMALL)
        out = out.mapInArrow(mark, out.schema)
        if b < blocks - 1:
            out = stored(out, "decontam-pass")
            sent.unpersist()
    return out


_open: dict[str, Patterns] = {}


def _opened(sent, name: str) -> Patterns:
    """The worker's current tables; those of an earlier block are let go."""
    if name not in _open:
        _open.clear()
        _open[name] = pickle.loads(sent.value)
    return _open[name]


def decontaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without any occurring window, columns unchanged."""
    return contamination(docs, items, **options).where(F.size("_items") == 0).select(*docs.columns)
