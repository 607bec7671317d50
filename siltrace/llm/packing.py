"""Packing documents into sequences of a fixed number of tokens.

Lengths, not documents, are packed: there are at most ``capacity`` different ones, so the
plan is made from a histogram and its size does not depend on the corpus. Large lengths are
sorted and cut into groups of equal cardinality, each length is rounded up to its group's
largest, and the few sizes left are packed by the best mix of configurations (column
generation). Actual lengths then take the places of the rounded ones, and what is left is
added by best fit, longest first. Spark ranks the documents of each length and gives each
rank its place in the plan.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import warnings
import zlib
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltrace.llm.arrow import SMALL, in_text_parts
from siltrace.llm.words import BLANKS, joined, spans, word_codes
from siltrace.session import small_batches, stored

KNOWN = 1_000_000  # words and parts of words whose ids a Python worker keeps, about 60 bytes each
CACHED_STEMS = 200_000  # of a Python worker, of words that are not cut in bulk; over 200 bytes each
#: What a vocabulary file must say for its words to be encoded one by one (fixed values).
_WORD_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_STEM = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]*)")
_IN_WORD = re.compile(r"[^\W\d_]*[!-/:-@\[-`{-~]*")  # an added token that may lie in letters and signs after them
_workers: dict[str, _Encoder] = {}


def _two_byte_letters() -> np.ndarray:
    """The lower case of letters of two bytes in UTF-8, where that is one such letter and both are normal; else 0."""
    low = np.zeros(1 << 11, np.int64)
    for c in map(chr, range(0x80, 1 << 11)):
        x = c.lower()
        if c.isalpha() and len(x) == 1 and 0x80 <= ord(x) < 1 << 11 and x.lower() == x and unicodedata.is_normalized("NFC", c) and unicodedata.is_normalized("NFC", x):
            low[ord(c)] = ord(x)
    return low


_LOW = _two_byte_letters()
_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LETTER = _UPPER | (_BYTES >= 97) & (_BYTES <= 122)
_SIGN = (_BYTES > 32) & (_BYTES < 127) & ~_LETTER & ~((_BYTES >= 48) & (_BYTES <= 57))


def _parts(word: str) -> tuple[str, ...]:
    """Stretches that such a vocabulary encodes apart: letters, and ASCII signs after them.

    Letters that become others and a mark when normalised stay with their signs, as the mark would join them.
    """
    m = _STEM.fullmatch(word)
    if not m or not "".join(map(str.lower, unicodedata.normalize("NFC", m[1]))).isalpha():
        return (word,)
    stem = m[1].lower() if m[1].isascii() else m[1]
    return (stem, m[2]) if m[2] else (stem,)


def _cut(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, starts and ends of what is encoded apart, which of these are letters, and how many lie before each text.

    A word between white space that is letters of one or two bytes, and then ASCII signs or
    nothing, is cut there and its letters are lower-cased in the text; other words stay as they are.
    """
    starts, ends = spans(BLANKS[data] != 0, at)
    letter, sign = _LETTER[data], _SIGN[data]
    lead = np.flatnonzero((data >= 0xC2) & (data < 0xE0))
    char = (data[lead] & 31).astype(np.int64) << 6 | data[lead + 1] & 63
    lead, char = lead[_LOW[char] > 0], char[_LOW[char] > 0]
    letter[lead] = letter[lead + 1] = True
    letters, signs = (np.concatenate([[0], np.cumsum(x)]) for x in (letter, sign))
    many = letters[ends] - letters[starts]
    cut = starts + many
    plain = (many > 0) & (letters[cut] - letters[starts] == many) & (signs[ends] - signs[cut] == ends - cut)

    text = data.copy()
    upper = np.flatnonzero(_UPPER[data])
    text[upper[plain[np.searchsorted(starts, upper, "right") - 1]]] += 32
    lead, char = lead[_LOW[char] != char], _LOW[char[_LOW[char] != char]]
    inside = plain[np.searchsorted(starts, lead, "right") - 1]
    text[lead[inside]], text[lead[inside] + 1] = char[inside] >> 6 | 0xC0, char[inside] & 63 | 0x80

    two = plain & (cut < ends)
    to = np.arange(len(starts)) + np.cumsum(two) - two
    begin, end, letters_only = (np.empty(len(starts) + int(two.sum()), t) for t in (np.int64, np.int64, bool))
    begin[to], end[to], letters_only[to] = starts, np.where(two, cut, ends), plain
    begin[to[two] + 1], end[to[two] + 1], letters_only[to[two] + 1] = cut[two], ends[two], False
    return text, begin, end, letters_only, np.searchsorted(begin, at)


def _put(array: np.ndarray, used: int, values: np.ndarray) -> np.ndarray:
    """``array`` with ``values`` from ``used`` on, made longer if need be."""
    if used + len(values) > len(array):
        array = np.concatenate([array, np.zeros(max(len(values), len(array)), array.dtype)])
    array[used : used + len(values)] = values
    return array


class _Encoder:
    """Ids of many texts at once.

    Where the vocabulary drops white space, lower-cases and ends words with a mark, words are
    cut into letters and signs and each different part is encoded once: its 64-bit code (bytes
    are not compared) is looked up in a sorted table that names a slot, which says where the ids
    lie in one buffer. When the table is full, parts that were not met again are dropped. Any
    other vocabulary encodes whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        norms, splits = (said.get("normalizer") or {}).get("normalizers"), (said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        bytewise = len(splits) == 2 and splits[1]["type"] == "ByteLevel" and not splits[1]["add_prefix_space"] and not splits[1]["use_regex"]
        apart = norms == _WORD_NORMALIZERS and (splits[0].get("pattern") or {}).get("Regex") == _WORD_SPLIT and splits[0].get("behavior") == "Removed" and splits[0].get("invert")
        added = said.get("added_tokens") or []
        mixed = any(t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) or _IN_WORD.fullmatch(t["content"]) for t in added)
        self.by_word = bool(apart and bytewise and said["model"].get("end_of_word_suffix") == "</w>" and not mixed)
        if self.by_word:  # for lower-case letters between blanks, which nothing else would change
            self.lower = Tokenizer(self.tokenizer.model)
            self.lower.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), self.tokenizer.pre_tokenizer[1]])
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.codes, self.slot, self.stems = np.zeros(0, np.uint64), np.zeros(0, np.int32), {}
        self.at, self.many, self.met, self.slots = np.zeros(1 << 16, np.int64), np.ones(1 << 16, np.int64), np.zeros(1 << 16, bool), 1
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 1  # slot 0 is the end of a text

    def _make_room(self, new: int) -> None:
        """Drops what was not met again since the last time, if ``new`` more would be too many; all, if that isn't enough."""
        if len(self.codes) + new <= KNOWN:
            return
        keep = self.met[self.slot]
        if 2 * int(keep.sum()) + new > KNOWN:
            keep[:] = False
        slots = self.slot[keep]
        at, many = self.at[slots], self.many[slots]
        flat = self.flat[_within(at, many)]
        self.codes, self.slot = self.codes[keep], np.arange(1, len(slots) + 1, dtype=np.int32)
        self.at, self.many, self.met = np.concatenate([[0], 1 + np.cumsum(many) - many]), np.concatenate([[1], many]), np.zeros(len(slots) + 1, bool)
        self.flat, self.used, self.slots = np.concatenate([self.flat[:1], flat]), 1 + len(flat), len(slots) + 1

    def _learn(self, codes: np.ndarray, flat: np.ndarray, many: np.ndarray) -> None:
        """Adds parts, given by their sorted new codes, all their ids and how many each has."""
        self.at = _put(self.at, self.slots, self.used + np.cumsum(many) - many)
        self.many, self.met = _put(self.many, self.slots, many), _put(self.met, self.slots, np.zeros(len(many), bool))
        self.flat = _put(self.flat, self.used, flat)
        where = np.searchsorted(self.codes, codes)
        self.codes = np.insert(self.codes, where, codes)
        self.slot = np.insert(self.slot, where, np.arange(self.slots, self.slots + len(codes), dtype=np.int32))
        self.slots, self.used = self.slots + len(codes), self.used + len(flat)

    def _of_letters(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of stretches of lower-case letters, many encoded at a time and cut where a token ends a word."""
        sizes = ends - starts + 1
        raw = text[np.minimum(_within(starts, sizes), len(text) - 1)]
        at = np.concatenate([[0], np.cumsum(sizes)])
        raw[at[1:] - 1] = 32
        raw, bounds = raw.tobytes(), [*at[:-1:500].tolist(), int(at[-1])]
        groups = [raw[i:j].decode() for i, j in zip(bounds, bounds[1:])]
        each = [np.array(e.ids, np.uint32) for e in self.lower.encode_batch_fast(groups, add_special_tokens=False)]
        flat = np.concatenate([np.zeros(0, np.uint32), *each])
        cuts = np.flatnonzero(self.ends[flat]) + 1
        if len(cuts) == len(starts):
            return flat, np.diff(cuts, prepend=0)
        return self._of_words(raw.decode().split(" ")[:-1])  # a word without a last token

    def _of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of any words without white space."""
        parts = [_parts(w) for w in words]
        if len(self.stems) > CACHED_STEMS:
            self.stems = {}
        new = list({p for both in parts for p in both} - self.stems.keys())
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            self.stems.update((w, np.array(e.ids, np.uint32)) for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)))
        each = [[self.stems[p] for p in both] for both in parts]
        many = np.array([sum(map(len, both)) for both in each], np.int64)
        return np.concatenate([np.zeros(0, np.uint32), *(x for both in each for x in both)]), many

    def ids(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by ``end_id``, and each text's start, with the end as last."""
        if not self.by_word:
            own = [[*e.ids, end_id] for e in self.tokenizer.encode_batch_fast([t or "" for t in column.to_pylist()], add_special_tokens=False)]
            return np.fromiter((i for ids in own for i in ids), np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
        data, text_at = joined(column)
        text, starts, ends, letters_only, first = _cut(data, text_at)
        unique, example, which = np.unique(word_codes(BLANKS[text], starts, ends), return_index=True, return_inverse=True)
        self._make_room(len(unique))
        place = np.searchsorted(self.codes, unique)
        new = np.ones(len(unique), bool)
        inside = place < len(self.codes)
        new[inside] = self.codes[place[inside]] != unique[inside]
        self.met[self.slot[place[~new]]] = True
        if new.any():
            codes, example = unique[new], example[new]
            easy = letters_only[example]
            if easy.any():
                self._learn(codes[easy], *self._of_letters(text, starts[example[easy]], ends[example[easy]]))
            if not easy.all():
                raw, example = text.tobytes(), example[~easy]
                self._learn(codes[~easy], *self._of_words([raw[i:j].decode() for i, j in zip(starts[example].tolist(), ends[example].tolist())]))
            place = np.searchsorted(self.codes, unique)
        self.flat[0] = end_id
        slots = np.insert(self.slot[place][which], first[1:], 0)  # the end is one more part of each text
        many = self.many[slots]
        before = np.concatenate([[0], np.cumsum(many)])
        return self.flat[_within(self.at[slots], many)], before[first + np.arange(len(first))]


def _within(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of stretches of ``sizes`` from ``starts`` on, one after another."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def _encoder(path: str) -> _Encoder:
    if path not in _workers:
        _workers[path] = _Encoder(path)
    return _workers[path]


def token_ids(texts: list[str | None], path: str, end_id: int = 0) -> list[np.ndarray]:
    """Each text's ids and ``end_id``."""
    ids, at = _encoder(path).ids(pa.array(texts, pa.large_string()), end_id)
    return [ids[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist())]


def _pieces(batch: pa.RecordBatch, path: str, capacity: int, end_id: int) -> pa.RecordBatch:
    ids, at = _encoder(path).ids(batch.column(1), end_id)
    sizes = np.diff(at)
    many = -(-sizes // capacity)
    row = np.repeat(np.arange(len(sizes)), many)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    start = piece * capacity
    length = np.minimum(capacity, sizes[row] - start)
    raw, begin = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B"), 4 * (at[row] + start)
    crc = [zlib.crc32(raw[i:j]) for i, j in zip(begin.tolist(), (begin + 4 * length).tolist())]
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["id", "piece", "start", "length", "ids_crc32"])


def _best_configuration(sizes: np.ndarray, value: np.ndarray, capacity: int) -> np.ndarray:
    """The multiset of ``sizes`` of most ``value`` within ``capacity`` (unbounded knapsack)."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    s, v = sizes[order], value[order]
    for c in range(int(s[0]), capacity + 1):
        n = int(np.searchsorted(s, c, "right"))
        gain = best[c - s[:n]] + v[:n]
        k = int(gain.argmax())
        best[c], took[c] = (gain[k], k) if gain[k] > best[c - 1] + 1e-12 else (best[c - 1], -1)
    out, c = np.zeros(len(sizes), np.int64), capacity
    while c >= s[0]:
        if took[c] < 0:
            c -= 1
        else:
            out[order[took[c]]] += 1
            c -= int(s[took[c]])
    return out


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[int, np.ndarray]]:
    """(times, multiset) by column generation, rounded down, most used first."""
    s, d = np.asarray(sizes), np.asarray(demand, float)
    basis = np.diag(capacity // s).astype(float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        column = _best_configuration(s, np.ones(len(s)) @ inverse, capacity).astype(float)
        if np.ones(len(s)) @ inverse @ column <= 1 + 1e-7:
            break
        step, now = inverse @ column, inverse @ d
        ratio = np.where(step > 1e-9, now / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    else:
        warnings.warn(f"configurations were still getting better after {rounds} rounds; the plan may need more sequences", stacklevel=2)
    times = np.floor(np.linalg.solve(basis, d) + 1e-7).astype(np.int64)
    return [(int(times[k]), basis[:, k].astype(np.int64)) for k in np.argsort(-times, kind="stable") if times[k] > 0]


def _grouped(histogram: dict[int, int], over: int, groups: int) -> list[deque]:
    """Lengths above ``over``, longest first, in groups of equal cardinality: [length, count]."""
    total = sum(n for x, n in histogram.items() if x > over)
    each, out, room = max(1, -(-total // groups)), [], 0
    for x in sorted((x for x in histogram if x > over), reverse=True):
        n = histogram[x]
        while n:
            if not room:
                out.append(deque())
                room = each
            take = min(n, room)
            out[-1].append([x, take])
            n, room = n - take, room - take
    return out


def _take(queue: deque, n: int) -> list[tuple[int, int]]:
    got = []
    while n and queue:
        k = min(n, queue[0][1])
        got.append((queue[0][0], k))
        queue[0][1] -= k
        n -= k
        if not queue[0][1]:
            queue.popleft()
    return got


def pack(histogram: dict[int, int], capacity: int, over: int, groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of sequences, [(length, how many in each), ...]) that hold the whole histogram."""
    queues = _grouped(histogram, over, groups)
    sizes: dict[int, list[int]] = defaultdict(list)
    for k, q in enumerate(queues):
        sizes[q[0][0]].append(k)  # groups with one largest length share a size
    names = sorted(sizes, reverse=True)
    demand = [sum(n for k in sizes[x] for _, n in queues[k]) for x in names]
    merged = [deque(y for k in sizes[x] for y in queues[k]) for x in names]
    bins: dict[int, list] = defaultdict(list)
    for times, config in configurations(names, demand, capacity) if names else ():
        slots = [(k, int(a)) for k, a in enumerate(config) if a]
        while times:
            block = min([times, *(max(1, merged[k][0][1] // a) if merged[k] else 1 for k, a in slots)])
            runs = []
            for k, a in slots:
                uniform = merged[k] and merged[k][0][1] >= a * block
                runs += [(x, n // block) for x, n in _take(merged[k], a * block)] if uniform or block == 1 else []
            bins[capacity - sum(x * n for x, n in runs)].append((block, runs))
            times -= block
    left: dict[int, int] = defaultdict(int)
    for q in merged:
        for x, n in q:
            left[x] += n
    for x, n in histogram.items():
        if x <= over:
            left[x] += n
    for x in sorted(left, reverse=True):  # best fit of all of one length at a time
        n = left[x]
        for room in range(x, capacity + 1):
            while n and (bins[room] if room in bins else None):
                many, runs = bins[room].pop()
                k = room // x
                full = min(many, n // k)
                if full:
                    bins[room - k * x].append((full, [*runs, (x, k)]))
                    n -= full * k
                many -= full
                if many and n:  # fewer than k are left
                    bins[room - n * x].append((1, [*runs, (x, n)]))
                    many, n = many - 1, 0
                if many:
                    bins[room].append((many, runs))
            if not n:
                break
        if n:
            k = capacity // x
            if n // k:
                bins[capacity - k * x].append((n // k, [(x, k)]))
            if n % k:
                bins[capacity - (n % k) * x].append((1, [(x, n % k)]))
    return [y for room in bins.values() for y in room if y[1]]


def plan(histogram: dict[int, int], capacity: int = 2048) -> list[tuple[int, list[tuple[int, int]]]]:
    """The ``pack`` of fewest sequences over three choices of what counts as large."""
    tried = [pack(histogram, capacity, capacity // part, groups) for part, groups in ((2, 16), (3, 32), (5, 32))]
    return min(tried, key=lambda p: sum(n for n, _ in p))


def _places(packed) -> dict[str, np.ndarray]:
    """Runs of ranks of a length: (length, first rank) -> how many a sequence, sequence, offset."""
    rows, used, sequence = [], defaultdict(int), 0
    for many, runs in packed:
        at = 0
        for x, k in runs:
            rows.append((x, used[x], k, sequence, at))
            used[x] += many * k
            at += x * k
        sequence += many
    rows.sort()
    return {n: np.asarray(c, np.int64) for n, c in zip(("length", "rank", "each", "sequence", "offset"), zip(*rows))} if rows else {}


def _placed(batches, places):
    key = places["length"] * (1 << 44) + places["rank"] if places else None
    for batch in batches:
        columns = dict(zip(batch.schema.names, batch.columns))
        length, rank = (np.asarray(columns[c], np.int64) for c in ("length", "rank"))
        run = np.searchsorted(key, length * (1 << 44) + rank, "right") - 1
        nth, each = rank - places["rank"][run], places["each"][run]
        del columns["rank"]
        columns |= {"sequence_id": pa.array(places["sequence"][run] + nth // each), "offset": pa.array(places["offset"][run] + nth % each * length)}
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def packed_sequences(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """``id, piece, start, length, ids_crc32, sequence_id, offset`` for each piece of a document.

    A document is its token ids and ``end_id``; a null or empty text is ``end_id`` alone. Only
    a longer document than ``capacity`` is cut, however long it is. Other columns of ``docs``
    are not used and may have any name. Repeated rows and null ids are packed like any
    others; an empty table gives no rows. The histogram of lengths (at most ``capacity`` rows)
    is all that reaches the driver, and the plan's size is bounded by ``capacity`` too. The
    documents of one length are ranked in hash buckets whose number follows the input, so no
    task holds all of a common length.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kind = source.schema["id"].dataType.simpleString()
    pieces = stored(source.mapInArrow(in_text_parts(lambda b: _pieces(b, path, capacity, end_id), "t", most=SMALL), f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"), "pack-pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    places = pieces.sparkSession.sparkContext.broadcast(_places(plan(histogram, capacity)))
    buckets = max(64, sum(histogram.values()) // 20_000)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(buckets)))
    before = dealt.groupBy("length", "bucket").count().select("length", "bucket", (F.sum("count").over(W.partitionBy("length").orderBy("bucket")) - F.col("count")).alias("before"))
    nth = F.row_number().over(W.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32"))
    ranked = dealt.withColumn("nth", nth).join(before, ["length", "bucket"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth") - 1).alias("rank"))
    return ranked.mapInArrow(lambda batches: _placed(batches, places.value), f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
