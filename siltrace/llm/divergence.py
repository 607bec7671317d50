"""Source divergence audit by mergeable byte tries.

Each task counts the terms of its documents in one radix trie for each language, whose leaves
count occurrences and documents by source. A trie is held flat, in the order of its walk: a leaf
has the number of bytes that it shares with the leaf before it, the rest as its label, and its
counters; so tries are built, cut and merged by array operations. They are cut by prefix, subtries of
one prefix meet in one task and are merged there, and the walk in byte order (which is the order of
UTF-8) gives the terms that enough documents hold. A second walk streams the sums of pairs of
sources and the best terms of each source, in the order of ties. All numbers are integers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltrace.llm.words import byte_table, joined, mix, text_parts
from siltrace.session import stored

UNIT = 1_000_000_000
PREFIX = 6  # bytes of a term that choose its task
CUTS = 4  # subtries of a language for each shuffle partition
ENTRIES = 600_000  # counters that a task holds before it sends them on
MATRIX = 1 << 20  # cells of counts that are looked at together
WIDE = 1_000  # sources of a language that a task keeps pairs of
SHARED = 100_000  # groups that all tasks are told of

#: Separators of terms: all ASCII but letters; A-Z are lower-cased.
LETTERS = byte_table(bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def _binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])


def _bytes(terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The joined bytes and the starts, with the end as last, of large binaries."""
    at = np.frombuffer(terms.buffers()[1], np.int64, len(terms) + 1, terms.offset * 8)
    return np.frombuffer(terms.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def _summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted different keys, and the sums of their values."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], [np.add.reduceat(v[order], first) if len(k) else v for v in values]


@dataclass
class Trie:
    """Different terms in byte order; for each counter its term, source, occurrences and documents.

    Counters are ordered by term and source.
    """

    terms: pa.Array
    term: np.ndarray
    source: np.ndarray
    count: np.ndarray
    docs: np.ndarray

    @staticmethod
    def of(terms: pa.Array, term, source, count, docs) -> Trie:
        """From terms in any order and repeated, and counters of them."""
        coded = terms.dictionary_encode()
        order = np.asarray(pc.sort_indices(coded.dictionary)).astype(np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        width = int(source.max(initial=0)) + 1
        key, (count, docs) = _summed(place[np.asarray(coded.indices)[term]] * width + source, count, docs)
        return Trie(coded.dictionary.take(pa.array(order)), *np.divmod(key, width), count, docs)

    @staticmethod
    def merged(tries: list[Trie]) -> Trie:
        before = np.cumsum([0, *(len(t.terms) for t in tries)])
        return Trie.of(pa.concat_arrays([t.terms for t in tries]), *(np.concatenate(x) for x in zip(*((t.term + n, t.source, t.count, t.docs) for t, n in zip(tries, before)))))

    def cut(self, terms: np.ndarray) -> Trie:
        """The subtrie of some terms, given as numbers in order."""
        held = np.zeros(len(self.terms), bool)
        held[terms] = True
        mine = held[self.term]
        return Trie(self.terms.take(pa.array(terms)), np.cumsum(held)[self.term[mine]] - 1, self.source[mine], self.count[mine], self.docs[mine])

    def packed(self) -> tuple[bytes, ...]:
        """Shared bytes, label sizes and labels of the leaves, counters of each, and the counters."""
        data, at = _bytes(self.terms)
        size = np.diff(at)
        shared, same = np.zeros(len(size), np.uint8), np.arange(1, len(size))
        for j in range(255):
            same = same[np.minimum(size[same], size[same - 1]) > j]
            same = same[data[at[same] + j] == data[at[same - 1] + j]]
            if not len(same):
                break
            shared[same] += 1
        label = size - shared
        inside = np.arange(label.sum()) - np.repeat(np.cumsum(label) - label, label) + np.repeat(at[:-1] + shared, label)
        leaf = np.bincount(self.term, minlength=len(size))
        return tuple(x.tobytes() for x in (shared, label.astype(np.int32), data[inside], leaf.astype(np.int32), self.source.astype(np.int32), self.count, self.docs))

    @staticmethod
    def unpacked(shared: bytes, label: bytes, labels: bytes, leaf: bytes, source: bytes, count: bytes, docs: bytes) -> Trie:
        share = np.frombuffer(shared, np.uint8).astype(np.int64)
        own = np.frombuffer(label, np.int32).astype(np.int64)
        size = share + own
        at = np.cumsum(size) - size
        data = np.empty(size.sum(), np.uint8)
        data[np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + np.repeat(at + share, own)] = np.frombuffer(labels, np.uint8)
        for j in range(int(share.max(initial=0))):  # a shared byte is that of the last leaf whose label has it
            need = np.flatnonzero(share > j)
            last = np.maximum.accumulate(np.where(share <= j, np.arange(len(share)), 0))
            data[at[need] + j] = data[at[last[need]] + j]
        n = np.frombuffer(leaf, np.int32)
        return Trie(_binaries(data, size), np.repeat(np.arange(len(n)), n), *(np.frombuffer(x, k).astype(np.int64) for x, k in ((source, np.int32), (count, np.int64), (docs, np.int64))))

    def cuts(self, lang: str, n: int) -> np.ndarray:
        """Which of ``n`` subtries each term belongs to: a hash of the language and the first bytes."""
        data, at = _bytes(self.terms)
        code = np.full(len(self.terms), sum(x * 257**k for k, x in enumerate(lang.encode())) % 2**64, np.uint64)
        for j in range(PREFIX):
            longer = np.diff(at) > j
            code[longer] = mix(code[longer] * np.uint64(257) + data[at[:-1][longer] + j])
        return (mix(code) % np.uint64(n)).astype(np.int64)


def counted(column: pa.Array, group: np.ndarray) -> Trie:
    """The terms of some texts; a text's group stands for the source."""
    data, at = joined(column)
    low = LETTERS[data]
    inside = low != 0
    begin, last = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = at[:-1] < at[1:]
    begin[at[:-1][filled]] = inside[at[:-1][filled]]
    last[at[1:][filled] - 1] = inside[at[1:][filled] - 1]
    starts = np.flatnonzero(begin)
    coded = _binaries(low[inside], np.flatnonzero(last) + 1 - starts).dictionary_encode()
    width = max(1, len(coded.dictionary))
    doc = np.searchsorted(at, starts, "right") - 1
    key, (count,) = _summed(doc * width + np.asarray(coded.indices).astype(np.int64), np.ones(len(doc), np.int64))
    return Trie.of(coded.dictionary, key % width, group[key // width], count, np.ones(len(key), np.int64))


_SENT = "cut int, lang string, sources array<string>, shared binary, label binary, labels binary, leaf binary, source binary, count binary, docs binary"
_KEPT = "lang string, term string, sources array<string>, counts array<bigint>"


def _sent(trie: Trie, groups: list[tuple[str, str]], n: int) -> Iterator[pa.RecordBatch]:
    """The subtries of each language, from a trie over all groups."""
    langs = np.array([g[0] for g in groups], object)
    for lang in sorted({g[0] for g in groups}):
        mine = np.flatnonzero(langs == lang)
        here = np.isin(trie.source, mine)
        own = Trie(trie.terms, trie.term[here], np.searchsorted(mine, trie.source[here]), trie.count[here], trie.docs[here])
        own = own.cut(np.unique(own.term))
        cut = own.cuts(lang, n)
        order = np.argsort(cut, kind="stable")
        ends = np.flatnonzero(np.concatenate([cut[order][1:] != cut[order][:-1], [len(cut) > 0]]))
        sources = [groups[g][1] for g in mine]
        # counters by subtrie, so that each is a slice
        by = np.argsort(cut[own.term], kind="stable")
        bounds = np.searchsorted(cut[own.term][by], np.arange(n + 1))
        begin, rows = 0, []
        for end in (ends + 1).tolist():
            terms, k = order[begin:end], cut[order[begin]]
            at = by[bounds[k] : bounds[k + 1]]
            sub = Trie(own.terms.take(pa.array(terms)), np.searchsorted(terms, own.term[at]), own.source[at], own.count[at], own.docs[at])
            rows.append((int(k), lang, sources, *sub.packed()))
            begin = end
        for i in range(0, len(rows), 64):
            kinds = [pa.int32(), pa.string(), pa.list_(pa.string())] + [pa.binary()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 64]), kinds)], names=[x.split()[0] for x in _SENT.split(", ")])


def _counted(batches: Iterable[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The subtries of a partition's documents, sent on whenever they hold ``ENTRIES`` counters."""
    numbers: dict[tuple[str, str], int] = {}
    held: list[Trie] = []
    most = ENTRIES
    for batch in batches:
        group = np.fromiter((numbers.setdefault(g, len(numbers)) for g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())), np.int64, batch.num_rows)
        for i, j in text_parts(batch.column(2)):
            held.append(counted(batch.column(2).slice(i, j - i), group[i:j]))
            if sum(len(t.term) for t in held) > most:
                held = [Trie.merged(held)]
                most = max(ENTRIES, 2 * len(held[0].term))
                if len(held[0].term) > ENTRIES:
                    yield from _sent(held[0], list(numbers), n)
                    held, most = [], ENTRIES
    if held:
        yield from _sent(Trie.merged(held), list(numbers), n)


def _merged(batches: Iterable[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Merged subtries of a partition, whose rows come sorted by cut and language; terms of ``min_docs``."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for (_, lang), of in groupby(rows, key=lambda r: (r["cut"], r["lang"])):
        names: dict[str, int] = {}
        held: list[Trie] = []
        most = ENTRIES
        for r in of:
            trie = Trie.unpacked(*(r[x] for x in ("shared", "label", "labels", "leaf", "source", "count", "docs")))
            trie.source = np.array([names.setdefault(s, len(names)) for s in r["sources"]], np.int64)[trie.source]
            held.append(trie)
            if sum(len(t.term) for t in held) > most:
                held = [Trie.merged(held)]
                most = max(ENTRIES, 2 * len(held[0].term))
        trie = Trie.merged(held)
        docs = np.bincount(trie.term, trie.docs, len(trie.terms))
        trie = trie.cut(np.flatnonzero(docs >= min_docs))
        at = np.concatenate([[0], np.cumsum(np.bincount(trie.term, minlength=len(trie.terms)))])
        source = pa.array(list(names), pa.string()).take(pa.array(trie.source))
        for i in range(0, len(trie.terms), 10_000):
            here = pa.array((at[i : i + 10_001] - at[i]).astype(np.int32))
            a, b = int(at[i]), int(at[min(i + 10_000, len(trie.terms))])
            terms = trie.terms.slice(i, 10_000).cast(pa.large_string()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms)), terms, pa.ListArray.from_arrays(here, source.slice(a, b - a)), pa.ListArray.from_arrays(here, pa.array(trie.count[a:b]))], names=["lang", "term", "sources", "counts"])


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + floor(UNIT * (count + 1) / total)`` by long division, exact below 9e13."""
    high, rest = np.divmod((count + 1) * 100_000, total)
    return 1 + high * 10_000 + rest * 10_000 // total


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _pair_sums(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """For each two sources, the sum of ``apart`` over the terms, less what terms without counts give.

    Only cells with counts are looked at: they differ from the value that a count of 0 gives.
    """
    p, zero = share(counts, totals), share(np.zeros_like(totals), totals)
    base = apart(zero[:, None], zero[None])
    out = np.zeros((len(totals), len(totals)), np.int64)
    for s in range(len(totals)):
        at = np.flatnonzero(counts[:, s])
        if not len(at):
            continue
        mine, others = p[at, s, None], p[at]
        out[s] += (apart(mine, others) - base[s]).sum(0)
        alone = counts[at] == 0  # where both have counts, the other source's turn counts this cell
        out[:, s] += np.where(alone, apart(others, mine) - base[:, s], 0).sum(0)
    np.fill_diagonal(out, 0)
    return out


class _Audit:
    """Pair sums and best terms of one language, over stretches of terms in byte order."""

    def __init__(self, lang: str, groups: tuple[list[str], list[int], int], top: int):
        self.lang, (self.sources, n, v) = lang, groups
        self.totals, self.whole, self.top = np.array(n, np.int64) + v, sum(n) + v, top
        self.column = {s: i for i, s in enumerate(self.sources)}
        self.pairs = np.zeros((len(n), len(n)), np.int64)
        self.best: list[list[tuple[int, str]]] = [[] for _ in n]
        self.rows: list[tuple] = []

    def add(self, term: str, sources: list[str], counts: list[int]) -> None:
        self.rows.append((term, sources, counts))
        if len(self.rows) * len(self.sources) >= MATRIX:
            self.settle()

    def settle(self) -> None:
        if not self.rows:
            return
        self.rows.sort(key=lambda r: r[0])  # subtries follow one another by cut; code points sort as UTF-8 does
        counts = np.zeros((len(self.rows), len(self.sources)), np.int64)
        for k, (_, sources, n) in enumerate(self.rows):
            counts[k, [self.column[s] for s in sources]] = n
        self.pairs += _pair_sums(counts, self.totals)
        p, q = share(counts, self.totals), share(counts.sum(1), np.array(self.whole))
        for s, best in enumerate(self.best):
            at = np.flatnonzero((counts[:, s] > 0) & (p[:, s] > q))
            value = apart(p[at, s], q[at])
            first = np.argsort(-value, kind="stable")[: self.top]
            best += [(-int(value[k]), self.rows[at[k]][0]) for k in first]
            best.sort()
            del best[self.top :]
        self.rows.clear()

    def result(self) -> Iterator[tuple]:
        self.settle()
        for s, source in enumerate(self.sources):
            for o, other in enumerate(self.sources):
                if s != o:
                    yield self.lang, source, "pair", other, int(self.pairs[s, o])
            for value, term in self.best[s]:
                yield self.lang, source, "term", term, -value


def _audited(batches, groups: dict, top: int) -> Iterator[pa.RecordBatch]:
    def found():
        now: dict[str, _Audit] = {}
        for batch in batches:
            for lang, term, sources, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if lang not in now:
                    if sum(x.pairs.size for x in now.values()) > MATRIX:
                        for audit in now.values():
                            yield from audit.result()
                        now.clear()
                    now[lang] = _Audit(lang, groups[lang], top)
                now[lang].add(term, sources, counts)
        for audit in now.values():
            yield from audit.result()

    held = []
    for row in found():
        held.append(row)
        if len(held) == 10_000:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 4 else pa.string()) for k, c in enumerate(zip(*rows))], names=["lang", "source", "part", "item", "value"])


def _share(count, total):
    return F.expr(f"1 + cast({UNIT} as decimal(20, 0)) * ({count} + 1) div ({total})")


def _apart(p: str, q: str):
    return F.expr(f"cast(({p} - {q}) as decimal(18, 0)) * ({p} - {q}) div {q}")


def _by_join(kept: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """The same rows as ``_audited`` gives, for languages of any number of sources."""
    cells = kept.select("lang", "term", F.inline(F.arrays_zip(F.col("sources").alias("source"), F.col("counts").alias("count"))))
    each = groups.where("v > 0").select("lang", "source", (F.col("n") + F.col("v")).alias("t")).withColumn("z", _share("0", "t"))
    own = cells.join(each, ["lang", "source"]).select("lang", "term", "source", "count", "t", "z", _share("count", "t").alias("p"))
    other = each.select("lang", F.col("source").alias("item"), F.col("t").alias("t2"), F.col("z").alias("z2"))
    there = cells.select("lang", "term", F.col("source").alias("item"), F.col("count").alias("count2"))
    met = own.join(other, "lang").where("source <> item").join(there, ["lang", "term", "item"], "left").withColumn("p2", _share("coalesce(count2, 0)", "t2"))
    ahead = met.select("lang", "source", "item", (_apart("p", "p2") - _apart("z", "z2")).alias("value"))
    back = met.where("count2 is null").select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (_apart("p2", "p") - _apart("z2", "z")).alias("value"))
    pairs = ahead.union(back).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    whole = groups.groupBy("lang").agg((F.sum("n") + F.max("v")).alias("t"))
    asked = kept.select("lang", "term", F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("count")).join(whole, "lang").select("lang", "term", _share("count", "t").alias("q"))
    terms = own.join(asked, ["lang", "term"]).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart("p", "q").alias("value"))
    return pairs.union(terms)


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 3, top: int = 200, wide: int = WIDE, shared: int = SHARED) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far the sources of a language lie apart.

    A term is a run of letters or characters past ASCII, A-Z lower-cased; a language keeps those in
    ``min_docs`` of its rows. A group's share of a term is ``p = 1 + floor(UNIT * (count + 1) / (N + V))``
    with N its kept occurrences and V the language's kept terms. Part ``pair`` gives for each other
    source of the language the sum of ``floor((p - q)^2 / q)`` over all kept terms; part ``term`` gives the group's
    own terms whose share is over the language's, the ``top`` of highest value. Ranks run by value,
    then by the item's bytes.

    Null text, language and source are empty. Each row is a document, repeated rows too. A group
    without terms has rows of part ``pair``, a language of one source none; an empty table gives no rows.
    Texts are looked at whole. Other columns are not looked at.

    A task keeps sums for all pairs of a language's sources, which the result holds too. Languages of more
    than ``wide`` sources, and all if there are more than ``shared`` groups, go by joins instead.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(text_col).alias("text"))
    n = CUTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = rows.mapInArrow(lambda b: _counted(b, n), _SENT).repartition("cut").sortWithinPartitions("cut", "lang")
    kept = stored(met.mapInArrow(lambda b: _merged(b, min_docs), _KEPT), "terms")

    cells = kept.select("lang", F.inline(F.arrays_zip(F.col("sources").alias("source"), F.col("counts").alias("count"))))
    size = kept.groupBy("lang").agg(F.count("*").alias("v"))
    groups = stored(rows.select("lang", "source").distinct().join(cells.groupBy("lang", "source").agg(F.sum("count").alias("n")), ["lang", "source"], "left").join(size, "lang", "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v")), "groups")
    narrow = groups.withColumn("_s", F.count("*").over(W.partitionBy("lang"))).where(F.col("_s") <= wide)
    told: dict[str, tuple[list, list, int]] = {}
    if narrow.count() <= shared:
        for r in narrow.orderBy("lang", "source").collect():
            of = told.setdefault(r.lang, ([], [], r.v))
            of[0].append(r.source)
            of[1].append(r.n)
    known = spark.sparkContext.broadcast(told)
    direct = F.col("lang").isin(list(told))
    found = kept.where(direct).mapInArrow(lambda b: _audited(b, known.value, top), "lang string, source string, part string, item string, value bigint")
    if groups.where(~direct).limit(1).count():
        found = found.union(_by_join(kept.where(~direct), groups.where(~direct), top))
    found = stored(found, "apart")

    other = groups.select("lang", F.col("source").alias("item"), (F.col("n") + F.col("v")).alias("t2"))
    every = groups.select("lang", "source", "v", (F.col("n") + F.col("v")).alias("t")).join(other, "lang").where("source <> item")
    # a language without terms has totals of 0 and no shares
    zero = every.withColumn("p", _share("0", "greatest(t, 1)")).withColumn("q", _share("0", "greatest(t2, 1)")).select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("v") * _apart("p", "q")).alias("value"))
    pairs = zero.union(found.where("part = 'pair'")).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
