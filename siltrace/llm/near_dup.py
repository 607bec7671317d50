"""MinHash near-duplicates with tensored banding.

A plain index with T tables of 2r minhashes each needs 2rT minhashes. Here two collections of
m short keys (r minhashes each) are computed, and table (i, j) is keyed by the pair of the
i-th key of one and the j-th key of the other: m*m tables from 2mr minhashes. A pair of
similarity s meets in some table with probability (1 - (1 - s**r)**m)**2, which is 0.9996 for
s = 0.8 with the defaults and over 0.99999 from s = 0.85.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltrace.llm.arrow import SMALL, in_text_parts
from siltrace.llm.words import SPACE, joined, mix, words
from siltrace.operators.components import connected_components
from siltrace.session import discard, small_batches, stored

_K = np.uint64(0xA0761D6478BD642F)


def _sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle codes of each text, joined, and the number of each text."""
    data, at = joined(column)
    codes, _, _, first = words(data, at, SPACE)
    counts = np.diff(first)
    short = (counts > 0) & (counts < k)
    n = np.where(counts >= k, counts - k + 1, short.astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(n)])
    where = np.arange(starts[-1]) - np.repeat(starts[:-1], n) + np.repeat(first[:-1], n)
    length = np.repeat(np.minimum(counts, k), n)
    h = length.astype(np.uint64)
    for j in range(k):
        more = length > j
        h[more] = mix(h[more] * _K + codes[where[more] + j])
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a > 1:
            h[a:b].sort()
    fresh = np.ones(len(h), bool)
    fresh[1:] = h[1:] != h[:-1]
    fresh[starts[:-1][n > 0]] = True
    sizes = np.diff(np.concatenate([[0], np.cumsum(fresh)])[starts])
    return h[fresh], sizes


_HIGH, _LOW = 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3


def _code(h: np.ndarray, at: np.ndarray, salt: int) -> np.ndarray:
    """A code of each whole set, which begin at ``at``."""
    return np.add.reduceat(mix(h ^ np.uint64(salt)), at)


def _keys(h: np.ndarray, sizes: np.ndarray, m: int, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each non-empty set: two codes of the whole set and 2m short keys."""
    at = (np.cumsum(sizes) - sizes)[sizes > 0]
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros((0, 2 * m), np.uint64)
    hi, lo = (_code(h, at, c) for c in (_HIGH, _LOW))
    rng = np.random.default_rng(1789)
    keys = np.empty((len(at), 2 * m), np.uint64)
    for i in range(2 * m):
        key = np.full(len(at), i + 1, np.uint64)
        for _ in range(r):
            a, b = (np.uint64(x) for x in rng.integers(1, 2**63, 2, dtype=np.uint64))
            key = mix(key * _K + np.minimum.reduceat((h * (a * np.uint64(2) + np.uint64(1))) ^ (h >> np.uint64(29)) * b, at))
        keys[:, i] = key
    return hi, lo, keys


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values.view(np.int64)))


def _signature(batch: pa.RecordBatch, k: int, m: int, r: int) -> pa.RecordBatch:
    h, sizes = _sets(batch.column(1), k)
    hi, lo, keys = _keys(h, sizes, m, r)
    some = sizes > 0
    n = len(sizes)
    full_hi, full_lo = np.zeros(n, np.int64), np.zeros(n, np.int64)
    full_hi[some], full_lo[some] = hi.view(np.int64), lo.view(np.int64)
    each = np.where(some, m, 0)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int64)), pa.array(full_hi), pa.array(full_lo), _lists(np.ascontiguousarray(keys[:, :m]).ravel(), each), _lists(np.ascontiguousarray(keys[:, m:]).ravel(), each)], names=["id", "n", "hi", "lo", "a", "b"])


FILTER_BITS = 26
SALTS = 16


def _bitmap(ids: DataFrame) -> np.ndarray:
    """One bit for each hash of ``id``, in 8 MB whatever the number of ids."""
    bit = (F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS)) + 1).alias("h")
    parts = ids.select(bit).groupBy(F.bitmap_bucket_number("h").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("m"))
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for b, m in parts.collect():
        out[(b - 1) * len(m) : b * len(m)] = np.frombuffer(m, np.uint8)
    return out


def _whole(batch: pa.RecordBatch, k: int, wanted: np.ndarray) -> pa.RecordBatch:
    """The sets of rows whose bit is set; the exact ids are joined afterwards."""
    bit = np.asarray(batch.column(2), np.int64)
    some = batch.filter(pa.array((wanted[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1))
    h, sizes = _sets(some.column(1), k)
    code = np.zeros(len(sizes), np.int64)
    if len(h):
        code[sizes > 0] = _code(h, (np.cumsum(sizes) - sizes)[sizes > 0], _HIGH).view(np.int64)
    return pa.RecordBatch.from_arrays([some.column(0), pa.array(code), _lists(h, sizes)], names=["i", "k", "s"])


def _joined(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A sort-merge join: a broadcast takes a job, a thread and blocks of 4 MB of the driver, however small its table."""
    return left.join(right.hint("merge"), on, how)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``x, y`` whose whole sets reach ``percent`` of their union."""
    sx, sy = (sets.select(F.col("id").alias(c), F.col("s").alias(f"s{c}")) for c in "xy")
    shared = F.size(F.array_intersect("sx", "sy"))
    return _joined(_joined(pairs, sx, "x"), sy, "y").where(shared * 100 >= (F.size("sx") + F.size("sy") - shared) * percent).select("x", "y")


def _beside_pivot(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``x, y`` with one pivot ``b`` and different components ``c`` that can reach ``percent``.

    A prefix join: two sets of n and k codes reach the limit only if they share at least
    (n + k) * percent / (100 + percent) codes, so with all codes in one order they share a
    code among the first ``n - ceil(n * percent / 100) + 1`` of each. In the order of a pivot,
    codes outside of the pivot's set come before those in it, then codes that only one
    component holds, then rare codes before common ones. Codes of one component take up their places but
    are never joined on, and what a family has in common comes last, so it is hardly ever a
    key. Sets whose prefix lies outside of the pivot never spread their other codes. Sizes,
    places of the shared code and the overlap with the pivot rule out further pairs in the
    join; no pair that reaches the limit is lost. The pivot is the smallest id of a key's most
    common component.
    """
    p = percent
    star = sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    met = _joined(_joined(rows, sets.select(F.col("id").alias("x"), "s"), "x"), star, "b")
    known = met.select("b", "x", "c", F.size("s").alias("n"), F.array_except("s", "sb").alias("own"), "s").withColumn("u", F.size("own")).withColumn("m", F.col("n") - F.ceil(F.col("n") * p / 100) + 1)
    inside = F.when(F.col("u") < F.col("m"), F.array_except("s", "own")).otherwise(F.array().cast("array<bigint>"))
    tagged = F.concat(F.transform("own", lambda t: F.struct(F.lit(0).alias("g"), t.alias("t"))), F.transform(inside, lambda t: F.struct(F.lit(1).alias("g"), t.alias("t"))))
    known = stored(known.select("b", "x", "c", "n", "u", "m", tagged.alias("codes")), "near-beside")
    code = known.select("b", "x", "c", "n", "u", "m", F.explode("codes").alias("e")).select("b", "x", "c", "n", "u", "m", "e.g", "e.t")
    open_codes = code.groupBy("b", "t").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("many")).where("c0 < c1").select("b", "t", "many")
    by_set = W.partitionBy("b", "x")
    placed = _joined(code, open_codes, ["b", "t"]).withColumn("nth", F.row_number().over(by_set.orderBy("g", "many", "t"))).withColumn("o", F.count_if(F.col("g") == 0).over(by_set)).withColumn("i", F.count("*").over(by_set) - F.col("o"))
    # places among all codes of the set: those of one component come first on either side of the pivot
    own_place, inside_place = F.col("u") - F.col("o") + F.col("nth"), F.col("n") - F.col("i") + F.col("nth") - F.col("o")
    first = placed.withColumn("at", F.when(F.col("g") == 0, own_place).otherwise(inside_place)).where("at <= m").select("b", "t", "x", "c", "n", "u", "at")
    other = first.select("b", "t", F.col("x").alias("y"), F.col("c").alias("d"), F.col("n").alias("k"), F.col("u").alias("v"), F.col("at").alias("bt"))
    least = (F.col("n") + F.col("k")) * p
    alike = F.least("n", "k") * 100 >= F.greatest("n", "k") * p
    after = (F.least(F.col("n") - F.col("at"), F.col("k") - F.col("bt")) + 1) * (100 + p) >= least
    outside = (F.least(F.col("n") - F.col("u"), F.col("k") - F.col("v")) + F.least("u", "v")) * (100 + p) >= least
    both = _joined(first, other, ["b", "t"]).where((F.col("x") < F.col("y")) & (F.col("c") != F.col("d")) & alike & after & outside)
    return both.select("x", "y").distinct()


def _labelled(rows: DataFrame, labels: DataFrame, column: str, out: str) -> DataFrame:
    named = labels.select(F.col("node").alias(column), F.col("component").alias("_c"))
    return _joined(rows, named, column, "left").withColumn(out, F.coalesce("_c", column)).drop("_c")


def _as_links(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("node").alias("x"), F.col("component").alias("y"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, m: int = 12, r: int = 3) -> DataFrame:
    """``id, n_shingles, component_id, kept`` for each row of ``docs``.

    Words lie between white space, A-Z lower-cased; a text's set holds its distinct runs of
    ``shingle`` words, or the whole sequence if it has fewer. Texts without words, null texts
    and rows with a null id are linked with nothing (a null id has a null component and is
    not kept). Rows with equal ids share a component; where their texts differ, each
    text keeps its own ``n_shingles`` and links of its own. The
    component is the smallest id reachable over links of at least ``percent`` of the union. Texts are looked
    at whole, however long; other columns are not looked at, and an empty table gives no rows.

    Equal sets are merged before the search, so a group of copies costs one row. In each
    table a row is compared with the table key's smallest id only. Rows of keys that
    still hold several components are then compared across components by an exact prefix
    join over rare codes, so what a large group has in common makes no pairs. Every link is
    confirmed on the whole sets of 64-bit shingle codes.
    """
    small_batches(docs.sparkSession)
    two = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kind = two.schema["id"].dataType.simpleString()
    found = stored(two.mapInArrow(in_text_parts(lambda b: _signature(b, shingle, m, r), "t", most=SMALL), f"id {kind}, n bigint, hi bigint, lo bigint, a array<bigint>, b array<bigint>"), "near-sig")
    some = found.where("n > 0 and id is not null")
    # a class of equal sets is named by its smallest id and the set's code, as one id may hold several sets, and the set's size;
    # rows meet their class by a salt, so a large group of copies lies in SALTS tasks
    salted = some.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    part = salted.groupBy("hi", "lo", "n", "salt").agg(F.min("id").alias("i"))
    classes = stored(part.groupBy("hi", "lo", "n").agg(F.min("i").alias("i"), F.collect_set("salt").alias("salts")).select(F.struct("i", F.col("hi").alias("k"), "n").alias("x"), "hi", "lo", "n", "salts"), "near-classes")
    spread = classes.select("x", "hi", "lo", "n", F.explode("salts").alias("salt"))
    member = stored(_joined(salted, spread, ["hi", "lo", "n", "salt"]).select("id", "x", "salt", F.expr("if(id = x.i, a, null) a"), F.expr("if(id = x.i, b, null) b")), "near-member")
    reps = member.where("a is not null").select("x", "a", "b")
    # keys of either collection that two rows share; then the rows left with keys of both
    single = reps.select("x", F.explode(F.concat("a", "b")).alias("key"))
    shared = single.groupBy("key").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where("lo < hi").select("key")
    left = _joined(single, shared, "key").groupBy("x").agg(F.collect_set("key").alias("keys"))
    kept = stored(_joined(reps, left, "x").select("x", F.array_intersect("a", "keys").alias("a"), F.array_intersect("b", "keys").alias("b")).where("size(a) > 0 and size(b) > 0"), "near-keys")
    met = F.explode(F.expr("flatten(transform(a, p -> transform(b, q -> xxhash64(p, q))))")).alias("key")
    table = kept.select("x", met)
    first = table.groupBy("key").agg(F.min("x").alias("y"), F.max("x").alias("top")).where("y < top").select("key", "y")
    stars = stored(_joined(table, first, "key").where("x <> y").select("x", "y").distinct(), "near-stars")
    ids = stars.select(F.explode(F.array("x", "y")).alias("id"))
    wanted = two.sparkSession.sparkContext.broadcast(_bitmap(ids.select(F.col("id.i").alias("id"))))
    hashed = two.where("id is not null").withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS)))
    whole = hashed.mapInArrow(in_text_parts(lambda b: _whole(b, shingle, wanted.value), "t", most=SMALL), f"i {kind}, k bigint, s array<bigint>")
    named = F.struct("i", "k", F.size("s").cast("bigint").alias("n")).alias("id")
    sets = stored(_joined(whole.select(named, "s"), ids.distinct(), "id", "left_semi").groupBy("id").agg(F.max("s").alias("s")), "near-sets")
    wanted.destroy()

    near = stars.where(F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent)
    labels = stored(connected_components(_confirmed(near.groupBy("x").agg(F.min("y").alias("y")), sets, percent), "x", "y"), "near-labels")
    apart = _labelled(_labelled(near, labels, "x", "cx"), labels, "y", "cy").where("cx <> cy").select("x", "y")
    # components so far are stars, so rounds are only spent on what the new links join
    old, labels = labels, stored(connected_components(_as_links(labels).union(_confirmed(apart, sets, percent)), "x", "y"), "near-labels")
    discard(old)
    split = _labelled(kept, labels, "x", "c").select("x", "c", met)
    open_keys = split.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("key")
    common = _joined(split, open_keys, "key").groupBy("key", "c").count().groupBy("key").agg(F.max(F.struct("count", "c"))["c"].alias("b"))
    # every pivot has several components, as each of its keys has
    rest = stored(_joined(split, common, "key").select("b", "x", "c").distinct(), "near-rest")
    cross = _confirmed(_joined(_beside_pivot(rest, sets, percent), stars, ["x", "y"], "left_anti"), sets, percent)
    # an id with several sets links their classes
    own = member.select("id", "x")
    several = own.groupBy("id").agg(F.min("x").alias("y"), F.max("x").alias("top")).where("y < top").select("id", "y")
    old, labels = labels, connected_components(_as_links(labels).union(cross).union(_joined(own, several, "id").select("x", "y").where("x <> y")), "x", "y")
    discard(old, rest, stars, sets, kept)

    of = _joined(classes, labels.select(F.col("node").alias("x"), F.col("component.i").alias("c")), "x").select("x", "c", F.explode("salts").alias("salt"))
    label = _joined(member, of, ["x", "salt"]).select(F.col("id").alias("_id"), "c").union(own.select("id", "x.i")).groupBy("_id").agg(F.min("c").alias("c"))
    out = found.select("id", "n").join(label.hint("merge"), F.col("id") == F.col("_id"), "left")
    component = F.coalesce("c", "id")
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that are not kept; of rows with one id all stay or go."""
    gone = near_duplicates(docs, id_col, text_col, **options).where(f"not kept and id is not null").select(F.col("id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
