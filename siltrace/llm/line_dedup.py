"""Line deduplication over content-defined chunks of lines, in DataFrame functions only.

A hash of each line feeds a rolling hash over the last two lines. A chunk of lines starts where
the rolling hash is smaller than its neighbours, so boundaries depend on the lines around them
and not on what was inserted further up, no chunk between two boundaries is a single line, and
most have two to five. Chunks that occur again anywhere are removed after their bytes are compared
with the occurrence that stays. A removed chunk is then widened, line by line, to the lines
beside it that repeat too, and where no whole chunk lies in a passage, repeated lines side by
side go if they have over ``PASSAGE_WORDS`` words together.

``passage_dedup`` is another way to find passages alone, by a window of lines from every line on.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltrace.session import discard, stored

PASSAGE_WORDS = 50
_TOP = 1 << 32


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("bigint")


def _word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.translate(text, "\r\t", "  "), " "), lambda x: x != "")).cast("bigint")


def _most_words(text: Column) -> Column:
    """No fewer than the words of a line, and quick; 0 for a blank line."""
    bare = text
    for blank in (" ", "\t", "\r"):
        bare = F.replace(bare, F.lit(blank), F.lit(""))
    return _bound(F.octet_length(bare), lambda n: F.when(n == 0, 0).otherwise(F.octet_length(text) - n + 1).cast("bigint"))


def _bound(value: Column, f) -> Column:
    """``f(value)`` with ``value`` made once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def _units(text: Column) -> Column:
    """Chunks of several lines, then single lines: ``j, n`` the first line's number and how many
    lines, ``a`` the first one's place in the text, ``w`` words of a single line, and ``t`` the text.

    Lines without a word are not numbered and in no unit, so copies may differ in them.
    """
    split = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(x.alias("t"), i.alias("i"), _most_words(x).alias("w")))
    marked = F.transform(F.filter(split, lambda x: x["w"] > 0), lambda x, j: F.struct(x["t"].alias("t"), x["i"].alias("a"), j.alias("j"), x["w"].alias("w"), _line_hash(x["t"]).alias("h")))

    def cut(m: Column) -> Column:
        rolling = F.transform(m, lambda x, j: F.when(j == 0, F.lit(_TOP)).otherwise((F.get(m, j - 1)["h"] * 31 + x["h"]) % _TOP))
        least = lambda r, j: (j == 0) | ((F.get(r, j) < F.get(r, j - 1)) & (F.get(r, j) <= F.coalesce(F.get(r, j + 1), F.lit(_TOP))))
        starts = _bound(rolling, lambda r: F.filter(F.transform(m, lambda x, j: j), lambda j: least(r, j)))
        chunks = _bound(starts, lambda s: F.transform(s, lambda a, k: F.slice(m, a + 1, F.coalesce(F.get(s, k + 1), F.size(m)) - a)))
        unit = lambda x, n, w, t: F.struct(x["j"].alias("j"), n.alias("n"), x["a"].alias("a"), w.alias("w"), t.alias("t"))
        whole = F.transform(F.filter(chunks, lambda c: F.size(c) > 1), lambda c: unit(F.get(c, 0), F.size(c), F.lit(0).cast("bigint"), F.array_join(F.transform(c, lambda x: x["t"]), "\n")))
        return F.concat(whole, F.transform(m, lambda x: unit(x, F.lit(1), x["w"], x["t"])))

    return _bound(marked, cut)


def _gone(own: Column, marks: Column, words: int) -> Column:
    """Ranges ``a, b`` of lines that go, in order, by the marks whose bytes equal the row's ``own`` units.

    Marked lines with none but blank lines between them are a run, which goes if it holds a
    chunk or over ``words`` words.
    """
    same = _bound(own, lambda o: F.filter(marks, lambda x: x["t"] == F.get(o, x["k"])["t"]))
    entries = F.array_sort(F.transform(same, lambda x: F.struct(x["j"].alias("j"), (x["n"] > 1).alias("c"), x["a"].alias("a"), x["w"].alias("w"))))

    def runs(e: Column) -> Column:
        starts = F.filter(F.transform(e, lambda x, k: k), lambda k: (k == 0) | (F.get(e, k)["j"] - F.get(e, k - 1)["j"] > 1))
        cut = _bound(starts, lambda s: F.transform(s, lambda a, q: F.slice(e, a + 1, F.coalesce(F.get(s, q + 1), F.size(e)) - a)))
        whole = F.filter(cut, lambda r: F.exists(r, lambda x: x["c"]) | (F.aggregate(r, F.lit(0).cast("bigint"), lambda n, x: n + x["w"]) > words))
        return F.transform(whole, lambda r: F.struct(F.get(r, 0)["a"].alias("a"), F.element_at(r, -1)["a"].alias("b"), F.size(F.filter(r, lambda x: x["c"])).alias("c")))

    return _bound(entries, runs)


def _without(lines: Column, gone: Column) -> Column:
    """The lines outside of the ranges, joined."""

    def parts(g: Column) -> Column:
        since = lambda k: F.coalesce(F.get(g, k - 1)["b"] + 1, F.lit(0))

        def kept(m: Column) -> Column:
            return F.concat(F.flatten(F.transform(g, lambda x, k: F.slice(m, since(k) + 1, x["a"] - since(k)))), F.slice(m, F.element_at(g, -1)["b"] + 2, F.size(m)))

        return _bound(lines, kept)

    return F.array_join(_bound(gone, parts), "\n")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = PASSAGE_WORDS) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text_col``, plus ``_n_chunks`` and ``_n_removed``.

    Chunks and lines count across all documents and within one. The occurrence with the
    smallest id (then the smallest text hash and place) stays. Of every other one whose bytes
    equal it, chunks go with the repeated lines around them, and so do runs of repeated lines of
    over ``words`` words; blank lines inside a run go with it, and a lone repeated line of fewer
    words stays. A unit that shares only its hash stays. ``_n_chunks`` counts the chunks and
    ``_n_removed`` the lines taken out. Rows with equal id and text are one document, so they
    keep or lose the same lines; a null id sorts last. Null texts stay null and empty texts
    empty; texts of any length are read whole. A text may become empty; no row is dropped.
    Columns of ``docs`` named like the two counters are replaced, all others kept.

    Counting shuffles hashes only. The texts are shuffled once, by row, for both joins, and the
    text of kept occurrences is sent once to each row that repeats it.
    """
    taken = {c.lower() for c in docs.columns}

    def free(name: str) -> str:
        while name in taken:
            name += "_"
        return name

    row_key, own_at, marks_at, gone_at = map(free, ("_row_key", "_own", "_marks", "_gone"))
    # 128 bits of the row's content name it; the order of precedence is id, then this key
    key = F.struct(F.xxhash64(F.col(id_col), F.col(text_col)).alias("p"), F.xxhash64(F.lit(1), F.col(text_col), F.col(id_col)).alias("q"))
    rows = docs.drop("_n_chunks", "_n_removed").withColumn(row_key, key)
    place = docs.where(F.col(text_col).isNotNull()).select(F.struct(F.col(id_col).isNull().alias("z"), F.col(id_col).alias("i"), key.alias("key")).alias("r"), _units(F.col(text_col)).alias("c"))
    hashed = F.transform("c", lambda x, k: F.struct(k.alias("k"), x["j"].alias("j"), x["n"].alias("n"), x["a"].alias("a"), x["w"].alias("w"), F.xxhash64(x["t"]).alias("h"), F.xxhash64(F.lit(1), x["t"]).alias("g")))
    spots = stored(place.select("r", F.explode(hashed).alias("x")).select("r", "x.*"), "line-spots")  # read twice; making them costs more than reading them
    many = spots.groupBy("h", "g").count().where("count > 1").drop("count")
    some = stored(spots.join(many, ["h", "g"]), "line-some")
    discard(spots)
    # equal rows are one document: the smallest and largest spot of a hash differ if it repeats
    spot = F.struct("r", "k")
    seen = stored(some.groupBy("h", "g").agg(F.min(spot).alias("first"), F.max(spot).alias("last")).where("first <> last").select("h", "g", F.col("first.r.key").alias("home"), F.col("first.k").alias("at")), "line-seen")
    # rows where something can go: a chunk, or enough words in single lines
    repeated = some.select(F.col("r.key").alias("key"), "k", "j", "n", "a", "w", "h", "g").join(seen, ["h", "g"]).where((F.col("key") != F.col("home")) | (F.col("k") != F.col("at"))).drop("home", "at")
    listed = repeated.distinct().groupBy("key").agg(F.max("n").alias("most"), F.sum("w").alias("all"), F.collect_list(F.struct("k", "j", "n", "a", "w", "h", "g")).alias("e"))
    wanted = stored(listed.where((F.col("most") > 1) | (F.col("all") > words)).select("key", F.explode("e").alias("x")).select("key", "x.*"), "line-wanted")
    discard(some)

    # every column that can be hashed is named in the condition, which always holds: it keeps
    # this branch from reading fewer columns than the last join, so Spark shuffles the rows once
    others = F.xxhash64(*[F.col(f"`{f.name}`") for f in rows.schema if f.name not in (row_key, text_col) and not re.search("map<|variant", f.dataType.simpleString())], F.lit(0))
    homes = seen.join(wanted.select("h", "g").distinct(), ["h", "g"]).groupBy(F.col("home").alias(row_key)).agg(F.collect_list(F.struct("h", "g", "at")).alias(own_at))
    texts = (
        rows.join(homes, row_key)
        .select(F.col(row_key).alias("home"), F.col(own_at).alias("own"), _units(F.when(others.isNotNull(), F.col(text_col))).alias("c"))
        .select("home", F.explode(_bound(F.col("c"), lambda c: F.transform("own", lambda o: F.struct(o["h"].alias("h"), o["g"].alias("g"), F.get(c, o["at"])["t"].alias("t"))))).alias("o"))
        .select("o.h", "o.g", "o.t")
        .distinct()
        .withColumn("w", F.when(F.col("t").contains("\n"), 0).otherwise(_word_count(F.col("t"))))
    )
    marks = wanted.drop("w").join(texts, ["h", "g"]).groupBy(F.col("key").alias(row_key)).agg(F.collect_list(F.struct("k", "j", "n", "a", "w", "t")).alias(marks_at))
    gone = F.when(F.col(marks_at).isNotNull(), _gone(_units(F.col(text_col)), F.col(marks_at), words))
    changed = rows.join(marks, row_key, "left").withColumn(gone_at, gone)
    text = F.when(F.size(gone_at) > 0, _without(F.split(text_col, "\n", -1), F.col(gone_at))).otherwise(F.col(text_col))
    total = lambda f: F.coalesce(F.aggregate(gone_at, F.lit(0).cast("bigint"), lambda n, x: n + f(x)), F.lit(0).cast("bigint"))
    return changed.select(*[text.alias(c) if c == text_col else F.col(c) for c in rows.columns if c != row_key], total(lambda x: x["c"]).alias("_n_chunks"), total(lambda x: x["b"] - x["a"] + 1).alias("_n_removed"))


def _windows(text: Column, words: int) -> Column:
    """For each line with a word, ``a, b, h``: the fewest lines from it on with over ``words`` words.

    ``a`` and ``b`` are the first and last line's places, ``h`` is the hash of the lines in
    between that have a word. Lines with too few words after them have no window.
    """
    count = lambda t: F.size(F.filter(F.split(F.translate(t, "\r\t", "  "), " "), lambda x: x != "")).cast("long")
    marked = F.filter(F.transform(F.split(text, "\n", -1), lambda t, k: F.struct(t.alias("t"), k.alias("k"), count(t).alias("w"))), lambda x: x["w"] > 0)
    none = F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).alias("n"))

    def cut(m: Column) -> Column:
        def at(x: Column, i: Column) -> Column:
            more = lambda a, y: F.when(a["s"] > words, a).otherwise(F.struct((a["s"] + y["w"]).alias("s"), (a["n"] + 1).alias("n")))
            n = F.aggregate(F.slice(m, i + 1, words + 1), none, more, lambda a: F.when(a["s"] > words, a["n"]))
            whole = lambda n: F.array_join(F.transform(F.slice(m, i + 1, n), lambda y: y["t"]), "\n")
            # a one-element array binds the number of lines once for both uses
            return F.get(F.transform(F.array(n), lambda n: F.when(n.isNotNull(), F.struct(x["k"].alias("a"), F.get(m, i + n - 1)["k"].alias("b"), F.sha2(whole(n).cast("binary"), 256).alias("h")))), 0)

        return F.filter(F.transform(m, at), lambda x: x.isNotNull())

    return F.get(F.transform(F.array(marked), cut), 0)


def passage_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = PASSAGE_WORDS) -> DataFrame:
    """``docs`` without repeated passages of over ``words`` words, plus ``_n_passage_lines`` removed.

    A passage is a run of whole lines. Blank lines don't count: copies may differ in them, and
    those inside a passage go with it. All repeats but the one with the smallest id (then the
    smallest text hash and position) go, also within a document. Windows are equal if their
    SHA-256 is; their bytes aren't shipped. Equal rows, null ids, null and empty texts, and
    columns named like the counter are treated as by ``line_dedup``; no row is dropped.

    Hashes and places are shuffled, and the texts once.
    """
    taken = {c.lower() for c in docs.columns}

    def free(name: str) -> str:
        while name in taken:
            name += "_"
        return name

    row_key, runs_at = free("_row_key"), free("_runs")
    own_key = F.xxhash64(F.col(id_col), F.col(text_col), F.length(text_col))
    key = F.struct(F.col(id_col).isNull().alias("z"), F.col(id_col).alias("i"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"))
    rows = docs.drop("_n_passage_lines").withColumn(row_key, own_key)
    spots = docs.where(F.col(text_col).isNotNull()).select(key.alias("r"), own_key.alias("_key"), F.explode(_windows(F.col(text_col), words)).alias("x"))
    spots = stored(spots.select("r", "_key", "x.a", "x.b", F.unhex("x.h").alias("h")), "passage-spots")
    seen = spots.groupBy("h").agg(F.min(F.struct("r", "_key", "a")).alias("first"), F.max(F.struct("r", "_key", "a")).alias("last")).where("first <> last").select("h", F.col("first._key").alias("home"), F.col("first.a").alias("at"))
    again = spots.select("_key", "a", "b", "h").join(seen, "h").where((F.col("_key") != F.col("home")) | (F.col("a") != F.col("at"))).select("_key", "a", "b").distinct()
    # windows that overlap become one run, so a line is compared with few of them
    before = W.partitionBy("_key").orderBy("a").rowsBetween(W.unboundedPreceding, -1)
    starts = again.withColumn("_s", F.coalesce(F.col("a") > F.max("b").over(before), F.lit(True)).cast("long"))
    runs = starts.withColumn("_run", F.sum("_s").over(W.partitionBy("_key").orderBy("a").rowsBetween(W.unboundedPreceding, 0))).groupBy("_key", "_run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    marks = runs.groupBy(F.col("_key").alias(row_key)).agg(F.collect_list(F.struct("a", "b")).alias(runs_at))
    joined = rows.join(marks, row_key, "left")
    lines = F.split(text_col, "\n", -1)
    stays = F.filter(lines, lambda t, k: ~F.exists(F.col(runs_at), lambda x: (k >= x["a"]) & (k <= x["b"])))
    text = F.when(F.col(runs_at).isNull(), F.col(text_col)).otherwise(F.array_join(stays, "\n"))
    gone = F.aggregate(F.coalesce(F.col(runs_at), F.array().cast("array<struct<a:int,b:int>>")), F.lit(0).cast("bigint"), lambda n, x: n + x["b"] - x["a"] + 1)
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in rows.columns if c != row_key], gone.alias("_n_passage_lines"))


def full_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``passage_dedup``, then ``line_dedup`` for shorter chunks of what is left."""
    return line_dedup(stored(passage_dedup(docs, id_col, text_col), "passages"), id_col, text_col)
