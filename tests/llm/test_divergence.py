from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from siltrace.llm import divergence as D

SCHEMA = "text string, lang string, source string, term string, value int"


def _brute(rows, least=3, top=200):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(low))) for text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        held = Counter(t for x, _, w in docs if x == lang for t in set(w))
        kept = sorted(t for t, n in held.items() if n >= least)
        sources = sorted({s for x, s, _ in docs if x == lang})
        count = {s: Counter(t for x, o, w in docs if x == lang and o == s for t in w if t in kept) for s in sources}

        def share(c):
            total = sum(c.values()) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        p, q = {s: share(count[s]) for s in sources}, share(sum(count.values(), Counter()))
        for s in sources:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                for k, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode())), 1):
                    if part == "pair" or k <= top:
                        out.add((lang, s, part, item, value, k))
    return out


def _rows(seed):
    rng = random.Random(seed)
    words = ["a", "ab", "abc", "abcd", "abcde", "abd", "Über", "über", "naïve", "日本", "日本語", "x1y", "B", "İ", "\U0001f600z", "don't"]
    rows = []
    for _ in range(90):
        text = " ".join(rng.choices(words, k=rng.randrange(0, 25))) if rng.random() > 0.1 else rng.choice([None, "", "12 34 !"])
        rows.append((text, rng.choice(["en", "en", "fr", None, "x"]), rng.choice(["s0", "s1", None, "s2", "é"])))
    return rows + [rows[3]] * 4 + [("nur hier", "de", "s9"), (None, "leer", "s1"), (None, "leer", "s2"), ("a " * 3000, "en", "s0")]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force_on_either_way(spark, seed):
    rows = _rows(seed)
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(5)
    want = _brute(rows)
    for limits in ({}, {"wide": 3}, {"shared": 2}):
        assert {tuple(r) for r in D.divergence(docs, **limits).collect()} == want
    assert {tuple(r) for r in D.divergence(docs, min_docs=1, top=2).collect()} == _brute(rows, 1, 2)


def _audit(rows, parts, cuts):
    """Occurrences by language, term and source, through packed subtries of ``parts`` partitions."""
    sent = []
    for k in range(parts):
        mine = rows[k::parts]
        batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in mine], pa.string()) for i in (1, 2, 0)], names=["l", "s", "t"])
        sent += [r for b in D._counted([batch.slice(0, 7), batch.slice(7)], cuts) for r in b.to_pylist()]
    sent.sort(key=lambda r: (r["cut"], r["lang"]))
    table = pa.RecordBatch.from_pylist(sent)
    return [r for b in D._merged([table], 1) for r in b.to_pylist()]


def test_partitions_cuts_and_small_tries_change_nothing(monkeypatch):
    rows = [(t, lang or "", source or "") for t, lang, source in _rows(3)]
    plain = lambda found: {(r["lang"], r["term"]): dict(zip(r["sources"], r["counts"])) for r in found}
    one = _audit(rows, 1, 1)
    want = plain(one)
    assert len(want) == len(one) and want[("en", "a")]["s0"] > 3000
    for lang in {k[0] for k in want}:
        walk = [r["term"].encode() for r in one if r["lang"] == lang]
        assert walk == sorted(walk)
    monkeypatch.setattr(D, "ENTRIES", 3)
    for parts, cuts in ((4, 1), (5, 16)):
        got = _audit(rows, parts, cuts)
        assert plain(got) == want and len(got) == len(want)


def test_trie_packs_walks_and_merges():
    rng = random.Random(4)
    terms = ["".join(rng.choices("abé日", k=rng.randrange(1, 9))).encode() for _ in range(500)] + [b"a" * 300, b"a" * 299 + b"b", b"a" * 400]
    source = [rng.randrange(3) for _ in terms]
    count = Counter(zip(terms, source))
    whole = D.Trie.of(pa.array(terms, pa.large_binary()), np.arange(len(terms)), np.array(source), np.ones(len(terms), int), np.full(len(terms), 2))
    halves = [D.Trie.of(pa.array(terms[i:j], pa.large_binary()), np.arange(j - i), np.array(source[i:j]), np.ones(j - i, int), np.full(j - i, 2)) for i, j in ((0, 200), (200, len(terms)))]
    for trie in (whole, D.Trie.unpacked(*whole.packed()), D.Trie.merged(halves), D.Trie.merged([D.Trie.unpacked(*h.packed()) for h in halves])):
        walk = trie.terms.to_pylist()
        assert walk == sorted(set(terms))
        assert {(walk[t], s): n for t, s, n in zip(trie.term, trie.source, trie.count)} == count
        assert (trie.docs == 2 * trie.count).all()
    some = np.arange(0, len(whole.terms), 3)
    assert whole.cut(some).terms.to_pylist() == whole.terms.to_pylist()[::3]
    shared = np.frombuffer(whole.packed()[0], np.uint8)
    assert shared.max() == 255 and len(whole.packed()[2]) < sum(map(len, set(terms)))


def test_large_counts_stay_exact():
    for count, total in [(0, 1), (0, 5), (9 * 10**13 - 2, 9 * 10**13), (123456789012, 99999999999999)]:
        assert D.share(np.array([count]), np.array([total]))[0] == 1 + 10**9 * (count + 1) // total


def test_empty_table(spark):
    assert D.divergence(spark.createDataFrame([], SCHEMA)).collect() == []
