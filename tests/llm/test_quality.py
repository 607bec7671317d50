from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest

from siltrace.llm import quality as Q

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labelled(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return docs.select("doc_id", "text"), labels.select("doc_id", "quality")


@pytest.fixture(scope="module")
def model(labelled):
    return Q.train(*labelled)


def test_held_out_rows_are_told_apart(labelled, model):
    docs, labels = labelled
    rows = Q.quality(docs, model).join(labels, "doc_id").collect()
    held = [(r._quality, r.quality) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(y for _, y in held) > 50 and sum(1 - y for _, y in held) > 5
    assert all(s >= 0.3 for s, y in held if y) and sum(s >= 0.3 for s, y in held if not y) <= 1


def test_score_equals_the_average_of_all_features(model):
    text = "Some words, some WORDS!! again again " + "z" * 200
    total = n = 0
    for w in Q.pieces(text):
        chars = "\x02" + w + "\x03"
        at, _ = Q.slots([w])
        assert len(at) == sum(max(0, len(chars) - g + 1) for g in Q.GRAMS) + 1
        total, n = total + int(model.weights[at].sum()), n + len(at)
    want = 1 / (1 + math.exp(-(total / Q.FIXED / (n + Q.PRIOR) + model.bias)))
    assert Q._scores([text], model)[0] == pytest.approx(want, rel=1e-12)


def test_slots_do_not_depend_on_the_other_words():
    words = ["a", "word", "naïve", "日本語", "x" * Q.LONGEST, "\x01", "$$$"]
    at, n = Q.slots(words)
    each = np.split(at, np.cumsum(n)[:-1])
    for w, got in zip(words, each):
        assert got.tolist() == Q.slots([w])[0].tolist()


def test_repeats_make_words():
    assert Q.pieces("a a b a a a").count(Q.AGAIN) == 3 and Q.pieces(None) == Q.pieces(" \n") == []


def test_nulls_long_texts_other_columns_and_partitions(spark, model):
    words = random.Random(7).choices(["the", "and", "of", "in"], k=60_000)
    long = " ".join(words)
    rows = [(1, None, "a", 0.5), (2, "", "b", None), (3, " \n", None, 1.0), (None, long, "c", 0.0), (4, long, "c", 0.0), (4, long, "c", 0.0), (5, "x" * 100_000, "d", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, _quality double")
    got = Q.quality(docs.repartition(3), model)
    assert got.columns == ["doc_id", "text", "score", "_quality"]
    scores: dict = {}
    for r in got.collect():
        scores.setdefault(r.doc_id, []).append(r._quality)
    assert scores[1] == scores[2] == scores[3] == pytest.approx([1 / (1 + math.exp(-model.bias))])
    assert len(set(scores[4] + scores[None])) == 1 and len(scores[4]) == 2
    assert scores == {k: v for k, v in scores.items() if all(0 <= x <= 1 for x in v)}
    shuffled = " ".join(sorted(words))
    assert Q._scores([long], model)[0] > 0.5 > Q._scores([shuffled], model)[0]  # equal neighbours tell
    assert Q.quality(docs.limit(0), model).collect() == []


def test_tables_without_rows_or_with_one_label(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, "c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r._quality < 0.01 for r in Q.quality(docs, Q.train(docs, none)).collect())
    assert all(r._quality < 0.01 for r in Q.quality(docs, Q.train(docs.limit(0), none)).collect())
    good = spark.createDataFrame([(1, 1), (1, None), (None, 1), (3, 7)], "doc_id long, quality int")
    assert all(r._quality > 0.99 for r in Q.quality(docs, Q.train(docs, good)).collect())


def test_held_out_labels_are_not_used(labelled, model):
    docs, labels = labelled
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(Q.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = Q.train(docs, turned)
    assert (again.weights == model.weights).all() and again.bias == model.bias
