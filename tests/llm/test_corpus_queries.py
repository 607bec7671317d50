"""The numbered queries and the pipeline on the smallest tables."""

from __future__ import annotations

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltrace.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    columns = sorted(df.columns)
    rel = duck.sql(oracle_sql()[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=str)


def test_ann_recall(spark, duck):
    got: dict[int, set] = {}
    for r in queries()["op2_ann"](spark, SF).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    ids, v = zip(*duck.sql("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall())
    v = np.array(v, float)
    hits = []
    for k, i in enumerate(ids):
        if i % 20 == 0:
            s = v @ v[k]
            s[k] = -np.inf
            hits.append(len(got[i] & {ids[j] for j in np.argsort(-s, kind="stable")[:20]}) / 20)
    assert np.mean(hits) >= 0.9


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = out.collect()
        kept = {r.doc_id for r in rows}
        assert kept <= before and len(rows) == len(kept)
        if name == "line_dedup":
            assert kept == before and all(r.n_chars == len(r.text) for r in rows)
        if name == "decontamination":
            low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
            words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
            windows = set()
            for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
                w = words(r.text)
                windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))}
            dirty = {r.doc_id for r in docs.collect() if any(tuple(w[i : i + 10]) in windows for w in [words(r.text)] for i in range(len(w) - 9))}
            assert kept == before - dirty
        docs, before = spark.createDataFrame(rows, docs.schema), kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == before
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048
