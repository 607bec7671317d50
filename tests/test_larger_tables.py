"""Results that only larger tables or busier accounts show."""

from __future__ import annotations

import datetime as dt
import random
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siltrace.jobs.oracles import oracle_sql
from siltrace.jobs import queries
from siltrace.jobs.queries import REGISTRY
from siltrace.llm import ann
from siltrace.operators import metrics, models, walks
from siltrace.sources.ledger import LEDGER
from siltrace.streaming import alerts


def _sql(folder, name, columns):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    return sorted(con.sql(f"SELECT {columns} FROM ({oracle_sql()[name]})").fetchall())


def test_velocity_of_a_week_stays_exact_for_a_hub(spark, tmp_path):
    """A hub with over 1,000 counterparties in a week, where sketches err, against the query's SQL."""
    n = F.col("id")
    events = spark.range(9000).select(
        n.alias("event_id"), F.timestamp_seconds(F.lit(1704067200) + (n % 25) * 86400).alias("ts"), (n % 6000 + 100).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"),
        F.concat(F.lit('{"k": '), F.when(n % 3 > 0, 7).otherwise(n % 40).cast("string"), F.lit("}")).alias("props"),
    )
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(tuple(r) for r in REGISTRY["r3_approximate_velocity"](spark, str(tmp_path)).select("account_id", "day", "n").collect())
    assert got == _sql(tmp_path, "r3_approximate_velocity", "account_id, day, n") and max(r[2] for r in got) > 1000


def test_days_too_large_for_a_worker_are_walked_by_joins(spark):
    rng, t0 = random.Random(3), dt.datetime(2024, 1, 1)
    rows = [(f"T{k}", f"A{rng.randrange(9)}", f"A{rng.randrange(9)}", 5.0, t0 + dt.timedelta(days=min(rng.randrange(60), 30)), False, None, None) for k in range(300)]
    ledger = spark.createDataFrame(rows, LEDGER).cache()
    targets = spark.createDataFrame([(f"A{k}", day) for k in range(9) for day in (6, 25, 31)] + [("A1", 90)], "account_id string, day int")
    bad = spark.createDataFrame([("A3",), ("A4",)], "account_id string")
    plain = lambda df: sorted(tuple(r) for r in df.select("account_id", "day", "walk", "length", "hit").collect())
    want = plain(walks.random_walks(targets, ledger, bad, 2, 6, 5))
    assert len({r[1] for r in want}) == 3
    with pytest.raises(ValueError, match="random_walks"):  # day 31 holds most edges
        walks.day_walks(targets, ledger, bad, 2, 6, 5, largest=50)
    for largest in (0, 50, 2_000_000):
        assert plain(walks.day_walks(targets, ledger, bad, 2, 6, 5, largest=largest, join_larger=True)) == want


@pytest.mark.parametrize("kind", ["float", "double"])
def test_shards_and_blocks_meet_without_a_shuffle_of_pairs(spark, monkeypatch, kind):
    """40 shards by 15 blocks, which were 600 copies of graphs in a shuffle, find what brute force finds."""
    monkeypatch.setattr(ann, "SHARD", 75)
    monkeypatch.setattr(ann, "BLOCK", 10)
    x = np.random.default_rng(1).normal(size=(3000, 8)).astype(np.float32 if kind == "float" else np.float64)
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)] + [(9000, [1.0] * 5), (9001, [2.0] * 5)]
    found = ann.nearest(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>"), F.col("id") % 20 == 0, k=20)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "CoGroup" not in plan
    got: dict[int, list] = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert [i for i, _ in got.pop(9000)] == [9001] and len(got) == 150
    right = 0
    for q, near in got.items():
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        assert all(abs(s[i] - v) < 1e-9 for i, v in near)
        right += len({i for i, _ in near} & {i for i in np.argsort(-s) if i != q and s[i] >= near[-1][1] - 1e-12})
        assert sorted(s[[i for i in range(3000) if i != q]])[-20:][0] <= near[-1][1] + 1e-9
    assert right == 3000


@pytest.mark.parametrize("kind", ["glm", "boosted"])
def test_ablation_prepares_its_rows_once(spark, monkeypatch, kind):
    """Recalls are those of models trained one by one on rows of their own, but medians are taken once for all fits."""
    rng = random.Random(2)
    made = [(k % 3 == 0, ("train", "validation", "test")[k // 3 % 3], k % 3 + rng.uniform(0, 3), rng.random(), None if k % 4 else 1.0) for k in range(360)]
    rows = spark.createDataFrame(made, "label boolean, split string, told double, noise double, holes double").cache()
    splits = {s: rows.where(F.col("split") == s) for s in ("train", "validation", "test")}
    draw = {"glm": {"regularisation": "l2", "c": 0.09}, "boosted": {"depth": 2, "rounds": 2, "leaf": 5}}[kind]
    monkeypatch.setattr(models, "drawn", lambda kind, n: [draw, draw][:n])
    sets, fits, fit = {"a": ["told", "holes"], "b": ["noise", "told"]}, [], models.Imputer.fit
    want = {}
    for name, features in sets.items():
        found = models.scored(models.train(splits["train"], features, kind, draw), splits["test"], features)
        want[name] = metrics.recall_at_fpr(metrics.roc_points(found)).first()[0]
    monkeypatch.setattr(models.Imputer, "fit", lambda *a, **k: fits.append(1) or fit(*a, **k))
    got = {r.name: r.recall for r in models.ablation(splits, sets, kind, trials=2).collect()}
    assert {k: round(v, 6) for k, v in got.items()} == {k: round(v, 6) for k, v in want.items()} and len(fits) == (kind == "glm")


def test_degrees_by_tables_equal_those_by_state(spark, tmp_path):
    """Three batches whose days overlap, with rows for days that are closed, against one state row for each window."""
    rng, t0 = random.Random(8), dt.datetime(2024, 1, 1)
    for n, days in enumerate(([0, 1, 2, 3], [0, 2, 3, 4, 6], [5, 6, 9, 12])):
        rows = [(f"T{n}-{k}", f"A{rng.randrange(5)}", f"A{rng.randrange(5)}", round(rng.uniform(1, 9), 2), t0 + dt.timedelta(days=rng.choice(days), minutes=rng.randrange(1440)), False, None, None) for k in range(60)]
        spark.createDataFrame(rows, LEDGER).coalesce(1).write.mode("append").parquet(str(tmp_path / "came"))
        time.sleep(1.1)
    source = lambda: alerts.ledger_stream(spark, str(tmp_path / "came"), 1)
    plain = lambda df: sorted(tuple(r) for r in df.select("account_id", "day", "in_degree", "out_degree", F.round("in_weight", 2), F.round("out_weight", 2)).collect())
    want = plain(alerts.run_to_table(alerts.sliding_degrees(source(), 2), "state"))
    assert plain(alerts.closed_degrees(source(), 2)) == want and {r[1] for r in want} == {0, 1, 2, 3, 4, 5, 6, 9}


@pytest.mark.parametrize("name", ["s2_velocity_stream", "s4_sliding_degrees_stream", "s5_late_rows"])
def test_stretches_of_many_files_are_one_trigger_each(spark, monkeypatch, name):
    monkeypatch.setattr(queries, "ROWS_A_FILE", 300)
    sf = "/root/testdata/sf0.001"
    found = REGISTRY[name](spark, sf)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    columns = ", ".join(found.columns)
    rows = lambda got: sorted(tuple(round(v, 2) if isinstance(v, float) else v for v in r) for r in got)
    assert rows(found.collect()) == rows(con.sql(f"SELECT {columns} FROM ({oracle_sql()[name]})").fetchall())
