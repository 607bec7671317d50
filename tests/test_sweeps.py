"""Running sums, hop graphs and walks against plain Python on made ledgers."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from siltrace.operators import graph, rules, typologies, walks
from siltrace.sources import ledger as L

T0 = dt.datetime(2024, 1, 1)


def _ledger(spark, rows):
    return spark.createDataFrame([(f"T{k:06}", s, r, a, T0 + dt.timedelta(seconds=t), False, None, None) for k, (s, r, a, t) in enumerate(rows)], L.LEDGER)


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(11)
    rows = [(f"A{rng.randrange(9)}", f"A{rng.randrange(9)}", round(rng.uniform(1, 99), 2), rng.randrange(40) * 86400 + rng.randrange(86400)) for _ in range(400)]
    return rows, _ledger(spark, rows).cache()


def test_degrees_of_any_windows_equal_brute_force(spark, made):
    rows, ledger = made
    targets = [(f"A{k}", day, w) for k in range(10) for day in (0, 3, 17, 39, 60) for w in (0, 1, 5, 30)]
    got = {(r.node, r.at, r.w): (r.in_degree, r.out_degree, round(r.in_weight, 2), round(r.out_weight, 2)) for r in graph.degrees(spark.createDataFrame(targets, "node string, at int, w int"), graph.incident(ledger)).collect()}
    near = {(r.node, r.at, r.w, r.nbr) for r in graph.neighbours(spark.createDataFrame(targets, "node string, at int, w int"), graph.incident(ledger)).collect()}
    seen = set()
    for node, at, w in targets:
        live = [(s, r, a) for s, r, a, t in rows if at - w <= t // 86400 <= at]
        sent, came = [x for x in live if x[0] == node], [x for x in live if x[1] == node]
        assert got[node, at, w] == (len({s for s, _, _ in came}), len({r for _, r, _ in sent}), round(sum(x[2] for x in came), 2), round(sum(x[2] for x in sent), 2))
        seen |= {(node, at, w, x) for x in {s for s, _, _ in came} | {r for _, r, _ in sent}}
    assert near == seen


def test_degree_features_read_the_ledger_once(spark, made, tmp_path):
    made[1].write.parquet(str(tmp_path / "ledger"))
    ledger = spark.read.parquet(str(tmp_path / "ledger"))
    t = spark.createDataFrame([("A1", 20, 7), ("none", 3, 7)], "account_id string, day int, w int")
    got = graph.degree_features(t, ledger)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ledger" not in plan and plan.count("Exchange hashpartitioning") <= 6
    assert {r.account_id: r.nbr_in_degree_mean is None for r in got.collect()} == {"A1": False, "none": True}


SMURF = {"low": 10.0, "high": 90.0, "min_mules": 3, "days": 4, "forward": (0.05, 0.6), "forward_days": (1, 2)}


def test_smurfing_equals_brute_force(spark, made):
    rows, ledger = made
    extra = [("A1", "A2", 50.0, 500_000), ("A1", "A2", 50.0, 500_000), ("A1", "A2", 20.0, 500_000 + 4 * 86400), ("A1", "A2", 20.0, 500_001 + 8 * 86400)]
    rows = rows + extra
    ids = [(f"T{k:06}", s, r, round(a * 100), t) for k, (s, r, a, t) in enumerate(rows) if s != r]
    want = set()
    for i, _, r, c, t in ids:
        frame = [x for x in ids if x[2] == r and t - 4 * 86400 <= x[4] <= t and 1000 <= x[3] <= 9000]
        n, pool = len({x[1] for x in frame}), sum(x[3] for x in frame)
        if 1000 <= c <= 9000 and n >= 3:
            want |= {(r, f[2], n, pool, f[3], i, f[0]) for f in ids if f[1] == r and 86400 <= f[4] - t <= 172800 and 50 * pool <= f[3] * 1000 <= 600 * pool}
    got = typologies.smurfing(_ledger(spark, rows), **SMURF)
    assert {(x.collector, x.destination, x.n_mules, round(x.pool * 100), round(x.forward_amount * 100), x.last_payment_txn, x.forward_txn) for x in got.collect()} == want and want


def test_a_hub_of_100000_payments_spreads(spark):
    n = 100_000
    pay = spark.range(n).select(F.format_string("P%06d", "id").alias("txn_id"), F.concat(F.lit("S"), F.col("id") % 5000).alias("sender_id"), F.lit("HUB").alias("receiver_id"), F.lit(50.0).alias("amount"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 100).alias("timestamp"), F.lit(False).alias("is_sar"), F.lit(None).cast("string").alias("pattern_type"), F.lit(None).cast("string").alias("pattern_id"))
    out = pay.where("txn_id = 'P050000'").withColumns({"txn_id": F.lit("OUT"), "sender_id": F.lit("HUB"), "receiver_id": F.lit("END"), "amount": F.lit(200_000.0), "timestamp": F.timestamp_seconds(F.lit(1704067200) + 50_000 * 100 + 86400)})
    found = typologies.smurfing(pay.union(out), **SMURF | {"min_mules": 3000, "forward": (0.9, 1.2)})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "RangeFrame" not in plan
    rows = found.collect()
    assert {r.n_mules for r in rows} == {3457} and {r.pool for r in rows} == {3457 * 50.0}
    assert "P050000" in {r.last_payment_txn for r in rows} and len(rows) == 865


def _hops(ids):
    return [(a, b) for a in ids for b in ids if b[1] == a[2] and 3600 <= b[4] - a[4] <= 172800 and 900 * a[3] <= 1000 * b[3] <= 970 * a[3]]


@pytest.fixture(scope="module")
def passing(spark):
    rng, rows = random.Random(5), []
    for _ in range(60):
        a, t, path = rng.uniform(50, 90), rng.randrange(20 * 86400), [f"B{rng.randrange(8)}" for _ in range(6)]
        for s, r in zip(path, path[1:]):
            rows.append((s, r, round(a, 2), t))
            a, t = a * rng.uniform(0.9, 0.97), t + rng.randrange(3600, 100_000)
        rows.append((path[3], path[0], round(rows[-3][2] * 0.93, 2), rows[-3][3] + 5 * 86400))
    ids = [(f"T{k:06}", s, r, round(a * 100), t) for k, (s, r, a, t) in enumerate(rows) if s != r]
    return ids, _ledger(spark, rows).cache()


def test_layering_and_round_trips_equal_brute_force(spark, passing):
    ids, ledger = passing
    hops = _hops(ids)
    level, every = [[(x,) for x in ids]], []
    for _ in range(4):
        level.append([(*c, b) for c in level[-1] for a, b in hops if a == c[-1] and b[2] not in {c[0][1], *(x[2] for x in c)}])
    simple = lambda c: len({c[0][1], *(x[2] for x in c)}) == len(c) + 1
    every = {tuple(x[0] for x in c) for part in level for c in part if simple(c)}
    want = {c for c in every if 2 <= len(c) <= 5 and (len(c) == 5 or not any(len(d) == len(c) + 1 and (d[:-1] == c or d[1:] == c) for d in every))}
    graph_ = typologies.hops(ledger)
    found = typologies.layering(ledger, graph=graph_)
    assert found._jdf.queryExecution().executedPlan().toString().count("Join") <= 6
    assert {tuple(r.txns) for r in found.collect()} == want and len({len(c) for c in want}) > 2
    trips = {(*(x[0] for x in c), b[0]) for part in level[:3] for c in part if simple(c) for b in ids if b[1] == c[-1][2] and b[2] == c[0][1] and 3 * 86400 <= b[4] - c[-1][4] <= 21 * 86400 and 900 * c[-1][3] <= 1000 * b[3] <= 970 * c[-1][3]}
    assert {tuple(r.txns) for r in typologies.round_trips(ledger, graph=graph_).collect()} == trips and trips


def test_fans_equal_brute_force(spark, passing):
    ids, ledger = passing
    legs = [(a, b) for a, b in _hops(ids) if b[2] != a[1]]
    want = set()
    for a, _ in legs:
        mine = [(x, y) for x, y in legs if x[1] == a[1] and 0 <= x[4] - a[4] <= 4 * 86400]
        mids, ends = {x[2] for x, _ in mine}, {y[2] for _, y in mine}
        if len(mids) >= 2 and len(ends) <= 4:
            want.add((a[1], a[0], len(mids), len(ends), 1704067200 + max(y[4] for _, y in mine)))
    got = typologies.fan_out_fan_in(ledger, min_intermediates=2, max_destinations=4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan
    assert {(r.source, r.anchor_txn, r.n_intermediates, r.n_destinations, r.last_ts) for r in got.collect()} == want and want


def test_walks_of_both_kinds_agree_and_large_days_are_refused(spark, made):
    _, ledger = made
    targets = spark.createDataFrame([(f"A{k}", day) for k in range(9) for day in (8, 25)] + [("alone", 8)], "account_id string, day int")
    bad = spark.createDataFrame([("A3",), ("A4",)], "account_id string")
    plain = lambda df: sorted(tuple(r) for r in df.select("account_id", "day", "walk", "length", "hit").collect())
    steps = plain(walks.random_walks(targets, ledger, bad, 2, 6, 5))
    assert steps == plain(walks.day_walks(targets, ledger, bad, 2, 6, 5)) and len(steps) > 50
    with pytest.raises(ValueError, match="random_walks"):
        walks.day_walks(targets, ledger, bad, 2, largest=10)


def test_unreached_accounts_have_no_distance(spark):
    edges = _ledger(spark, [("a", "b", 1.0, 0), ("b", "c", 1.0, 0), ("x", "y", 1.0, 0)])
    got = {r.account_id: r.distance for r in graph.hop_distances(edges, spark.createDataFrame([("a",), ("z",)], "account_id string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "x": None, "y": None, "z": 0}


def test_sketches_of_days_stay_within_their_error(spark):
    sizes = {f"H{k}": 400 * 2**k for k in range(7)}
    rows = None
    for name, n in sizes.items():  # half of each day's counterparties come again on the next day
        one = spark.range(n).select(F.concat(F.lit(f"{name}-"), F.col("id") % (n * 3 // 4)).alias("receiver_id"), F.lit(name).alias("sender_id"), F.timestamp_seconds(F.lit(1704067200) + F.floor(F.col("id") * 3 / n) * 86400).alias("timestamp"))
        rows = one if rows is None else rows.union(one)
    sketches = rules.counterparty_sketches(rows.withColumn("amount", F.lit(1.0)))
    exact = {n: size * 3 // 4 for n, size in sizes.items()}
    got = {r.account_id: r.n for r in rules.approximate_velocity(sketches, 200, 3).where("account_id like 'H_' and day = 2").collect()}
    assert set(got) == set(exact)
    assert all(abs(got[k] - n) <= 3 * 1.04 / 64 * n for k, n in exact.items())
    assert rules.approximate_velocity(sketches, 10**6, 3).count() == 0
    one = {(r.account_id, r.day) for r in rules.approximate_velocity(sketches, 100, 1).where("account_id like 'H_'").collect()}
    assert one == {(k, d) for k in sizes for d in range(3)}
