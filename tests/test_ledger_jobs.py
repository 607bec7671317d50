from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from siltrace.operators import account_day, graph, labels, metrics, profiles, rules, typologies, walks
from siltrace.operators.components import connected_components
from siltrace.sources import ledger as L


def make(spark, rows):
    """Rows of (sender, receiver, amount, days[, is_sar]); days may be fractions."""
    base = dt.datetime(2024, 1, 1)
    out = [(f"T{k}", r[0], r[1], float(r[2]), base + dt.timedelta(days=r[3]), bool(r[4]) if len(r) > 4 else False, None, None) for k, r in enumerate(rows)]
    return spark.createDataFrame(out, L.LEDGER)


def test_rule_bounds(spark):
    x = make(spark, [("A", "B", 9000, 0), ("A", "B", 9000.01, 0), ("A", "B", 8499.99, 0), ("A", "B", 8500, 0), ("A", "B", 9999, 0), ("A", "B", 9999.01, 0)])
    assert rules.large_single_txn(x).count() == 3
    assert rules.round_amount_near_threshold(x).count() == 4


def test_velocity_counts_both_ways_and_is_strict(spark):
    x = make(spark, [("A", f"B{k}", 1, 0) for k in range(3)] + [(f"C{k}", "A", 1, 0) for k in range(2)] + [("A", "B0", 1, 0)])
    assert rules.high_daily_velocity(x).count() == 0
    assert [r.account_id for r in rules.high_daily_velocity(x.union(make(spark, [("A", "Z", 1, 0)]))).collect()] == ["A"]


def test_spike_uses_active_days_before(spark):
    x = make(spark, [("A", "B", 10, 0), ("A", "B", 50, 5), ("A", "B", 151, 6), ("B", "A", 999, 0)])
    got = [r.date.isoformat() for r in rules.sudden_volume_spike(x).collect()]
    assert got == ["2024-01-07"]  # 50 is 5 times, not over; 151 > 5 * 30
    assert rules.sudden_volume_spike(make(spark, [("A", "B", 10, 0), ("A", "B", 99, 31)])).count() == 0


def test_engine_keeps_repeats_and_marks_both_sides(spark):
    x = make(spark, [("A", "B", 9500, 0), ("A", "B", 9600, 0), ("C", "D", 9500, 1, True)])
    got = {r.account_id: r for r in rules.run_rule_engine(x).collect()}
    assert got["A"].triggered_rules == ["large_single_txn"] * 2 + ["round_amount_near_threshold"] * 2
    assert not got["A"].any_true_positive and got["C"].any_true_positive
    assert {r.account_id for r in rules.sar_account_days(x).collect()} == {"C", "D"}


def test_missing_flag_and_self_transfer(spark):
    x = make(spark, [("A", "A", 9500, 0)]).drop("is_sar")
    alerts = rules.run_rule_engine(x)
    accounts = spark.createDataFrame([("A", "internal")], "account_id string, account_type string")
    row = account_day.account_days(L.with_directions(L.normalised(x), accounts), alerts).first()
    assert row.n_txns == 2 and row.counterparties == ["A"] and not row.label and row.direction_summary == {"internal": 2}


def test_account_day_without_transfers_stays(spark):
    x = L.with_directions(make(spark, [("A", "B", 5, 0)]), spark.createDataFrame([("A", "internal")], "account_id string, account_type string"))
    alerts = spark.createDataFrame([("Z", dt.date(2024, 1, 1))], "account_id string, date date")
    row = account_day.account_days(x, alerts).first()
    assert (row.total_sent, row.n_txns, row.counterparties, row.label) == (0.0, None, None, False)


def test_profiles(spark):
    x = make(spark, [("A", "B", 10, 0), ("A", "B", 30, 6), ("A", "B", 5, 7)])
    days = spark.createDataFrame([("A", dt.date(2024, 1, 7), False), ("A", dt.date(2024, 1, 8), False)], "account_id string, date date, label boolean")
    a, b = profiles.profile_features(days, x).orderBy("date").collect()
    assert (a.sent_sum_1w, a.sent_count_1w, a.sent_min_1w, b.sent_sum_1w, b.sent_sum_2w) == (40.0, 2, 10.0, 35.0, 45.0)
    assert (a.received_sum_1w, a.received_count_1w, a.received_mean_1w, a.received_sum_ratio_1d_1w) == (0.0, 0, None, None)
    assert a.sent_burst_ratio_1w == 30 / 20
    assert len(profiles.profile_features(days, x).columns) == 4 + 138
    assert profiles.lookahead_rows(days, x, "2024-01-07").count() == 0


def test_eviction_edges(spark):
    x = make(spark, [("A", "B", 1, 0)])
    t = spark.createDataFrame([("A", 30, 30), ("A", 31, 30)], "node string, at int, w int")
    got = {r.at: r.out_degree for r in graph.degrees(t, graph.incident(x)).collect()}
    assert got == {30: 1, 31: 0}


def test_neighbour_statistics_are_null_without_neighbours(spark):
    x = make(spark, [("A", "B", 2, 0), ("C", "B", 4, 0)])
    t = spark.createDataFrame([("A", 0, 5), ("Q", 0, 5)], "account_id string, day int, w int")
    got = {r.account_id: r for r in graph.degree_features(t, x).collect()}
    assert got["A"].nbr_in_degree_mean == 2 and got["A"].nbr_in_weight_max == 6.0
    assert got["Q"].out_degree == 0 and got["Q"].nbr_in_degree_mean is None


WALK = [("T1", "ILLICIT"), ("START", "A"), ("A", "B"), ("B", "C"), ("C", "ILLICIT"), ("D", "E")]


@pytest.fixture(scope="module")
def walked(spark):
    x = make(spark, [(a, b, 1, 0) for a, b in WALK])
    bad = spark.createDataFrame([("ILLICIT",)], "account_id string")
    t = spark.createDataFrame([(a, 0) for a in ("T1", "START", "NEVER", "ILLICIT")], "account_id string, day int")
    hits = walks.random_walks(t, x, bad, 1000, 50, 20)
    return {r.account_id: r for r in walks.walk_summary(t, hits, 50, start_counts=bad).collect()}


def test_direct_neighbour(walked):
    r = walked["T1"]
    assert (r.gw_min, r.gw_max, r.gw_mean, r.gw_std, r.gw_hit_rate, r.gw_n_distinct) == (1, 1, 1, 0, 1, 1)


def test_four_hops(walked):
    r = walked["START"]
    assert r.gw_min >= 4 and r.gw_max <= 20 and 0 < r.gw_hit_rate <= 1 and r.gw_n_distinct == 1


def test_isolated_and_already_illicit(walked):
    r = walked["NEVER"]
    assert (r.gw_min, r.gw_mean, r.gw_hit_rate, r.gw_n_distinct) == (None, None, 0, 0)
    assert (walked["ILLICIT"].gw_min, walked["ILLICIT"].gw_hit_rate, walked["ILLICIT"].gw_n_distinct) == (0, 1, 1)


def test_hop_distance_and_components(spark):
    x = make(spark, [(a, b, 1, 0) for a, b in WALK])
    bad = spark.createDataFrame([("ILLICIT",)], "account_id string")
    got = {r.account_id: r.distance for r in graph.hop_distances(x, bad).collect()}
    assert got == {"ILLICIT": 0, "T1": 1, "C": 1, "B": 2, "A": 3, "START": 4, "D": None, "E": None}
    comp = {r.node: r.component for r in connected_components(x, "sender_id", "receiver_id").collect()}
    assert comp["START"] == comp["T1"] == "A" and comp["E"] == "D"


def test_components_of_a_long_path_and_odd_edges(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 100), (None, 5), (3, 2)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert {got[k] for k in range(61)} == {0} and got[100] == 100
    assert connected_components(edges.where("false")).count() == 0


def test_known_components_need_no_round(spark, monkeypatch):
    from siltrace.operators import components
    from siltrace.session import stored

    tables = []
    monkeypatch.setattr(components, "stored", lambda df, name: tables.append(name) or stored(df, name))
    stars = [(k, k % 3) for k in range(30)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(stars, "src long, dst long")).collect()}
    assert got == {k: k % 3 for k in range(30)} and len(tables) == 1
    chain = [(k, k + 1) for k in range(40)] + [(50, 60), (60, 50), (70, 70)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert got == dict.fromkeys(range(41), 0) | {50: 50, 60: 50, 70: 70}


def test_roc_ties(spark):
    rows = spark.createDataFrame([(True, 0.9), (False, 0.9), (True, 0.5), (False, 0.1), (False, 0.1)], "label boolean, score double")
    pts = {(r.score, round(r.fpr, 6), round(r.tpr, 6)) for r in metrics.roc_points(rows).collect()}
    assert pts == {(None, 0, 0), (0.9, round(1 / 3, 6), 0.5), (0.5, round(1 / 3, 6), 1), (0.1, 1, 1)}
    assert abs(metrics.recall_at_fpr(metrics.roc_points(rows), 0.2).first()[0] - 0.3) < 1e-9
    assert metrics.recall_at_fpr(metrics.roc_points(rows), 1 / 3).first()[0] == 1.0
    assert abs(metrics.roc_auc(rows).first()[0] - 0.75) < 1e-9


def test_temporal_split_rounds_half_to_even(spark):
    rows = spark.createDataFrame([(f"A{k:02}", dt.date(2024, 1, 1 + k // 3)) for k in range(25)], "account_id string, date date")
    got = [r.split for r in metrics.temporal_split(rows).orderBy("date", "account_id").collect()]
    assert got == ["train"] * 15 + ["validation"] * 2 + ["test"] * 8


def test_hybrid_set(spark):
    rows = spark.createDataFrame([("A", dt.date(2024, 1, 1), True, 0.0), ("B", dt.date(2024, 1, 20), True, 0.1), ("C", dt.date(2024, 1, 20), False, 0.9), ("D", dt.date(2024, 1, 13), None, 0.25)], "account_id string, date date, label boolean, score double")
    assert {r[0] for r in labels.hybrid_illicit(rows, 7, 0.25).collect()} == {"A", "C"}


def test_typologies(spark):
    h = 1 / 24
    chain = [("A", "B", 1000, 0), ("B", "C", 950, 2 * h), ("C", "D", 900, 5 * h)]
    got = typologies.layering(make(spark, chain)).collect()
    assert [r.accounts for r in got] == [["A", "B", "C", "D"]]
    back = typologies.round_trips(make(spark, chain[:2] + [("C", "A", 900, 4)])).collect()
    assert [r.accounts for r in back] == [["A", "B", "C"]]
    mules = [(f"M{k}", "X", 9500, k / 4) for k in range(8)] + [("X", "Y", 9500 * 8 * 0.9, 7 / 4 + 1.5)]
    row = typologies.smurfing(make(spark, mules)).first()
    assert (row.collector, row.destination, row.n_mules) == ("X", "Y", 8)


def test_empty_ledger(spark):
    x = make(spark, [("A", "B", 1, 0)]).where("false")
    assert rules.run_rule_engine(x).count() == 0
    assert graph.live_edge_counts(x, 3).count() == 0
    assert typologies.layering(x).count() == 0
    assert L.until(x, "2024-01-02").select(F.col("txn_id")).count() == 0
