"""The fused rule engine against its rules one by one, and streams of busy accounts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from siltrace.jobs.queries import Ledger
from siltrace.operators import rules
from siltrace.session import stored
from siltrace.sources.ledger import LEDGER, with_days
from siltrace.streaming import alerts

SF = "/root/testdata/sf0.001"
ONE_BY_ONE = {f.__name__: f for f in (rules.large_single_txn, rules.round_amount_near_threshold, rules.high_daily_velocity, rules.sudden_volume_spike)}


def make(spark, rows):
    at = lambda d: dt.datetime(2024, 1, 1, 12) + dt.timedelta(days=d) if d is not None else None
    return spark.createDataFrame([(f"T{k}", s, r, a, at(d), sar, None, None) for k, (s, r, a, d, sar) in enumerate(rows)], LEDGER)


def told(df):
    return sorted((r.account_id, str(r.date), tuple(r.triggered_rules), r.any_true_positive) for r in df.collect())


def test_declared_rules_equal_functions(spark):
    ledger = Ledger(spark, SF).ledger
    assert set(ONE_BY_ONE) == set(rules.RULES)
    got = told(rules.run_rule_engine(ledger))
    assert got and got == told(rules.run_rule_engine(ledger, ONE_BY_ONE))


def test_declared_rules_read_the_ledger_once(spark):
    at = stored(Ledger(spark, SF).ledger, "once")
    plan = rules.run_rule_engine(at)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") + plan.count("Relation[") == 1 and "Join" not in plan


def test_declared_rules_mix_with_functions_in_order(spark):
    ledger = make(spark, [("A", "B", 9500.0, 0, True), ("A", "C", 9100.0, 0, False), ("D", "B", 20.0, 1, None)])
    mixed = {"any": lambda x: with_days(x).select(F.col("receiver_id").alias("account_id"), "date", F.lit("any").alias("rule_name")), "large": rules.above(9000.0), "two": rules.busy(1)}
    assert told(rules.run_rule_engine(ledger, mixed)) == [
        ("A", "2024-01-01", ("large", "large", "two"), True),
        ("B", "2024-01-01", ("any",), True),
        ("B", "2024-01-02", ("any",), False),
        ("C", "2024-01-01", ("any",), False),
    ]


def test_nulls_and_empty_ledgers_in_the_engine(spark):
    ledger = make(spark, [(None, "B", 9500.0, 0, True), ("A", None, 9500.0, 0, False), ("A", "B", None, 1, False), ("A", "B", 9500.0, None, False)])
    both = ("large_single_txn", "round_amount_near_threshold")
    assert told(rules.run_rule_engine(ledger)) == [("A", "2024-01-01", both, False)]
    assert told(rules.run_rule_engine(ledger, ONE_BY_ONE)) == [("A", "2024-01-01", both, False)]
    assert rules.run_rule_engine(ledger.limit(0)).count() == 0
    assert told(rules.run_rule_engine(ledger, {})) == told(rules.run_rule_engine(ledger))


def test_streams_count_a_hub_and_repeats(spark):
    """One account with 3,000 neighbours, all paid twice on day 0 and a third of them again on day 2."""
    pay = spark.range(6000).select(F.concat(F.lit("T"), "id").alias("txn_id"), (F.col("id") % 3000).alias("n"), F.lit(0).alias("d"))
    again = spark.range(1000).select(F.concat(F.lit("U"), "id").alias("txn_id"), F.col("id").alias("n"), F.lit(2).alias("d"))
    last = spark.range(1).select(F.lit("Z").alias("txn_id"), F.lit(-1).cast("bigint").alias("n"), F.lit(9).alias("d"))
    rows = pay.union(again).union(last).select(
        "txn_id", F.lit("HUB").alias("sender_id"), F.concat(F.lit("N"), "n").alias("receiver_id"), F.lit(1.25).alias("amount"),
        F.timestamp_add("DAY", "d", F.lit(dt.datetime(2024, 1, 1, 12))).alias("timestamp"),
        F.lit(False).alias("is_sar"), F.lit(None).cast("string").alias("pattern_type"), F.lit(None).cast("string").alias("pattern_id"),
    )
    path = stored(rows, "hub").inputFiles()[0].rsplit("/", 1)[0]
    busy = alerts.run_to_table(alerts.velocity_alerts(alerts.ledger_stream(spark, path, 100), 999), "busy")
    assert [(r.account_id, str(r.date)) for r in busy.orderBy("date").collect()] == [("HUB", "2024-01-01"), ("HUB", "2024-01-03")]
    seen = alerts.run_to_table(alerts.sliding_degrees(alerts.ledger_stream(spark, path, 100), 1), "seen")
    hub = {r.day: (r.in_degree, r.out_degree, r.in_weight, r.out_weight) for r in seen.where("account_id = 'HUB'").collect()}
    assert hub == {0: (0, 3000, 0.0, 7500.0), 2: (0, 1000, 0.0, 1250.0)}
