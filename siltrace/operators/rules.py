"""Alert rules and the rule engine. A rule maps a ledger to ``account_id, date, rule_name`` hits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltrace.operators.graph import stretches
from siltrace.sources.ledger import both_sides, cents, normalised, with_days


def _hits(rows: DataFrame, name: str, account: str = "sender_id") -> DataFrame:
    return rows.select(F.col(account).alias("account_id"), "date", F.lit(name).alias("rule_name"))


def large_single_txn(ledger: DataFrame, threshold: float = 9000.0) -> DataFrame:
    """One hit for each transfer over ``threshold``, for its sender."""
    return _hits(with_days(ledger).where(F.col("amount") > threshold), "large_single_txn")


def round_amount_near_threshold(ledger: DataFrame, low: float = 8500.0, high: float = 9999.0) -> DataFrame:
    """One hit for each transfer from ``low`` to ``high``, for its sender."""
    return _hits(with_days(ledger).where(F.col("amount").between(low, high)), "round_amount_near_threshold")


def high_daily_velocity(ledger: DataFrame, threshold: int = 5) -> DataFrame:
    """Accounts with over ``threshold`` different counterparties on a day, either way.

    Pairs are made distinct first, so a hub's day is combined before it meets in one task.
    """
    pairs = both_sides(with_days(ledger)).select("account_id", "date", "counterparty").distinct()
    return _hits(pairs.groupBy("account_id", "date").count().where(F.col("count") > threshold), "high_daily_velocity", "account_id")


def counterparty_sketches(ledger: DataFrame, lg: int = 12) -> DataFrame:
    """``account_id, day, sketch``: a mergeable distinct-count sketch of the day's counterparties, either way.

    Of at most ``2 ** lg`` bytes whatever the count, with a relative error of about ``1.04 / sqrt(2 ** lg)``. Kept
    as a table, sketches of days answer any longer stretch without the ledger.
    """
    sides = both_sides(with_days(ledger)).where("account_id is not null and day is not null")
    return sides.groupBy("account_id", "day").agg(F.hll_sketch_agg("counterparty", lg).alias("sketch"))


def approximate_velocity(sketches: DataFrame, threshold: int = 5, days: int = 1) -> DataFrame:
    """``account_id, day, n``: active days with over ``threshold`` different counterparties, about, in the ``days`` up to them.

    The opt-in to ``high_daily_velocity`` for counts too large to be kept exactly: a day's sketch goes to each
    day that looks back on it and sketches are merged there, so a busy account costs one sketch a day.
    """
    spread = sketches.select("account_id", "sketch", "day", F.explode(F.sequence(F.col("day"), F.col("day") + days - 1)).alias("at"))
    met = spread.groupBy("account_id", "at").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"), F.max(F.col("day") == F.col("at")).alias("active"))
    return met.where(F.col("active") & (F.col("n") > threshold)).select("account_id", F.col("at").alias("day"), "n")


def confirmed_velocity(ledger: DataFrame, sketches: DataFrame, threshold: int = 5, days: int = 1) -> DataFrame:
    """``account_id, day, n``: the rows that ``approximate_velocity`` stands for, with exact counts.

    Sketches, which err once there are a few hundred counterparties, only say which accounts to count: those with a day
    of over half the threshold, far beyond any sketch's error. Of these, a counterparty adds one when a run of its days
    begins and takes it off after the run; running sums of days count without a set of counterparties.
    """
    likely = approximate_velocity(sketches, threshold // 2, days).select("account_id").distinct()
    sides = both_sides(with_days(ledger)).where("account_id is not null and day is not null").join(likely, "account_id", "left_semi")
    met = sides.select("account_id", "counterparty", "day").distinct()
    window = ledger.sparkSession.range(1).select(F.lit(days - 1).alias("w"))
    runs = stretches(met.where("counterparty is not null"), window, "account_id", "counterparty")
    change = lambda day, d: F.struct(day.alias("day"), F.lit(d).cast("bigint").alias("d"))
    changes = runs.select("account_id", F.explode(F.array(change(F.col("first"), 1), change(F.col("last") + 1, -1))).alias("e")).select("account_id", "e.*", F.lit(False).alias("active"))
    per = changes.unionByName(met.select("account_id", "day", F.lit(0).cast("bigint").alias("d"), F.lit(True).alias("active"))).groupBy("account_id", "day").agg(F.sum("d").alias("d"), F.max("active").alias("active"))
    counted = per.withColumn("n", F.sum("d").over(W.partitionBy("account_id").orderBy("day").rowsBetween(W.unboundedPreceding, 0)))
    return counted.where(F.col("active") & (F.col("n") > threshold)).select("account_id", "day", "n")


def sudden_volume_spike(ledger: DataFrame, multiplier: float = 5.0, window_days: int = 30) -> DataFrame:
    """Days on which an account sends over ``multiplier`` times the mean of its active days before.

    The mean covers days with transfers only, from ``window_days`` before to the day before;
    without any the rule is silent.
    """
    daily = with_days(ledger).groupBy("sender_id", "date", "day").agg(F.sum(cents()).alias("total"))
    before = W.partitionBy("sender_id").orderBy("day").rangeBetween(-window_days, -1)
    known = daily.withColumn("n", F.count("*").over(before)).withColumn("sum", F.sum("total").over(before))
    return _hits(known.where((F.col("n") > 0) & (F.col("total") * F.col("n") > F.col("sum") * multiplier)), "sudden_volume_spike")


@dataclass(frozen=True)
class RowRule:
    """A rule on one transfer: its sender gets a hit for each that ``meets`` (over the ledger's columns)."""

    meets: Callable[[], Column]


@dataclass(frozen=True)
class DayRule:
    """A rule on an account's day, hit at most once.

    ``meets`` may use ``n_sent`` (transfers), ``sent`` (cents), ``n_counterparties`` (either way) and ``day``,
    and windows over them, by account, that look back.
    """

    meets: Callable[[], Column]


Rule = RowRule | DayRule | Callable[[DataFrame], DataFrame]


def above(threshold: float = 9000.0) -> RowRule:
    """``large_single_txn``, declared."""
    return RowRule(lambda: F.col("amount") > threshold)


def near_threshold(low: float = 8500.0, high: float = 9999.0) -> RowRule:
    """``round_amount_near_threshold``, declared."""
    return RowRule(lambda: F.col("amount").between(low, high))


def busy(threshold: int = 5) -> DayRule:
    """``high_daily_velocity``, declared."""
    return DayRule(lambda: F.col("n_counterparties") > threshold)


def spike(multiplier: float = 5.0, window_days: int = 30) -> DayRule:
    """``sudden_volume_spike``, declared; days without a transfer sent are not active."""

    def meets() -> Column:
        before = W.partitionBy("account_id").orderBy("day").rangeBetween(-window_days, -1)
        n = F.count_if(F.col("n_sent") > 0).over(before)
        return (F.col("n_sent") > 0) & (n > 0) & (F.col("sent") * n > F.sum("sent").over(before) * multiplier)

    return DayRule(meets)


RULES: dict[str, Rule] = {"large_single_txn": above(), "round_amount_near_threshold": near_threshold(), "high_daily_velocity": busy(), "sudden_volume_spike": spike()}


def sar_account_days(ledger: DataFrame) -> DataFrame:
    """Distinct account and date of either side of labelled transfers."""
    return both_sides(with_days(normalised(ledger)).where("is_sar")).select("account_id", "date").distinct()


def _account_days(ledger: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """``account_id, date``, hits of each declared rule as ``hits_k`` (by its place) and ``touched``, from one read.

    Transfers are first combined by account, day and counterparty, so a hub's day is spread; then by account and
    day; windows run over those rows. Counterparties are kept apart only if a day rule asks.
    """
    sent = F.col("role") == "sent"
    rows = {k: r for k, r in enumerate(rules.values()) if isinstance(r, RowRule)}
    days = {k: r for k, r in enumerate(rules.values()) if isinstance(r, DayRule)}
    met = with_days(normalised(ledger))
    met = met.select("sender_id", "receiver_id", "date", "day", "is_sar", cents().alias("cents"), *[r.meets().alias(f"hits_{k}") for k, r in rows.items()])
    sums = lambda: [F.sum(f"hits_{k}").alias(f"hits_{k}") for k in rows]
    part = both_sides(met).groupBy("account_id", "date", "day", *(["counterparty"] if days else [])).agg(
        F.count_if(sent).alias("n_sent"), F.sum(F.when(sent, F.col("cents"))).alias("sent"), F.max("is_sar").alias("touched"),
        *[F.count_if(sent & F.col(f"hits_{k}")).alias(f"hits_{k}") for k in rows],
    )
    if days:
        part = part.groupBy("account_id", "date", "day").agg(F.sum("n_sent").alias("n_sent"), F.sum("sent").alias("sent"), F.max("touched").alias("touched"), F.count("*").alias("n_counterparties"), *sums())
    return part.select("account_id", "date", "touched", *[f"hits_{k}" for k in rows], *[F.coalesce(r.meets().cast("bigint"), F.lit(0)).alias(f"hits_{k}") for k, r in days.items()])


def run_rule_engine(ledger: DataFrame, rules: dict[str, Rule] | None = None) -> DataFrame:
    """One alert per account and date: ``triggered_rules`` with repeats in registry order, and
    whether the account touched a labelled transfer that date. Unsorted.

    All declared rules are one conditional aggregation over one read of the ledger. Rules that are functions from a
    ledger to hits are evaluated one by one and joined to it.
    """
    rules = rules or RULES
    days = _account_days(ledger, rules).where("account_id is not null and date is not null")
    free = None
    for k, rule in enumerate(rules.values()):
        if not isinstance(rule, (RowRule, DayRule)):
            one = rule(ledger).groupBy("account_id", "date").count().select("account_id", "date", F.struct(F.lit(k).alias("k"), F.col("count").alias("n")).alias("hit"))
            free = one if free is None else free.unionByName(one)
    if free is not None:
        found = free.groupBy("account_id", "date").agg(F.map_from_entries(F.collect_list("hit")).alias("free"))
        found = found.where("account_id is not null and date is not null")
        days = days.join(found, ["account_id", "date"], "full")
    n = lambda k, r: F.coalesce(F.col(f"hits_{k}") if isinstance(r, (RowRule, DayRule)) else F.try_element_at("free", F.lit(k)), F.lit(0)).cast("int")
    listed = F.flatten(F.array(*[F.array_repeat(F.lit(name), n(k, r)) for k, (name, r) in enumerate(rules.items())]))
    alerts = days.select("account_id", "date", listed.alias("triggered_rules"), F.coalesce("touched", F.lit(False)).alias("any_true_positive"))
    return alerts.where(F.size("triggered_rules") > 0)
