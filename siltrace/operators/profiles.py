"""Trailing-window profiles of account-days."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltrace.sources.ledger import both_sides, cents, until, with_days

WINDOWS = {"1d": 1, "1w": 7, "2w": 14, "1mo": 30, "2mo": 60}
STATS = ("sum", "count", "min", "max", "mean")
ROLES = ("sent", "received")


def of_accounts(ledger: DataFrame, targets: DataFrame) -> DataFrame:
    """Both sides of transfers of the target accounts."""
    return both_sides(with_days(ledger)).join(targets.select("account_id").distinct(), "account_id", "left_semi")


def daily_totals(sides: DataFrame) -> DataFrame:
    """``account_id, role, day, s, n, lo, hi``: cents of each day."""
    return sides.withColumn("_c", cents()).groupBy("account_id", "role", "day").agg(F.sum("_c").alias("s"), F.count("*").alias("n"), F.min("_c").alias("lo"), F.max("_c").alias("hi"))


def trailing(daily: DataFrame, targets: DataFrame, windows: dict[str, int] | None = None) -> DataFrame:
    """Stats of each window at target days: ``account_id, role, day`` and ``<stat>_<window>``.

    A window of w days ends with the day itself. All frames share one sort; their input is a
    row per account, role and day, so a hub costs as many rows as days.
    """
    windows = windows or WINDOWS
    zero = targets.select("account_id", "day").distinct().withColumn("role", F.explode(F.array(*map(F.lit, ROLES))))
    zero = zero.select("account_id", "role", "day", F.lit(0).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("lo"), F.lit(None).cast("bigint").alias("hi"), F.lit(True).alias("t"))
    rows = daily.withColumn("t", F.lit(False)).unionByName(zero).groupBy("account_id", "role", "day").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bool_or("t").alias("t"))
    out = []
    for name, w in windows.items():
        frame = W.partitionBy("account_id", "role").orderBy("day").rangeBetween(-(w - 1), 0)
        s, n = F.sum("s").over(frame), F.sum("n").over(frame)
        out += [(s / 100).alias(f"sum_{name}"), n.alias(f"count_{name}"), (F.min("lo").over(frame) / 100).alias(f"min_{name}"), (F.max("hi").over(frame) / 100).alias(f"max_{name}"), F.when(n > 0, s / n / 100).alias(f"mean_{name}")]
    return rows.select("account_id", "role", "day", "t", *out).where("t").drop("t")


def compared(role: str, windows: dict[str, int]) -> list:
    """Ratios and differences of the first window to the longer ones, and burst ratios."""
    first, *longer = windows
    col = lambda s, w: F.col(f"{role}_{s}_{w}")
    out = []
    for s in STATS:
        for w in longer:
            out += [(col(s, first) / F.nullif(col(s, w), F.lit(0))).alias(f"{role}_{s}_ratio_{first}_{w}"), (col(s, first) - col(s, w)).alias(f"{role}_{s}_diff_{first}_{w}")]
    return out + [(col("sum", first) / F.nullif(col("mean", w), F.lit(0))).alias(f"{role}_burst_ratio_{w}") for w in longer]


def profile_features(account_day: DataFrame, ledger: DataFrame, windows: dict[str, int] | None = None) -> DataFrame:
    """``account_id, date, label`` and 69 columns for each direction."""
    windows = windows or WINDOWS
    targets = account_day.select("account_id", "date", "label").withColumn("day", F.datediff("date", F.lit("2024-01-01").cast("date")))
    rows = trailing(daily_totals(of_accounts(ledger, targets)), targets, windows)
    names = [f"{s}_{w}" for w in windows for s in STATS]
    pivot = rows.groupBy("account_id", "day").agg(*[F.max(F.when(F.col("role") == r, F.col(c))).alias(f"{r}_{c}") for r in ROLES for c in names])
    own = [f"{r}_{c}" for r in ROLES for c in names]
    return targets.join(pivot, ["account_id", "day"], "left").select("account_id", "date", "day", "label", *own, *[c for r in ROLES for c in compared(r, windows)])


def lookahead_rows(account_day: DataFrame, ledger: DataFrame, cutoff: str) -> DataFrame:
    """Rows up to the cutoff whose profiles change when later transfers are known; none if sound."""
    early = account_day.where(F.col("date") <= F.lit(cutoff).cast("date"))
    a, b = profile_features(early, ledger), profile_features(early, until(ledger, cutoff))
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def chosen_features(importances: DataFrame, share: float = 0.9) -> DataFrame:
    """``feature, importance, rank``: the smallest prefix whose share of importance reaches ``share``.

    Negative importances count as 0; if all do, every feature is chosen. The table has a row
    per feature, so one window task holds it whatever the data's size.
    """
    clipped = importances.select("feature", F.greatest("importance", F.lit(0.0)).alias("importance"))
    order = W.orderBy(F.desc("importance"), "feature")
    run = clipped.withColumn("rank", F.row_number().over(order)).withColumn("_run", F.sum("importance").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("_all", F.sum("importance").over(W.partitionBy()))
    below = F.sum((F.col("_run") / F.col("_all") < share).cast("int")).over(W.partitionBy())
    return run.withColumn("_k", F.when(F.col("_all") > 0, below + 1)).where(F.col("_k").isNull() | (F.col("rank") <= F.col("_k"))).select("feature", "importance", "rank")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
