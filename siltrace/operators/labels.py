"""Labels that settle late: recent windows, pseudo labels and hybrid illicit sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_recent(scored: DataFrame, delay_days: int) -> DataFrame:
    """``recent``: the last ``delay_days + 1`` dates of the table. One row is broadcast."""
    last = scored.agg(F.max("date").alias("_last"))
    return scored.crossJoin(F.broadcast(last)).withColumn("recent", F.col("date") >= F.date_sub("_last", delay_days)).drop("_last")


def pseudo_labels(scored: DataFrame, delay_days: int, threshold: float) -> DataFrame:
    """``account_id, date, pseudo_label`` of recent rows: is the score over ``threshold``?"""
    return with_recent(scored, delay_days).where("recent").select("account_id", "date", (F.col("score") > threshold).alias("pseudo_label"))


def hybrid_illicit(scored: DataFrame, delay_days: int, threshold: float) -> DataFrame:
    """Accounts with a real label on older rows or a pseudo label on recent ones."""
    real = F.coalesce("label", F.lit(False)) & ~F.col("recent")
    pseudo = F.col("recent") & (F.col("score") > threshold)
    return with_recent(scored, delay_days).where(real | pseudo).select("account_id").distinct()


def hybrid_sets(scored: DataFrame, delays: list[int], thresholds: list[float]) -> DataFrame:
    """``delay, threshold, account_id``: ``hybrid_illicit`` for each cell of the grid, in one pass."""
    last = F.broadcast(scored.agg(F.max("date").alias("_last")))
    grid = F.array(*[F.struct(F.lit(d).alias("delay"), F.lit(float(t)).alias("threshold")) for d in delays for t in thresholds])
    rows = scored.crossJoin(last).withColumn("g", F.explode(grid)).select("*", "g.*")
    recent = F.col("date") >= F.date_sub("_last", F.col("delay"))
    member = (F.coalesce("label", F.lit(False)) & ~recent) | (recent & (F.col("score") > F.col("threshold")))
    return rows.where(member).select("delay", "threshold", "account_id").distinct()


def pseudo_alignment(scored: DataFrame, delays: list[int], thresholds: list[float]) -> DataFrame:
    """How pseudo labels agree with real ones for each delay and threshold of the grid.

    The grid is a short list in the program; each scored row meets it in one pass.
    """
    last = F.broadcast(scored.agg(F.max("date").alias("_last")))
    grid = F.array(*[F.struct(F.lit(d).alias("delay"), F.lit(float(t)).alias("threshold")) for d in delays for t in thresholds])
    rows = scored.crossJoin(last).withColumn("g", F.explode(grid)).where(F.col("date") >= F.date_sub("_last", F.col("g.delay")))
    p, y = F.col("score") > F.col("g.threshold"), F.coalesce("label", F.lit(False))
    count = lambda c: F.sum(c.cast("bigint"))
    got = rows.groupBy(F.col("g.delay").alias("delay"), F.col("g.threshold").alias("threshold")).agg(F.count("*").alias("n_recent"), count(p).alias("n_pseudo"), count(y).alias("n_real"), count(p & y).alias("_b"))
    return got.select("delay", "threshold", "n_recent", "n_pseudo", "n_real", (F.col("_b") / F.nullif("n_pseudo", F.lit(0))).alias("precision"), (F.col("_b") / F.nullif("n_real", F.lit(0))).alias("recall"))


def hybrid_growth(scored: DataFrame, delays: list[int], threshold: float) -> DataFrame:
    """Size of the hybrid set and real positives in the window, by delay."""
    last = F.broadcast(scored.agg(F.max("date").alias("_last")))
    rows = scored.crossJoin(last).withColumn("delay", F.explode(F.array(*map(F.lit, delays)))).withColumn("recent", F.col("date") >= F.date_sub("_last", F.col("delay")))
    y = F.coalesce("label", F.lit(False))
    member = (y & ~F.col("recent")) | (F.col("recent") & (F.col("score") > threshold))
    return rows.groupBy("delay").agg(F.countDistinct(F.when(member, F.col("account_id"))).alias("hybrid_size"), F.sum((F.col("recent") & y).cast("bigint")).alias("recent_real"))
