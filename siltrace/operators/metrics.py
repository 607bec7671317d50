"""Splits and metrics of scored rows (``label`` boolean, ``score`` double)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def temporal_split(rows: DataFrame, train: float = 0.6, validation: float = 0.1) -> DataFrame:
    """``split`` by row count in order of date and account, cut points rounded half to even.

    Ranks are counts of earlier dates plus a rank within the date, so no task orders all rows.
    The table of dates is what a single window task sees.
    """
    per = rows.groupBy("date").count()
    before = per.select("date", (F.sum("count").over(W.orderBy("date")) - F.col("count")).alias("_before"), F.sum("count").over(W.partitionBy()).alias("_n"))
    rank = F.col("_before") + F.row_number().over(W.partitionBy("date").orderBy("account_id"))
    a = F.bround(F.col("_n") * F.lit(train))
    b = a + F.bround(F.col("_n") * F.lit(validation))
    return rows.join(before, "date").withColumn("_r", rank).withColumn("split", F.when(F.col("_r") <= a, "train").when(F.col("_r") <= b, "validation").otherwise("test")).drop("_before", "_n", "_r")


def median_split(rows: DataFrame) -> DataFrame:
    """``part``: ``early`` up to the median day, else ``late``."""
    mid = F.broadcast(rows.agg(F.median("day").alias("_m")))
    return rows.crossJoin(mid).withColumn("part", F.when(F.col("day") <= F.col("_m"), "early").otherwise("late")).drop("_m")


def balanced_weights(rows: DataFrame) -> DataFrame:
    """``label, weight``: the rows' number over twice the class's number."""
    per = rows.groupBy("label").agg(F.count("*").alias("n"))
    return per.select("label", (F.sum("n").over(W.partitionBy()) / (2 * F.col("n"))).alias("weight"))


SCORES_A_RANGE = 100_000


def roc_points(scored: DataFrame, buckets: int | None = None) -> DataFrame:
    """``score, fpr, tpr`` after each distinct score from the highest down, and the start (null, 0, 0).

    Distinct scores are summed in two levels: running sums within ranges of scores, and the
    totals of the ranges above, so unique scores never meet in one task. Without ``buckets`` there is a
    range for each ``SCORES_A_RANGE`` distinct scores.
    """
    y = F.col("label")
    per = scored.where("score is not null and label is not null").groupBy("score").agg(F.sum(y.cast("bigint")).alias("p"), F.sum((~y).cast("bigint")).alias("n"))
    if buckets is None:
        buckets = 1 + per.count() // SCORES_A_RANGE
    if buckets == 1:
        part = per.withColumn("_b", F.lit(0))
    else:
        cut = F.broadcast(per.agg(F.percentile_approx("score", F.array(*[F.lit(k / buckets) for k in range(1, buckets)])).alias("_cuts")))
        part = per.crossJoin(cut).withColumn("_b", F.size(F.filter("_cuts", lambda c: c <= F.col("score")))).drop("_cuts")
    sums = part.groupBy("_b").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    up = W.orderBy(F.desc("_b"))
    above = sums.select("_b", (F.sum("_p").over(up) - F.col("_p")).alias("_ap"), (F.sum("_n").over(up) - F.col("_n")).alias("_an"), F.sum("_p").over(W.partitionBy()).alias("_tp"), F.sum("_n").over(W.partitionBy()).alias("_tn"))
    run = W.partitionBy("_b").orderBy(F.desc("score"))
    out = part.join(F.broadcast(above), "_b").select("score", ((F.col("_an") + F.sum("n").over(run)) / F.nullif("_tn", F.lit(0))).alias("fpr"), ((F.col("_ap") + F.sum("p").over(run)) / F.nullif("_tp", F.lit(0))).alias("tpr"))
    start = out.sparkSession.range(1).select(F.lit(None).cast("double").alias("score"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return out.unionByName(start)


def recall_at_fpr(points: DataFrame, target: float = 0.2) -> DataFrame:
    """``recall`` at a false-positive rate, linear between points; the highest of several at it."""
    p = F.struct("fpr", "tpr")
    got = points.agg(F.max(F.when(F.col("fpr") <= target, p)).alias("a"), F.min(F.when(F.col("fpr") > target, p)).alias("b"))
    a, b = F.col("a"), F.col("b")
    return got.select(F.when(b.isNull() | (a.fpr == target), a.tpr).otherwise(a.tpr + (target - a.fpr) * (b.tpr - a.tpr) / (b.fpr - a.fpr)).alias("recall"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """``auc``, ties as half: pairs won, counted over the points by rank sums.

    The trapezoid over the curve needs each point's left neighbour; as fpr and tpr are
    running sums, it equals a sum over scores that only looks at the point itself.
    """
    pts = roc_points(scored).where("score is not null")
    y = F.col("label")
    per = scored.where("score is not null and label is not null").groupBy("score").agg((F.sum(y.cast("bigint"))).alias("p"), F.sum((~y).cast("bigint")).alias("n"))
    total = F.broadcast(per.agg(F.sum("p").alias("tp"), F.sum("n").alias("tn")))
    rows = pts.join(per, "score").crossJoin(total)
    won = F.round(F.col("tpr") * F.col("tp")).cast("bigint") * 2 - F.col("p")
    return rows.agg(F.sum(F.col("n") * won).alias("w"), F.max("tp").alias("tp"), F.max("tn").alias("tn")).select((F.col("w") / (2 * F.col("tp") * F.col("tn"))).alias("auc"))


def log_loss(scored: DataFrame, eps: float = 1e-15) -> DataFrame:
    p = F.greatest(F.least(F.col("score"), F.lit(1 - eps)), F.lit(eps))
    return scored.agg(F.avg(F.when(F.col("label"), -F.log(p)).otherwise(-F.log(1 - p))).alias("log_loss"))


def assembled(profiles: DataFrame, degrees: DataFrame, gw: DataFrame, gwd: DataFrame) -> DataFrame:
    """Inner joins of the feature tables on account and day."""
    key = ["account_id", "day"]
    return profiles.join(degrees.drop("w"), key).join(gw, key).join(gwd, key)


def dataset_summary(ledger: DataFrame, account_day: DataFrame) -> DataFrame:
    """One row of counts."""
    accounts = ledger.select(F.explode(F.array("sender_id", "receiver_id")).alias("a")).agg(F.countDistinct("a").alias("accounts"))
    days = account_day.agg(F.count("*").alias("account_days"), F.sum(F.col("label").cast("bigint")).alias("positives"))
    return ledger.agg(F.count("*").alias("txns"), F.sum(F.col("is_sar").cast("bigint")).alias("sar_txns")).crossJoin(accounts).crossJoin(days)


def split_summary(split: DataFrame) -> DataFrame:
    return split.groupBy("split").agg(F.count("*").alias("rows"), F.sum(F.col("label").cast("bigint")).alias("positives"))


#: Names of the published feature sets that compete for the best; a sixth, profiles+GWd, is for comparison.
HEADLINE = ("profiles", "profiles+degrees", "profiles+GW", "profiles+degrees+GW", "profiles+degrees+GWd")


def ablation_table(recalls: DataFrame, baseline: str = "profiles", headline: tuple[str, ...] = HEADLINE) -> DataFrame:
    """``name, recall, delta, best``: difference to the baseline's recall, and whether it is the best set:
    that of ``headline`` with the highest recall, of equal ones the first in that order."""
    base = recalls.where(F.col("name") == baseline).select(F.col("recall").alias("_base"))
    place = F.array_position(F.array(*map(F.lit, headline)), F.col("name"))
    best = recalls.where(place > 0).agg(F.max_by("name", F.struct("recall", -place)).alias("_best"))
    return recalls.crossJoin(F.broadcast(base)).crossJoin(F.broadcast(best)).select("name", "recall", (F.col("recall") - F.col("_base")).alias("delta"), (F.col("name") == F.col("_best")).alias("best"))


def sweep_matrix(cells: DataFrame, grid: list[int]) -> DataFrame:
    """``tws`` rows by one column for each ``twl`` of the grid."""
    return cells.groupBy("tws").pivot("twl", grid).agg(F.first("recall")).select("tws", *[F.col(str(g)).alias(f"twl_{g}") for g in grid])


def best_cell(cells: DataFrame) -> DataFrame:
    """The cell of highest recall; of equal ones the first by ``tws`` and ``twl``."""
    return cells.orderBy(F.desc("recall"), "tws", "twl").limit(1)


def write_matrix(matrix: DataFrame, path: str) -> None:
    matrix.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)
