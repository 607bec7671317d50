"""Alert quality and ledger exploration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltrace.operators.rules import RULES
from siltrace.sources.ledger import both_sides, normalised, pattern_account_days, with_days


def alert_quality(alerts: DataFrame) -> DataFrame:
    got = alerts.agg(F.count("*").alias("alerts"), F.sum(F.col("any_true_positive").cast("bigint")).alias("true_positives"))
    return got.withColumn("false_positive_rate", 1 - F.col("true_positives") / F.nullif("alerts", F.lit(0)))


def rule_volume(alerts: DataFrame) -> DataFrame:
    rows = alerts.select("account_id", "date", F.explode(F.array_distinct("triggered_rules")).alias("rule_name"))
    return rows.groupBy("rule_name").agg(F.count("*").alias("alerts"), F.countDistinct("account_id").alias("accounts"))


def rules_per_alert(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy(F.size("triggered_rules").alias("n_rules")).agg(F.count("*").alias("alerts"))


def pattern_coverage(ledger: DataFrame, alerts: DataFrame) -> DataFrame:
    """``pattern_type, pattern_id, caught``: is any account-day of the pattern alerted?"""
    hit = alerts.select("account_id", "date", F.lit(True).alias("_a")).distinct()
    rows = pattern_account_days(ledger).join(hit, ["account_id", "date"], "left")
    return rows.groupBy("pattern_type", "pattern_id").agg(F.coalesce(F.bool_or("_a"), F.lit(False)).alias("caught"))


def coverage_by_type(coverage: DataFrame) -> DataFrame:
    return coverage.groupBy("pattern_type").agg(F.count("*").alias("patterns"), F.avg(F.col("caught").cast("double")).alias("share_caught"))


def missed_patterns(ledger: DataFrame, coverage: DataFrame) -> DataFrame:
    """Patterns that no alert touches, with their sorted amounts."""
    missed = coverage.where("not caught").select("pattern_type", "pattern_id")
    return normalised(ledger).where("is_sar").join(missed, ["pattern_type", "pattern_id"]).groupBy("pattern_type", "pattern_id").agg(F.sort_array(F.collect_list("amount")).alias("amounts"))


def rule_crosstab(ledger: DataFrame, alerts: DataFrame) -> DataFrame:
    """Caught account-days by pattern type and rule."""
    rows = pattern_account_days(ledger).join(alerts.select("account_id", "date", "triggered_rules"), ["account_id", "date"]).select("pattern_type", F.explode("triggered_rules").alias("rule"))
    return rows.groupBy("pattern_type").pivot("rule", list(RULES)).count().fillna(0)


def rules_on_role(ledger: DataFrame, alerts: DataFrame, involved: DataFrame, role: str = "collector", pattern_type: str = "smurfing") -> DataFrame:
    who = involved.where((F.col("role") == role) & (F.col("pattern_type") == pattern_type)).select("pattern_id", "account_id").distinct()
    days = pattern_account_days(ledger).join(who, ["pattern_id", "account_id"], "left_semi").select("account_id", "date").distinct()
    return alerts.join(days, ["account_id", "date"], "left_semi").select(F.explode("triggered_rules").alias("rule_name")).groupBy("rule_name").count()


def sole_trigger_examples(ledger: DataFrame, alerts: DataFrame, seed: int = 42) -> DataFrame:
    """For each rule one false positive that it alone raised once, with that day's transfers."""
    sole = alerts.where((F.size("triggered_rules") == 1) & ~F.col("any_true_positive")).select("account_id", "date", F.col("triggered_rules")[0].alias("rule_name"))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), "account_id", F.col("date").cast("string")).cast("binary"))
    one = sole.withColumn("_n", F.row_number().over(W.partitionBy("rule_name").orderBy(order))).where("_n = 1").drop("_n")
    return both_sides(with_days(ledger)).select("account_id", "date", "txn_id", "role", "amount").join(one, ["account_id", "date"])


def suspicious_share(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    sar = both_sides(normalised(ledger).where("is_sar")).agg(F.countDistinct("account_id").alias("suspicious"))
    return accounts.agg(F.count("*").alias("accounts")).crossJoin(sar).withColumn("share", F.col("suspicious") / F.nullif("accounts", F.lit(0)))


def patterns_by_type(ledger: DataFrame) -> DataFrame:
    return normalised(ledger).where("is_sar").groupBy("pattern_type").agg(F.countDistinct("pattern_id").alias("patterns"))


def shared_accounts(involved: DataFrame) -> DataFrame:
    """Accounts in more than one pattern."""
    return involved.groupBy("account_id").agg(F.countDistinct("pattern_id").alias("patterns")).where("patterns > 1")


def amount_histogram(ledger: DataFrame, accounts: DataFrame, bins: int = 60, low: float = 0.0, high: float = 6.0) -> DataFrame:
    """Density of log10 amounts by the sender's persona in equal bins from ``low`` to ``high``."""
    named = ledger.where("amount > 0").join(accounts.select(F.col("account_id").alias("sender_id"), "persona"), "sender_id", "left")
    bin_ = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.log10("amount") - low) / ((high - low) / bins)))).cast("int")
    per = named.groupBy("persona", bin_.alias("bin")).agg(F.count("*").alias("n"))
    return per.withColumn("density", F.col("n") / (F.sum("n").over(W.partitionBy("persona")) * F.lit((high - low) / bins)))


def activity_by_persona(ledger: DataFrame, accounts: DataFrame, degrees: DataFrame) -> DataFrame:
    """Mean transfers sent, and mean, median and largest degree, silent accounts included."""
    sent = ledger.groupBy(F.col("sender_id").alias("account_id")).agg(F.count("*").alias("n"))
    rows = accounts.join(sent, "account_id", "left").join(degrees, "account_id", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "degree": F.coalesce("degree", F.lit(0))})
    return rows.groupBy("persona").agg(F.avg("n").alias("mean_sent"), F.avg("degree").alias("mean_degree"), F.median("degree").alias("median_degree"), F.max("degree").alias("max_degree"))


def degree_medians(features: DataFrame, groups: DataFrame) -> DataFrame:
    """Medians of own degrees by ``grp`` of ``account_id``."""
    return features.join(groups, "account_id").groupBy("grp").agg(F.count("*").alias("n"), F.median("in_degree").alias("in_degree"), F.median("out_degree").alias("out_degree"))


def stratified_sample(rows: DataFrame, group: str, k: int, seed: int = 42) -> DataFrame:
    """Up to ``k`` account-days of each group, by a hash of seed and key.

    Each salted part keeps its first ``k`` before the parts of a group meet.
    """
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), "account_id", F.col("date").cast("string")).cast("binary"))
    keyed = rows.withColumn("_h", order).withColumn("_s", F.pmod(F.xxhash64("_h"), F.lit(64)))
    few = keyed.withColumn("_n", F.row_number().over(W.partitionBy(group, "_s").orderBy("_h"))).where(F.col("_n") <= k)
    return few.withColumn("_n", F.row_number().over(W.partitionBy(group).orderBy("_h"))).where(F.col("_n") <= k).drop("_h", "_s", "_n")


def differing_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks; none if two builds are identical."""
    return a.exceptAll(b).unionByName(b.exceptAll(a))
