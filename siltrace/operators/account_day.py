"""The table of alerted account-days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltrace.sources.ledger import both_sides, cents, normalised, with_days


def direction_summary(sides: DataFrame) -> DataFrame:
    """``account_id, date, direction_summary``: transfers of each direction."""
    one = sides.groupBy("account_id", "date", "direction").count()
    return one.groupBy("account_id", "date").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("direction", "count")))).alias("direction_summary"))


def account_days(ledger: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row per alerted account and date, from a ledger with ``direction``.

    Totals are 0 where there are none. An alerted day without transfers stays, with null
    count, counterparties and summary and a false label.
    """
    targets = alerts.select("account_id", "date").where("account_id is not null and date is not null").distinct()
    sides = both_sides(with_days(normalised(ledger))).withColumn("_c", cents()).join(targets, ["account_id", "date"])
    part = lambda role: F.sum(F.when(F.col("role") == role, F.col("_c")).otherwise(0)) / 100
    main = sides.groupBy("account_id", "date").agg(part("sent").alias("total_sent"), part("received").alias("total_received"), F.count("*").alias("n_txns"), F.sort_array(F.collect_set("counterparty")).alias("counterparties"), F.bool_or("is_sar").alias("label"))
    out = targets.join(main, ["account_id", "date"], "left").join(direction_summary(sides), ["account_id", "date"], "left")
    return out.select("account_id", "date", F.coalesce("total_sent", F.lit(0.0)).alias("total_sent"), F.coalesce("total_received", F.lit(0.0)).alias("total_received"), "n_txns", "counterparties", "direction_summary", F.coalesce("label", F.lit(False)).alias("label"))


def illicit_accounts(account_day: DataFrame) -> DataFrame:
    """Accounts with a labelled day."""
    return account_day.where("label").select("account_id").distinct()
