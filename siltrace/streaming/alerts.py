"""Alerts and degrees on a stream of transfers.

Days close when the watermark passes their end; each function returns a streaming DataFrame
for an append sink.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltrace.operators.graph import degrees, incident
from siltrace.operators.rules import large_single_txn, round_amount_near_threshold
from siltrace.session import discard, shared_dir, stored
from siltrace.sources.ledger import BASE_DATE, LEDGER, both_sides, cents, with_days

_DAY_MS = 86_400_000


def ledger_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(LEDGER).option("maxFilesPerTrigger", files).parquet(path)


def transaction_alerts(stream: DataFrame) -> DataFrame:
    """The two rules that look at one transfer; no state."""
    return large_single_txn(stream).unionByName(round_amount_near_threshold(stream))


def velocity_alerts(stream: DataFrame, threshold: int = 5, delay: str = "1 day") -> DataFrame:
    """Accounts with over ``threshold`` counterparties on a closed day.

    Two aggregations in a row: a day's pairs are made distinct, then counted when the day closes. State is one
    small row for each pair, spread by pair, so a hub's day meets in one task as partial counts only.
    """
    sides = both_sides(stream.withWatermark("timestamp", delay)).where("counterparty is not null")
    pairs = sides.groupBy(F.window("timestamp", "1 day"), "account_id", "counterparty").agg(F.count("*").alias("n"))
    daily = pairs.groupBy("window", "account_id").agg(F.count("*").alias("n"))
    return daily.where(F.col("n") > threshold).select("account_id", F.to_date("window.start").alias("date"), F.lit("high_daily_velocity").alias("rule_name"))


def _closing(state: GroupState, days) -> int:
    """The first day that is still open; sets the timer for the next one of ``days`` to close."""
    mark = state.getCurrentWatermarkMs()
    first_open = mark // _DAY_MS
    waiting = [d for d in days if d >= first_open]
    if waiting:
        state.setTimeoutTimestamp(max((min(waiting) + 1) * _DAY_MS, mark + 1))
    return first_open


def spike_alerts(stream: DataFrame, multiplier: float = 5.0, window_days: int = 30, delay: str = "1 day") -> DataFrame:
    """``sudden_volume_spike`` on closed days. State: an account's daily cents of the window."""
    epoch = F.unix_date(F.to_date("timestamp"))
    rows = stream.withWatermark("timestamp", delay).select("timestamp", F.col("sender_id").alias("account_id"), epoch.alias("e"), cents().alias("c"))

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        days, totals, told = state.get if state.exists else ([], [], -1)
        by = dict(zip(days, totals))
        for rows_ in batches if not state.hasTimedOut else ():
            for e, c in zip(rows_["e"].tolist(), rows_["c"].tolist()):
                by[e] = by.get(e, 0) + c
        first_open = _closing(state, by)
        out = []
        for d in sorted(x for x in by if told < x < first_open):
            past = [v for x, v in by.items() if d - window_days <= x < d]
            if past and by[d] * len(past) > sum(past) * multiplier:
                out.append(d)
        told = max(told, first_open - 1)
        by = {d: v for d, v in by.items() if d >= first_open - window_days}
        state.update((list(by), list(by.values()), told))
        yield pd.DataFrame([(key[0], d) for d in out], columns=["account_id", "e"])

    got = rows.groupBy("account_id").applyInPandasWithState(step, "account_id string, e bigint", "days array<bigint>, totals array<bigint>, told bigint", "append", GroupStateTimeout.EventTimeTimeout)
    return got.select("account_id", F.date_from_unix_date(F.col("e").cast("int")).alias("date"), F.lit("sudden_volume_spike").alias("rule_name"))


def sliding_degrees(stream: DataFrame, w: int, delay: str = "1 day") -> DataFrame:
    """In and out degree and weight of each account at the close of its active days.

    Three aggregations in a row, each fed by the rows that the one before closes: cents by day, neighbour and
    way; the same over the ``w + 1`` days up to each day; sums by account. State is spread by neighbour and each
    batch writes what it brings, so an account with many neighbours is no single row of state or task. The second
    holds up to ``w + 1`` rows for each row of the first.
    """
    sides = both_sides(stream.withWatermark("timestamp", delay)).select("timestamp", "account_id", "counterparty", (F.col("role") == "sent").alias("out"), cents().alias("c"))
    edge = ["account_id", "counterparty", "out"]
    daily = sides.groupBy(F.window("timestamp", "1 day"), *edge).agg(F.sum("c").alias("c"))
    reach = daily.select(F.col("window").alias("closed"), F.col("window.end").alias("until"), *edge, "c")
    live = reach.groupBy(F.window("closed", f"{w + 1} days", "1 day"), *edge).agg(F.sum("c").alias("c"), F.max("until").alias("until"))
    weight = lambda out: F.coalesce(F.sum(F.when(F.col("out") == out, F.col("c"))), F.lit(0)) / 100
    sums = live.groupBy("window", "account_id").agg(
        F.count_if(~F.col("out")).alias("in_degree"), F.count_if("out").alias("out_degree"),
        weight(False).alias("in_weight"), weight(True).alias("out_weight"), F.max("until").alias("until"),
    )
    day = F.datediff(F.date_sub(F.to_date("window.end"), 1), F.lit(BASE_DATE).cast("date"))
    return sums.where(F.col("until") == F.col("window.end")).select("account_id", day.alias("day"), "in_degree", "out_degree", "in_weight", "out_weight")


def closed_degrees(stream: DataFrame, w: int, delay: str = "1 day", name: str = "degrees") -> DataFrame:
    """The rows of ``sliding_degrees`` over what is there, with tables instead of state.

    A batch adds its cents by day, neighbour and way to a table, once each. Days that the batches before it have closed
    (those that end by the newest time less ``delay``) are then asked of that table by the sums of ``graph.degrees``,
    which read only the ``w`` days before them; rows of days asked before are late and left out. So nothing is held
    ``w + 1`` times or in memory. Batches overwrite their own folders, so a repeated batch changes nothing.
    """
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    day = lambda time: F.datediff(F.to_date(time), F.lit(BASE_DATE).cast("date"))
    ledger = "sender_id string, receiver_id string, amount double, timestamp timestamp"
    measures = "account_id string, day int, in_degree bigint, out_degree bigint, in_weight double, out_weight double"

    def open_from(n: int) -> int | None:
        """The first day that batches before the n-th leave open."""
        if n < 1:
            return None
        newest = spark.read.schema("b bigint, newest timestamp").parquet(f"{at}/newest").where(F.col("b") < n)
        return newest.select(day(F.max("newest") - F.expr(f"INTERVAL {delay}"))).first()[0]

    def close(n: int) -> None:
        first, until = open_from(n - 1), open_from(n)
        if until is None or until == first:
            spark.createDataFrame([], measures).write.mode("overwrite").parquet(f"{at}/rows/b={n}")
            return
        parts = spark.read.schema("node string, nbr string, out boolean, day int, c bigint, b bigint").parquet(f"{at}/edges").where((F.col("b") <= n) & (F.col("day") < until))
        parts = parts if first is None else parts.where(F.col("day") >= first - w)
        known = stored(parts.groupBy("node", "nbr", "out", "day").agg(F.sum("c").alias("c")), "degrees-known")
        asked = known if first is None else known.where(F.col("day") >= first)
        got = degrees(asked.select("node", F.col("day").alias("at"), F.lit(w).alias("w")).distinct(), known)
        got.select(F.col("node").alias("account_id"), F.col("at").alias("day"), "in_degree", "out_degree", "in_weight", "out_weight").write.mode("overwrite").parquet(f"{at}/rows/b={n}")
        discard(known)

    def take(batch: DataFrame, n: int) -> None:
        batch.select("sender_id", "receiver_id", "amount", "timestamp").where("timestamp is not null").write.mode("overwrite").parquet(f"{at}/came/b={n}")
        came = spark.read.schema(ledger).parquet(f"{at}/came/b={n}")  # free of the stream's plan
        first = open_from(n - 1)
        incident(came if first is None else came.where(day("timestamp") >= first)).write.mode("overwrite").partitionBy("day").parquet(f"{at}/edges/b={n}")
        came.agg(F.max("timestamp").alias("newest")).write.mode("overwrite").parquet(f"{at}/newest/b={n}")
        discard(came)
        close(n)

    stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    close(1 + spark.read.schema("newest timestamp, b bigint").parquet(f"{at}/newest").agg(F.max("b")).first()[0])  # what the last batch closed
    return spark.read.schema(measures).parquet(f"{at}/rows").drop("b")  # a folder of each batch


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Runs a streaming DataFrame over what is there, and reads the sink."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def route_late(stream: DataFrame, days: int, name: str = "late") -> tuple[DataFrame, DataFrame]:
    """(on time, late): rows over ``days`` days before the newest day of earlier batches are late.

    The newest day is kept as a table beside the sinks, so a restarted stream goes on with it;
    each batch overwrites its own folder, so a repeated batch changes nothing.
    """
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = with_days(stream).schema

    def route(batch: DataFrame, n: int) -> None:
        rows = with_days(batch).persist()
        newest = None
        if n:
            newest = spark.read.schema("b bigint, newest int").parquet(f"{at}/newest").where(F.col("b") < n).agg(F.max("newest")).first()[0]
        late = F.lit(False) if newest is None else F.col("day") < newest - days
        rows.where(late).write.mode("overwrite").parquet(f"{at}/late/b={n}")
        rows.where(~late).write.mode("overwrite").parquet(f"{at}/rows/b={n}")
        rows.agg(F.max("day").alias("newest")).write.mode("overwrite").parquet(f"{at}/newest/b={n}")
        rows.unpersist()

    stream.writeStream.foreachBatch(route).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    read = lambda part: spark.read.schema(schema).parquet(f"{at}/{part}")
    return read("rows"), read("late")
