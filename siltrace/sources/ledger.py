"""The ledger of money transfers: schema, readers, and the views that every job starts from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltrace.sources.tables import table

BASE_DATE = "2024-01-01"
LEDGER = T.StructType([
    T.StructField("txn_id", T.StringType()),
    T.StructField("sender_id", T.StringType()),
    T.StructField("receiver_id", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("is_sar", T.BooleanType()),
    T.StructField("pattern_type", T.StringType()),
    T.StructField("pattern_id", T.StringType()),
])
PATTERN_TYPES = ("smurfing", "layering", "fan_out_fan_in", "round_tripping")


def read_ledger(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A ledger with the fixed schema; nothing is inferred."""
    return spark.read.schema(LEDGER).format(fmt).options(**({"header": "true"} if fmt == "csv" else {})).load(path)


def normalised(ledger: DataFrame) -> DataFrame:
    """Adds missing label columns; a null or missing ``is_sar`` is false."""
    flag = F.coalesce("is_sar", F.lit(False)) if "is_sar" in ledger.columns else F.lit(False)
    out = ledger.withColumn("is_sar", flag)
    for c in ("pattern_type", "pattern_id"):
        if c not in ledger.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    return out


def union_ledgers(legit: DataFrame, labelled: DataFrame) -> DataFrame:
    """All rows of both, by column name; no sort."""
    return normalised(legit).unionByName(normalised(labelled), allowMissingColumns=True)


def with_days(ledger: DataFrame, base: str = BASE_DATE) -> DataFrame:
    """``date`` and ``day``, the days since ``base``."""
    date = F.to_date("timestamp")
    return ledger.withColumn("date", date).withColumn("day", F.datediff(date, F.lit(base).cast("date")))


def cents(amount: str | Column = "amount") -> Column:
    """Exact integer money, so that sums don't depend on order."""
    return F.round((F.col(amount) if isinstance(amount, str) else amount) * 100).cast("bigint")


def with_directions(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """``direction`` by the types of both accounts; an unknown account counts as external."""
    kinds = accounts.select("account_id", "account_type")
    s = kinds.select(F.col("account_id").alias("sender_id"), F.col("account_type").alias("_s"))
    r = kinds.select(F.col("account_id").alias("receiver_id"), F.col("account_type").alias("_r"))
    inside = lambda c: F.coalesce(F.col(c) == "internal", F.lit(False))
    direction = F.when(inside("_s") & inside("_r"), "internal").when(inside("_s"), "outbound").when(inside("_r"), "inbound").otherwise("external")
    return ledger.join(s, "sender_id", "left").join(r, "receiver_id", "left").withColumn("direction", direction).drop("_s", "_r")


def both_sides(ledger: DataFrame) -> DataFrame:
    """Each transfer twice: as the sender's and as the receiver's, in one pass."""
    sides = F.array(
        F.struct(F.col("sender_id").alias("account_id"), F.col("receiver_id").alias("counterparty"), F.lit("sent").alias("role")),
        F.struct(F.col("receiver_id").alias("account_id"), F.col("sender_id").alias("counterparty"), F.lit("received").alias("role")),
    )
    return ledger.withColumn("_side", F.explode(sides)).select("_side.*", *[c for c in ledger.columns if c not in ("account_id", "counterparty", "role")])


def pattern_account_days(ledger: DataFrame) -> DataFrame:
    """Distinct pattern, account and date of labelled transfers."""
    return both_sides(with_days(normalised(ledger)).where("is_sar")).select("pattern_id", "pattern_type", "account_id", "date").distinct()


def until(ledger: DataFrame, cutoff: str | Column) -> DataFrame:
    """Transfers up to the whole of the cutoff day."""
    day = F.lit(cutoff).cast("date") if isinstance(cutoff, str) else cutoff
    return ledger.where(F.col("timestamp") < F.date_add(day, 1).cast("timestamp"))


def write_stage(df: DataFrame, path: str, fmt: str = "parquet", by: str | None = None) -> None:
    """Writes a stage table. For CSV, arrays become ``|``-joined text and maps JSON."""
    if fmt == "csv":
        df = df.select(*[F.array_join(F.col(f.name), "|").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.MapType, T.StructType)) else F.col(f.name) for f in df.schema])
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true")
    (writer.partitionBy(by) if by else writer).save(path)


def events_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """A ledger made of the ``events`` table: users pay the account that an event names."""
    e = table(spark, folder, "events")
    other = F.get_json_object("props", "$.k")
    kind = F.element_at(F.array(*map(F.lit, PATTERN_TYPES)), (F.col("event_id") % 4 + 1).cast("int"))
    flag = (F.col("event_type") == "error") & (F.col("value") >= 150)
    name = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return e.where(F.col("user_id") != other.cast("bigint")).select(
        F.concat(F.lit("TXN"), name(F.col("event_id"), 9)).alias("txn_id"),
        F.concat(F.lit("ACC"), name(F.col("user_id"), 7)).alias("sender_id"),
        F.concat(F.lit("ACC"), name(other, 7)).alias("receiver_id"),
        (F.round(F.col("value") * 4000) / 100).alias("amount"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        flag.alias("is_sar"),
        F.when(flag, kind).alias("pattern_type"),
        F.when(flag, F.concat(kind, F.lit("_"), (F.col("user_id") % 10).cast("string"))).alias("pattern_id"),
    )


def ledger_accounts(ledger: DataFrame) -> DataFrame:
    """Accounts of an events ledger, with a type and a persona by number."""
    a = ledger.select(F.explode(F.array("sender_id", "receiver_id")).alias("account_id")).distinct()
    n = F.substring("account_id", 4, 20).cast("bigint")
    persona = F.when(n % 10 < 7, "retail").when(n % 10 < 9, "small_business").otherwise("high_volume_merchant")
    return a.select("account_id", F.when(n % 5 == 0, "external").otherwise("internal").alias("account_type"), persona.alias("persona"))


def involved(ledger: DataFrame) -> DataFrame:
    """Accounts of labelled transfers with a role: receivers collect, senders are mules."""
    side = both_sides(normalised(ledger).where("is_sar"))
    return side.select("pattern_id", "pattern_type", "account_id", F.when(F.col("role") == "received", "collector").otherwise("mule").alias("role")).distinct()
