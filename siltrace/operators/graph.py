"""Sliding-window graph jobs. The graph at day D with window w holds transfers of days D-w to D."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltrace.operators.components import connected_components
from siltrace.session import checkpoint, stored
from siltrace.sources.ledger import both_sides, cents, normalised, with_days

MEASURES = ("in_degree", "out_degree", "in_weight", "out_weight")


def incident(ledger: DataFrame) -> DataFrame:
    """``node, nbr, out, day, c``: cents between two accounts on a day, seen from each of them."""
    sides = both_sides(with_days(ledger)).where("account_id is not null and counterparty is not null")
    return sides.groupBy(F.col("account_id").alias("node"), F.col("counterparty").alias("nbr"), (F.col("role") == "sent").alias("out"), "day").agg(F.sum(cents()).alias("c"))


def stretches(edges: DataFrame, windows: DataFrame, *by: str) -> DataFrame:
    """``*by, w, first, last``: the runs of days on which an edge is live, for each window of ``windows``.

    A transfer keeps its edge live from its day to ``w`` days later; runs that touch or overlap are one. The
    window sees one row for each edge and day.
    """
    days = edges.select(*by, "day").distinct().crossJoin(F.broadcast(windows))
    order = W.partitionBy(*by, "w").orderBy("day")
    gap = F.coalesce(F.col("day") - F.lag("day").over(order) > F.col("w") + 1, F.lit(True))
    run = days.withColumn("_gap", gap).withColumn("_run", F.sum(F.col("_gap").cast("int")).over(order))
    return run.groupBy(*by, "w", "_run").agg(F.min("day").alias("first"), (F.max("day") + F.col("w")).alias("last")).drop("_run")


def _windows(targets: DataFrame) -> DataFrame:
    """The different windows of the targets: whole days, so no more rows than the longest has days."""
    return targets.select("w").distinct()


def neighbours(targets: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct ``node, at, w, nbr`` of targets, either way, by runs of days.

    A run lies in each bucket of ``w + 1`` days that it touches, and a target in one, so a hub's runs
    meet its targets a bucket at a time, and a pair of them meets once.
    """
    b = lambda day: F.floor(F.col(day) / (F.col("w") + 1))
    asked = edges.join(targets.select("node").distinct(), "node", "left_semi")
    runs = stretches(asked, _windows(targets), "node", "nbr").withColumn("_b", F.explode(F.sequence(b("first"), b("last"))))
    met = targets.withColumn("_b", b("at")).join(runs, ["node", "w", "_b"])
    return met.where(F.col("at").between(F.col("first"), F.col("last"))).select("node", "at", "w", "nbr")


def snapshot_edges(ledger: DataFrame, at: DataFrame, w: int) -> DataFrame:
    """Live transfers at each day of ``at``: ``at, sender_id, receiver_id, day, amount``."""
    size = w + 1
    days = at.select("at").distinct().withColumn("_b", F.explode(F.array_distinct(F.array(F.floor(F.col("at") / size), F.floor((F.col("at") - w) / size)))))
    return with_days(ledger).withColumn("_b", F.floor(F.col("day") / size)).join(days, "_b").where((F.col("day") <= F.col("at")) & (F.col("day") >= F.col("at") - w)).select("at", "sender_id", "receiver_id", "day", "amount")


def degrees(targets: DataFrame, edges: DataFrame) -> DataFrame:
    """The four measures of each target ``node, at, w``; 0 without edges.

    A sweep over events instead of a join of targets with days: an edge adds one to a degree when a run of
    its days begins and takes it off after the run; a day's cents come and go with the window. A node's
    running sums, over one row for each day on which something changes or is asked, give every
    target's measures. So the cost follows edges and targets, not targets times days.
    """
    asked = edges.join(targets.select("node").distinct(), "node", "left_semi")
    windows = _windows(targets)
    runs = stretches(asked, windows, "node", "nbr", "out")
    none = F.lit(0).cast("bigint")
    event = lambda day, d, c: F.struct(day.cast("int").alias("at"), d.cast("bigint").alias("d"), c.cast("bigint").alias("c"))
    came = runs.select("node", "w", "out", F.explode(F.array(event(F.col("first"), F.lit(1), none), event(F.col("last") + 1, F.lit(-1), none))).alias("e"))
    paid = asked.crossJoin(F.broadcast(windows)).select("node", "w", "out", F.explode(F.array(event(F.col("day"), none, F.col("c")), event(F.col("day") + F.col("w") + 1, none, -F.col("c")))).alias("e"))
    way = lambda out, v: F.when(F.col("out") == out, F.col(v)).otherwise(none)
    names = {"in_degree": way(False, "e.d"), "out_degree": way(True, "e.d"), "in_weight": way(False, "e.c"), "out_weight": way(True, "e.c")}
    changes = came.unionByName(paid).select("node", "w", F.col("e.at").alias("at"), *[v.alias(k) for k, v in names.items()], F.lit(False).alias("_asked"))
    marks = targets.select("node", "w", F.col("at").cast("int").alias("at"), *[none.alias(k) for k in names], F.lit(True).alias("_asked"))
    per = changes.unionByName(marks).groupBy("node", "w", "at").agg(*[F.sum(k).alias(k) for k in names], F.max("_asked").alias("_asked"))
    run = W.partitionBy("node", "w").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    got = per.select("node", "at", "w", "_asked", *[F.sum(k).over(run).alias(k) for k in names]).where("_asked")
    return got.select("node", "at", "w", "in_degree", "out_degree", (F.col("in_weight") / 100).alias("in_weight"), (F.col("out_weight") / 100).alias("out_weight"))


def degree_features(targets: DataFrame, ledger: DataFrame) -> DataFrame:
    """Own measures of ``account_id, day, w``, and mean, min and max over its neighbours' ones.

    The ledger is read once, into a table of edges and days. Each distinct (node, day) is asked for once, however many
    targets it neighbours; without neighbours the twelve statistics are null.
    """
    edges = stored(incident(ledger), "incident")
    t = stored(targets.select(F.col("account_id").alias("node"), F.col("day").alias("at"), "w").distinct(), "asked")
    near = stored(neighbours(t, edges), "near")
    known = stored(degrees(t.unionByName(near.select(F.col("nbr").alias("node"), "at", "w")).distinct(), edges), "degrees")
    around = near.join(known.withColumnRenamed("node", "nbr"), ["nbr", "at", "w"])
    mean = lambda m: F.avg(m) if "degree" in m else F.avg(cents(m)) / 100  # noqa: E731  exact in any order
    stats = around.groupBy("node", "at", "w").agg(*[f(m).alias(f"nbr_{m}_{n}") for m in MEASURES for n, f in (("mean", mean), ("min", F.min), ("max", F.max))])
    out = t.join(known, ["node", "at", "w"]).join(stats, ["node", "at", "w"], "left")
    return out.withColumnRenamed("node", "account_id").withColumnRenamed("at", "day")


def dual_window_degrees(account_day: DataFrame, ledger: DataFrame, legit: int, suspicious: int) -> DataFrame:
    """``degree_features`` with the window chosen by each row's label."""
    t = account_day.select("account_id", "day", F.when(F.col("label"), suspicious).otherwise(legit).alias("w"))
    return degree_features(t, ledger)


def live_edge_counts(ledger: DataFrame, w: int) -> DataFrame:
    """``day, n_edges``: transfers live at each day that has any. A row per day reaches the window."""
    daily = with_days(ledger).groupBy("day").count()
    return daily.select("day", F.sum("count").over(W.orderBy("day").rangeBetween(-w, 0)).alias("n_edges"))


def total_degrees(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """Different counterparties of each account over the whole ledger, 0 included."""
    pairs = both_sides(ledger).select("account_id", "counterparty").distinct().groupBy("account_id").agg(F.count("counterparty").alias("degree"))
    return accounts.select("account_id").join(pairs, "account_id", "left").select("account_id", F.coalesce("degree", F.lit(0)).alias("degree"))


def degree_histogram(degrees_: DataFrame) -> DataFrame:
    return degrees_.where("degree > 0").groupBy("degree").agg(F.count("*").alias("accounts"))


def hop_distances(edges: DataFrame, targets: DataFrame, max_hops: int = 1000) -> DataFrame:
    """``account_id, distance`` to the nearest of ``targets``, for every account of the edges and the targets.

    One search outward from all targets at once over undirected ``sender_id, receiver_id``;
    it ends when a round reaches nobody new, and raises if ``max_hops`` rounds don't suffice.
    Accounts that no target reaches have a null distance.
    """
    both = checkpoint(edges.select(F.explode(F.array(F.struct(F.col("sender_id").alias("a"), F.col("receiver_id").alias("b")), F.struct(F.col("receiver_id").alias("a"), F.col("sender_id").alias("b")))).alias("e")).select("e.a", "e.b").distinct())
    known = checkpoint(targets.select("account_id").distinct().withColumn("distance", F.lit(0)))
    for hop in range(1, max_hops + 1):
        edge = known.where(F.col("distance") == hop - 1).select(F.col("account_id").alias("a"))
        new = checkpoint(both.join(edge, "a").select(F.col("b").alias("account_id")).distinct().join(known, "account_id", "left_anti").withColumn("distance", F.lit(hop)))
        if new.isEmpty():
            return both.select(F.col("a").alias("account_id")).where("account_id is not null").union(targets.select("account_id")).distinct().join(known, "account_id", "left")
        known = checkpoint(known.unionByName(new))
    raise RuntimeError("some accounts lie farther out; raise max_hops")


def sar_components(ledger: DataFrame) -> DataFrame:
    """``component, size`` of the graph of labelled transfers."""
    return connected_components(normalised(ledger).where("is_sar"), "sender_id", "receiver_id").groupBy("component").agg(F.count("*").alias("size"))


def chain_order(ledger: DataFrame) -> DataFrame:
    """``pattern_id, accounts``: the first sender, then receivers by time, first occurrence only."""
    sar = normalised(ledger).where("is_sar")
    n = F.row_number().over(W.partitionBy("pattern_id").orderBy("timestamp", "txn_id"))
    seen = sar.select("pattern_id", "sender_id", "receiver_id", n.alias("n")).select("pattern_id", F.explode(F.array(F.struct(F.when(F.col("n") == 1, F.col("sender_id")).alias("a"), F.lit(0).alias("k")), F.struct(F.col("receiver_id").alias("a"), F.col("n").alias("k")))).alias("x")).where("x.a is not null")
    first = seen.groupBy("pattern_id", F.col("x.a").alias("a")).agg(F.min("x.k").alias("k"))
    return first.groupBy("pattern_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "a"))), lambda x: x["a"]).alias("accounts"))
