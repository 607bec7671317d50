"""Connected components of an undirected edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltrace.session import discard, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (``large``) or smaller neighbours to its least neighbour.

    Only minima are aggregated, never neighbour lists, so a hub costs one row per edge. Either kind gives
    at most a row per link and node, in which some may be equal.
    """
    if large:
        arcs = edges.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.col("v").alias("m")), F.struct(F.col("v").alias("n"), F.col("u").alias("m")))).alias("e")).select("e.n", "e.m")
    else:
        arcs = edges.select(F.greatest("u", "v").alias("n"), F.least("u", "v").alias("m"))
    low = arcs.groupBy("n").agg(F.min("m").alias("low")).withColumn("low", F.least("n", "low"))
    linked = arcs.join(low.hint("merge"), "n")
    if large:
        out = linked.where("m > n").select(F.col("m").alias("u"), F.col("low").alias("v"))
    else:
        own = low.select(F.col("n").alias("u"), F.col("low").alias("v"))
        out = linked.select(F.col("m").alias("u"), F.col("low").alias("v")).union(own)
    return out.where("u <> v")


def _settled(edges: DataFrame) -> bool:
    """Whether the links are stars already: every child has one parent, and no parent is a child."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")).select("e.*")
    per = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per.where("up > 1 or up = 1 and down = 1").count() == 0


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``node, component``: the least node reachable, for every node of ``edges``.

    Null ends, self links and repeated links are ignored (a node known only from a self link
    is its own component). Each round halves path lengths and is stored in the shared folder,
    in place of the one before, so lost executors repeat one round at most. Links that are stars already need
    no round, so components that are known can be given as links beside new ones. ``edges`` is evaluated
    once, when its links are stored. An empty input gives no rows.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    first = stored(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "component-round")
    now, rounds = first.where("u <> v"), 0
    while not _settled(now):
        if rounds == max_rounds:
            raise RuntimeError("components did not settle; raise max_rounds")
        last, now = now, stored(_star(_star(now, True), False).distinct(), "component-round")
        if rounds:  # the first table still names nodes that have only a link to themselves
            discard(last)
        rounds += 1
    named = now.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("component")), F.struct(F.col("v").alias("node"), F.col("v").alias("component")))).alias("e")).select("e.*")
    lone = first.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("component"))
    return named.union(lone).groupBy("node").agg(F.min("component").alias("component"))
