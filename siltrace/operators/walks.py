"""Random walks towards illicit accounts, as iterated joins."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltrace.operators.graph import incident, stretches
from siltrace.session import checkpoint, shared_dir, stored


def pick(n: Column, *parts: Column) -> Column:
    """A number from 0 to ``n - 1`` by md5 of ``parts``; the same wherever it runs."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") % n


def _runs(ledger: DataFrame, w: int) -> DataFrame:
    """The runs of days on which two accounts are neighbours, in each bucket of ``w + 1`` days that they touch."""
    edges = incident(ledger)
    one = edges.sparkSession.range(1).select(F.lit(w).alias("w"))
    return stretches(edges, one, "node", "nbr").withColumn("_b", F.explode(F.sequence(F.floor(F.col("first") / (w + 1)), F.floor(F.col("last") / (w + 1)))))


def random_walks(targets: DataFrame, ledger: DataFrame, illicit: DataFrame | None, w: int, n_walks: int = 50, max_steps: int = 20, seed: int = 42) -> DataFrame:
    """``account_id, day, walk, length, hit`` of walks that reach ``illicit``; with None, of every step of every walk.

    Each step goes to one of the sorted distinct neighbours on the snapshot of the target's
    day; a walk ends at an illicit account other than its own, at a dead end, or after
    ``max_steps``. A target that is illicit by ``illicit`` without self-exclusion should be
    handled by the caller: its own account never counts as a hit here.

    Neighbours are numbered rows ``node, at, k, nbr``, and places ``node, at, n`` say how many there are. A
    step draws a number and joins on all three keys, so walks through a busy account spread over its
    neighbours and no list travels. Rows are made once for each (account, day) that some walk stands on, and
    each step only adds its own.
    """
    return _joined_walks(targets, stored(_runs(ledger, w), "walk-runs"), illicit, w, n_walks, max_steps, seed)


def _joined_walks(targets: DataFrame, runs: DataFrame, illicit: DataFrame | None, w: int, n_walks: int, max_steps: int, seed: int) -> DataFrame:
    """``random_walks`` over the runs of days in buckets."""
    spark = runs.sparkSession
    bad = None if illicit is None else illicit.select(F.col("account_id").alias("next"), F.lit(True).alias("bad")).distinct()
    t = targets.select("account_id", "day").distinct()
    now = checkpoint(t.withColumn("walk", F.explode(F.sequence(F.lit(0), F.lit(n_walks - 1)))).withColumn("current", F.col("account_id")))
    at = {name: f"{shared_dir(spark)}/walk-{name}-{uuid.uuid4().hex}" for name in ("places", "neighbours")}
    made = lambda name, schema: spark.read.schema(schema).parquet(at[name])
    node = f"node {runs.schema['node'].dataType.simpleString()}, at int"
    done = None
    for step in range(1, max_steps + 1):
        need = now.select(F.col("current").alias("node"), F.col("day").alias("at")).distinct()
        if done is not None:
            need = need.join(made("places", f"{node}, n bigint"), ["node", "at"], "left_anti")
        met = need.withColumn("_b", F.floor(F.col("at") / (w + 1))).join(runs, ["node", "_b"]).where(F.col("at").between(F.col("first"), F.col("last")))
        per = W.partitionBy("node", "at")
        fresh = stored(met.select("node", "at", (F.row_number().over(per.orderBy("nbr")) - 1).cast("bigint").alias("k"), "nbr"), "walk-fresh")
        fresh.groupBy("node", "at").agg(F.count("*").alias("n")).write.mode("append").parquet(at["places"])
        fresh.write.mode("append").parquet(at["neighbours"])
        drawn = now.join(made("places", f"{node}, n bigint").withColumnsRenamed({"node": "current", "at": "day"}), ["current", "day"])
        k = pick(F.col("n"), F.lit(seed), F.col("account_id"), F.col("day"), F.col("walk"), F.lit(step))
        to = made("neighbours", f"{node}, k bigint, nbr {runs.schema['nbr'].dataType.simpleString()}").withColumnsRenamed({"node": "current", "at": "day", "nbr": "next"})
        moved = drawn.withColumn("k", k).join(to, ["current", "day", "k"]).select("account_id", "day", "walk", "next")
        ends = moved.withColumn("hit", F.lit(False)) if bad is None else moved.join(bad, "next", "left").withColumn("hit", F.coalesce(F.col("bad"), F.lit(False)) & (F.col("next") != F.col("account_id")))
        judged = checkpoint(ends)
        hits = (judged if bad is None else judged.where("hit")).select("account_id", "day", "walk", F.lit(step).alias("length"), F.col("next").alias("hit"))
        done = hits if done is None else done.unionByName(hits)
        now = judged.where("not hit").select("account_id", "day", "walk", F.col("next").alias("current"))
        if now.isEmpty():
            break
    return done


def _walked(day: int, edges, targets, n_walks: int, max_steps: int, seed: int):
    """All walks of one day over compressed sparse rows of its snapshot, step by step."""
    edges = edges.sort_values(["node", "nbr"])
    names = np.unique(np.concatenate([edges["node"].to_numpy(object), targets["account_id"].to_numpy(object)]))
    offset = np.searchsorted(edges["node"].to_numpy(object), names)
    degree = np.append(offset[1:], len(edges)) - offset
    to = np.searchsorted(names, edges["nbr"].to_numpy(object))  # a neighbour has this one as neighbour, so it is a node
    bad = edges["bad"].to_numpy(bool)
    own = np.repeat(np.searchsorted(names, targets["account_id"].to_numpy(object)), n_walks)
    walk = np.tile(np.arange(n_walks), len(targets))
    current, out = own.copy(), []
    for step in range(1, max_steps + 1):
        some = degree[current] > 0
        own, walk, current = own[some], walk[some], current[some]
        if not len(own):
            break
        drawn = [int(hashlib.md5(f"{seed}|{a}|{day}|{k}|{step}".encode()).hexdigest()[:8], 16) for a, k in zip(names[own], walk)]
        edge = offset[current] + np.array(drawn) % degree[current]
        hit = bad[edge] & (to[edge] != own)
        out.append(pd.DataFrame({"account_id": names[own[hit]], "day": day, "walk": walk[hit], "length": step, "hit": names[to[edge[hit]]]}))
        own, walk, current = own[~hit], walk[~hit], to[edge[~hit]]
    none = pd.DataFrame({"account_id": pd.Series([], dtype=object), "day": 0, "walk": 0, "length": 0, "hit": pd.Series([], dtype=object)})
    return pd.concat(out) if out else none  # untyped columns of no rows aren't taken for text


def _snapshot_sizes(runs: DataFrame, days: DataFrame, w: int) -> DataFrame:
    """``at, n``: edges, seen from both sides, of the snapshot of each of ``days``; no snapshot is made for it."""
    once = runs.where(F.col("_b") == F.floor(F.col("first") / (w + 1)))
    change = lambda day, d: F.struct(day.cast("int").alias("at"), F.lit(d).cast("bigint").alias("d"))
    changes = once.select(F.explode(F.array(change(F.col("first"), 1), change(F.col("last") + 1, -1))).alias("e")).select("e.*", F.lit(False).alias("asked"))
    per = changes.unionByName(days.select("at", F.lit(0).cast("bigint").alias("d"), F.lit(True).alias("asked"))).groupBy("at").agg(F.sum("d").alias("d"), F.max("asked").alias("asked"))
    return per.select("at", "asked", F.sum("d").over(W.orderBy("at").rowsBetween(W.unboundedPreceding, 0)).alias("n")).where("asked").drop("asked")  # a row a day


def day_walks(targets: DataFrame, ledger: DataFrame, illicit: DataFrame, w: int, n_walks: int = 50, max_steps: int = 20, seed: int = 42, largest: int = 2_000_000, join_larger: bool = False) -> DataFrame:
    """The rows of ``random_walks``, by one task for each day that holds the day's whole snapshot.

    For ledgers whose window fits one worker: there it needs no join in each step. A day whose snapshot has over
    ``largest`` edges, seen from both sides, raises an error before any walk or, with ``join_larger``, is walked by
    the joins of ``random_walks``, which have no such bound.
    """
    t = targets.select("account_id", "day").distinct()
    days = t.select(F.col("day").alias("at")).distinct()
    runs = stored(_runs(ledger, w), "walk-runs")
    sizes = checkpoint(_snapshot_sizes(runs, days, w))
    most, over, within = sizes.agg(F.coalesce(F.max("n"), F.lit(0)), F.count_if(F.col("n") > largest), F.count_if(F.col("n") <= largest)).first()
    if over and not join_larger:
        raise ValueError(f"a day's snapshot has {most} edges, over {largest}; use random_walks or join_larger")
    large = F.broadcast(sizes.where(F.col("n") > largest).select(F.col("at").alias("day")))
    joined = _joined_walks(t.join(large, "day", "left_semi"), runs, illicit, w, n_walks, max_steps, seed) if over else None
    if over and not within:
        return joined
    small = F.broadcast(sizes.where(F.col("n") <= largest).select("at", F.floor(F.col("at") / (w + 1)).alias("_b")))
    live = runs.join(small, "_b").where(F.col("at").between(F.col("first"), F.col("last"))).select("at", "node", "nbr")
    bad = illicit.select(F.col("account_id").alias("nbr"), F.lit(True).alias("bad")).distinct()
    edges = live.join(bad, "nbr", "left").withColumn("bad", F.coalesce("bad", F.lit(False)))

    def one(key, left, right):
        return _walked(int(key[0]), left, right, n_walks, max_steps, seed)

    asked = t.join(F.broadcast(small.select(F.col("at").alias("day"))), "day", "left_semi")
    walked = edges.groupBy("at").cogroup(asked.groupBy("day")).applyInPandas(one, "account_id string, day int, walk int, length int, hit string")
    return walked if joined is None else walked.unionByName(joined)


def walk_summary(targets: DataFrame, hits: DataFrame, n_walks: int, prefix: str = "gw", start_counts: DataFrame | None = None) -> DataFrame:
    """Nine columns for each target. No hit gives null statistics, rate 0 and no account.

    Targets that are in ``start_counts`` count as illicit from the start: all lengths 0, rate
    1, one account.
    """
    q = lambda p: F.percentile("length", F.lit(p))
    got = hits.groupBy("account_id", "day").agg(F.min("length").alias("min"), F.max("length").alias("max"), F.avg("length").alias("mean"), q(0.5).alias("median"), F.stddev_pop("length").alias("std"), q(0.25).alias("p25"), q(0.75).alias("p75"), (F.count("*") / n_walks).alias("hit_rate"), F.countDistinct("hit").alias("n_distinct"))
    out = targets.select("account_id", "day").distinct().join(got, ["account_id", "day"], "left").withColumns({"hit_rate": F.coalesce("hit_rate", F.lit(0.0)), "n_distinct": F.coalesce("n_distinct", F.lit(0))})
    names = ("min", "max", "mean", "median", "std", "p25", "p75", "hit_rate", "n_distinct")
    if start_counts is not None:
        out = out.join(start_counts.select("account_id", F.lit(True).alias("_s")).distinct(), "account_id", "left")
        one = {"hit_rate": 1.0, "n_distinct": 1}
        out = out.withColumns({n: F.when(F.col("_s"), F.lit(one.get(n, 0)).cast(out.schema[n].dataType)).otherwise(F.col(n)) for n in names})
    return out.select("account_id", "day", *[F.col(n).alias(f"{prefix}_{n}") for n in names])


def hit_rate_separation(features: DataFrame, groups: DataFrame, column: str = "gw_hit_rate") -> DataFrame:
    """``suspicious, legit, separation``: medians of the hit rate by ``suspicious`` accounts."""
    rows = features.join(groups, "account_id")
    med = rows.agg(F.median(F.when(F.col("suspicious"), F.col(column))).alias("suspicious"), F.median(F.when(~F.col("suspicious"), F.col(column))).alias("legit"))
    return med.withColumn("separation", F.col("suspicious") - F.col("legit"))


def first_hits(steps: DataFrame, sets: DataFrame, key: list[str]) -> DataFrame:
    """``*key, account_id, day, walk, length, hit``: where walks first meet each of many sets (``*key, account_id``).

    ``steps`` are those of ``random_walks`` without a set. Draws don't depend on the set, so the walks are made
    once and the rows are those that ``random_walks`` gives for each set.
    """
    met = steps.join(sets.select(*key, F.col("account_id").alias("hit")).distinct(), "hit").where(F.col("hit") != F.col("account_id"))
    return met.groupBy(*key, "account_id", "day", "walk").agg(F.min("length").alias("length"), F.min_by("hit", "length").alias("hit"))


def separation_grid(hits: DataFrame, groups: DataFrame, grid: list[tuple[int, float]], n_walks: int) -> DataFrame:
    """``delay, threshold, suspicious, legit, separation``: medians of the hit rate in each cell of ``grid``.

    ``hits`` are ``first_hits`` by delay and threshold, of one day for each account; accounts of ``groups`` that
    no walk of a cell reaches from count as 0 there.
    """
    cells = F.array(*[F.struct(F.lit(d).alias("delay"), F.lit(float(t)).alias("threshold")) for d, t in grid])
    rate = hits.groupBy("delay", "threshold", "account_id").agg((F.count("*") / n_walks).alias("rate"))
    rows = groups.withColumn("g", F.explode(cells)).select("account_id", "suspicious", "g.*").join(rate, ["delay", "threshold", "account_id"], "left").withColumn("rate", F.coalesce("rate", F.lit(0.0)))
    med = rows.groupBy("delay", "threshold").agg(F.median(F.when(F.col("suspicious"), F.col("rate"))).alias("suspicious"), F.median(F.when(~F.col("suspicious"), F.col("rate"))).alias("legit"))
    return med.withColumn("separation", F.col("suspicious") - F.col("legit"))


def fair_groups(account_days: DataFrame, w: int) -> DataFrame:
    """``account_id, suspicious``: accounts with a labelled day in the last ``w`` days, which the last
    snapshot still holds, and accounts with a day without a label; an account can be in both."""
    last = F.broadcast(account_days.agg(F.max("day").alias("_last")))
    rows = account_days.select("account_id", "day", F.coalesce("label", F.lit(False)).alias("suspicious")).crossJoin(last)
    return rows.where(~F.col("suspicious") | (F.col("day") > F.col("_last") - w)).select("account_id", "suspicious").distinct()


def share_of_reference(separation: DataFrame, reference: DataFrame) -> DataFrame:
    """``separation`` with ``reference``, that of the true labels, and the share of it that is left."""
    one = F.broadcast(reference.select(F.col("separation").alias("reference")))
    return separation.crossJoin(one).withColumn("share", F.col("separation") / F.nullif("reference", F.lit(0.0)))


def by_distance(features: DataFrame, chosen: DataFrame) -> DataFrame:
    """Median hit rate and mean length at each distance of ``chosen`` accounts, walked on the snapshot of their
    distances, and ``falls``: whether the rate is no higher than at the distance before."""
    got = features.join(chosen, "account_id").groupBy("distance").agg(F.count("*").alias("accounts"), F.median("gw_hit_rate").alias("median_hit_rate"), F.median("gw_mean").alias("median_length"))
    return got.withColumn("falls", F.col("median_hit_rate") <= F.lag("median_hit_rate").over(W.orderBy("distance")))  # a row a distance


def at_distances(distances: DataFrame, per_distance: int = 15, most: int = 4) -> DataFrame:
    """``account_id, distance`` of up to ``per_distance`` accounts at each distance from 1 to ``most``, by a hash."""
    n = F.row_number().over(W.partitionBy("distance").orderBy(F.md5(F.col("account_id").cast("binary")), "account_id"))
    return distances.where(F.col("distance").between(1, most)).withColumn("_n", n).where(F.col("_n") <= per_distance).drop("_n")
