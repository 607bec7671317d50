"""Walks made once for many sets against walks towards each of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltrace.jobs.queries import Ledger
from siltrace.operators import labels, walks
from siltrace.session import checkpoint

SF = "/root/testdata/sf0.001"


def test_steps_and_sets_give_the_walks_of_each_set(spark):
    x = Ledger(spark, SF)
    scored, targets, ledger = checkpoint(x.scored), checkpoint(x.targets.limit(60)), checkpoint(x.ledger)
    sets = checkpoint(labels.hybrid_sets(scored, [1, 14], [0.25, 0.8]))
    steps = walks.random_walks(targets, ledger, None, 7, 4, 4)
    hits = walks.first_hits(steps, sets.union(sets), ["delay", "threshold"]).collect()
    for delay, threshold in ((1, 0.25), (14, 0.8)):
        alone = labels.hybrid_illicit(scored, delay, threshold)
        assert {r[0] for r in alone.collect()} == {r.account_id for r in sets.where((F.col("delay") == delay) & (F.col("threshold") == threshold)).collect()}
        one = walks.random_walks(targets, ledger, alone, 7, 4, 4).collect()
        key = lambda r: (r.account_id, r.day, r.walk, r.length, r.hit)
        assert sorted(map(key, one)) == sorted(key(r) for r in hits if (r.delay, r.threshold) == (delay, threshold))


def test_cells_without_hits_count_as_nothing(spark):
    hits = spark.createDataFrame([(1, 0.5, "A", 3, 0, 2, "Z"), (1, 0.5, "A", 3, 1, 1, "Z")], "delay int, threshold double, account_id string, day int, walk int, length int, hit string")
    groups = spark.createDataFrame([("A", True), ("A", False), ("B", False)], "account_id string, suspicious boolean")
    got = {(r.delay, r.threshold): (r.suspicious, r.legit, r.separation) for r in walks.separation_grid(hits, groups, [(1, 0.5), (2, 0.5)], 4).collect()}
    assert got == {(1, 0.5): (0.5, 0.25, 0.25), (2, 0.5): (0.0, 0.0, 0.0)}
    assert walks.separation_grid(hits, groups.limit(0), [(1, 0.5)], 4).count() == 0
