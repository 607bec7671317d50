from __future__ import annotations

import hashlib

import numpy as np
import pytest

from siltrace.llm import centroids as C

SCHEMA = "vec_id long, embedding array<float>, cluster string, v int"


def _brute(rows, k, rounds, size):
    """(id, cluster, distance) by looking at every centroid; and the final centroids."""
    kept = []
    for i, e in rows:
        if e is not None and len(e) == size and all(x is not None and np.isfinite(x) for x in e):
            kept.append((i, np.floor(1024 * np.array(e, np.float32).astype(float)).astype(np.int64)))
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1].tolist())
    c = [v for _, v in sorted(kept, key=key)[:k]]
    for n in range(rounds + 1):
        d = [[int(((v - x) ** 2).sum()) for x in c] for _, v in kept]
        at = [x.index(min(x)) for x in d]
        if n < rounds:
            for j in range(len(c)):
                mine = [v for (_, v), a in zip(kept, at) if a == j]
                if mine:
                    c[j] = np.array([int(s) // len(mine) for s in sum(mine)])
    return [(i, a, x[a]) for (i, _), a, x in zip(kept, at, d)], c


@pytest.mark.parametrize("seed,spread", [(1, 1.0), (2, 0.004), (3, 60.0)])
def test_equals_brute_force(spark, seed, spread):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.normal(size=4) * spread).astype(np.float32).tolist()) for i in range(120)]
    rows += rows[:20] + [(500 + i, rows[5][1]) for i in range(30)] + [(None, rows[7][1]), (None, None), (600, None), (601, [1.0] * 3), (602, [1.0] * 5), (603, [0.0, None, 0.0, 0.0]), (604, [0.0, float("nan"), 0.0, 0.0]), (605, [0.0, float("-inf"), 0.0, 0.0]), (7, [0.5] * 4)]
    table = spark.createDataFrame([(i, e, "x", 0) for i, e in rows], SCHEMA).repartition(3)
    got = C.cluster(table, k=5, rounds=4, size=4).collect()
    want, c = _brute(rows, 5, 4, 4)
    key = lambda r: (r[0] is None, r)
    assert sorted([(r.id, r.cluster, r.distance) for r in got], key=lambda r: str(r)) == sorted(want, key=lambda r: str(r))
    per = {j: sum(d for _, a, d in want if a == j) for j in range(5)}
    for r in got:
        assert r.cluster_inertia == per[r.cluster] and r.inertia == sum(per.values())
        assert r.centroid_sha256 == hashlib.sha256(",".join(str(int(x)) for x in c[r.cluster]).encode()).hexdigest()


def test_few_rows_and_none(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert C.cluster(none, size=2).collect() == []
    one = spark.createDataFrame([(1, [0.5, 0.25], "a", 1)] * 3 + [(2, None, None, None)], SCHEMA)
    assert {(r.id, r.distance) for r in C.cluster(one, size=2).collect()} == {(1, 0)}
    with pytest.raises(Exception, match="beyond"):
        C.cluster(spark.createDataFrame([(1, [1e9, 0.0], "a", 1)], SCHEMA), size=2)


def test_bounds_spare_distances_and_keep_ties():
    rng = np.random.default_rng(5)
    centers = rng.integers(-4000, 4000, (6, 16))
    v = (centers[rng.integers(0, 6, 3000)] + rng.integers(-40, 40, (3000, 16))).astype(np.int32)
    now = v[:6].astype(np.int64)
    c, upper, lower = np.zeros(3000, np.int32), np.full(3000, np.inf), np.zeros((3000, 6))
    computed = []
    for _ in range(6):
        computed.append(C.assign(v, c, upper, lower, now, C.between(now)))
        d = np.stack([C.squared(v, x) for x in now], 1)
        assert (c == d.argmin(1)).all()
        assert (upper >= np.sqrt(d[np.arange(3000), c])).all() and (lower <= np.sqrt(d)).all()
        fresh = np.stack([v[c == j].sum(0, dtype=np.int64) // max(1, (c == j).sum()) if (c == j).any() else now[j] for j in range(6)])
        C.widened(c, upper, lower, C._up(np.sqrt(C.squared(fresh, now).astype(float))))
        now = fresh
    assert computed[-1] < 3000 * 6 / 2
    even = np.array([[0], [2], [4], [1], [3]], np.int32)  # 1 and 3 lie between two centroids
    c, upper, lower = np.full(5, 2, np.int32), np.full(5, np.inf), np.zeros((5, 3))
    at = np.array([[0], [2], [4]])
    C.assign(even, c, upper, lower, at, C.between(at))
    assert c.tolist() == [0, 1, 2, 0, 1]
