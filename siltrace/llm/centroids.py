"""Centroid clustering with Elkan's bounds, exact in integers.

Every vector carries an upper bound of the distance to its centroid and a lower bound of that to
each centroid. When centroids move, bounds are widened by how far, and a distance is computed only
where bounds and the distances between centroids leave a doubt. Bounds are floating-point numbers
rounded away from the truth, and only a strictly farther centroid is ruled out, so rounding and
ties never change a result: whatever is compared in the end are exact integers.

Vectors stay on the executors. A round sends the centroids and how far they moved (``k`` rows) out,
and brings ``k`` sums of components back, added up by Spark first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltrace.session import stored

LARGEST = 1 << 27  # of a component, so that squared distances of 64 components fit in 64 bits
_SLACK = 2.0**-40


def _up(x):
    return x * (1 + _SLACK)


def _down(x):
    return np.maximum(x * (1 - _SLACK), 0)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of two integer arrays."""
    d = a.astype(np.int64) - b
    return np.einsum("...i,...i->...", d, d)


def between(centroids: np.ndarray) -> np.ndarray:
    """Half the distance of each two centroids, rounded down."""
    return _down(np.sqrt(squared(centroids[:, None], centroids[None]).astype(float)) / 2)


def assign(v: np.ndarray, c: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, half: np.ndarray) -> int:
    """Moves each row of ``v`` to its nearest centroid (ties: the smaller number), in place.

    ``c``, ``upper`` and ``lower`` hold for these centroids already. Returns how many distances
    were computed.
    """
    exact = np.full(len(v), -1, np.int64)  # squared distance to the own centroid, where known
    computed = 0
    for k in range(len(centroids)):
        open_ = np.flatnonzero((c != k) & (upper >= lower[:, k]) & (upper >= half[c, k]))
        loose = open_[exact[open_] < 0]
        if len(loose):
            exact[loose] = squared(v[loose], centroids[c[loose]])
            root = np.sqrt(exact[loose].astype(float))
            upper[loose], lower[loose, c[loose]] = _up(root), _down(root)
            computed += len(loose)
            open_ = open_[(upper[open_] >= lower[open_, k]) & (upper[open_] >= half[c[open_], k])]
        if not len(open_):
            continue
        d = squared(v[open_], centroids[k])
        computed += len(open_)
        root = np.sqrt(d.astype(float))
        lower[open_, k] = _down(root)
        better = (d < exact[open_]) | ((d == exact[open_]) & (k < c[open_]))
        at = open_[better]
        c[at], exact[at], upper[at] = k, d[better], _up(root[better])
    return computed


def widened(c: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray) -> None:
    """Makes the bounds hold after centroids moved by ``moved`` at most."""
    upper[:] = _up(upper + moved[c])
    lower[:] = _down(lower - moved)


def _matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    """Rows of equal size from a binary column."""
    if not len(column):
        return np.zeros((0, width), kind)
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(len(column), width)


def _binary(rows: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(rows)
    size = raw.shape[1] * raw.itemsize
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(np.arange(len(raw) + 1, dtype=np.int32) * size), pa.py_buffer(raw)])


_NAMES = ["id", "v", "c", "u", "l"]


def _started(batches, size: int, k: int):
    """Integer vectors with bounds that say nothing yet."""
    for batch in batches:
        values = batch.column(1)
        v = np.asarray(values.flatten()).reshape(len(values), size)
        if len(v) and max(-int(v.min()), int(v.max())) > LARGEST:
            raise ValueError(f"a component lies beyond {LARGEST} after scaling")
        n = len(v)
        yield pa.RecordBatch.from_arrays([batch.column(0), _binary(v.astype(np.int32)), pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, np.inf)), _binary(np.zeros((n, k)))], names=_NAMES)


def _round(batches, centroids: np.ndarray, moved: np.ndarray):
    k, size = centroids.shape
    half = between(centroids)
    for batch in batches:
        v = _matrix(batch.column(1), np.int32, size)
        c, upper, lower = np.array(batch.column(2)), np.array(batch.column(3)), _matrix(batch.column(4), float, k).copy()
        widened(c, upper, lower, moved)
        assign(v, c, upper, lower, centroids, half)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(c), pa.array(upper), _binary(lower)], names=_NAMES)


def _sums(batches, k: int, size: int):
    """One row for each centroid and component of a partition; component -1 counts the vectors."""
    total = np.zeros((k, size + 1), np.int64)
    for batch in batches:
        v, c = _matrix(batch.column(0), np.int32, size), np.asarray(batch.column(1))
        for j in range(k):
            mine = v[c == j]
            total[j, 0] += len(mine)
            total[j, 1:] += mine.sum(0, dtype=np.int64)
    rows, at = np.divmod(np.arange(total.size), size + 1)
    yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array((at - 1).astype(np.int32)), pa.array(total.ravel())], names=["c", "j", "s"])


def _distances(batches, centroids: np.ndarray):
    for batch in batches:
        v, c = _matrix(batch.column(1), np.int32, centroids.shape[1]), np.asarray(batch.column(2))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(squared(v, centroids[c]))], names=["id", "cluster", "distance"])


def cluster(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: str = "3") -> DataFrame:
    """``id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each vector.

    Vectors of exactly ``size`` components, none null or non-finite, take part as the integers
    ``floor(scale * x)``; others, null vectors among them, have no row. The first centroids are the
    ``k`` vectors with the smallest SHA-256 of ``<seed>:<id>``; rows with one id follow one
    another by their vectors, and a null id comes last. With fewer vectors there are fewer
    centroids, and an empty table gives no rows. Each round assigns all vectors, ties to the smaller
    number, and takes a centroid to the floor of its vectors' mean; a centroid without vectors stays.
    Repeated rows and rows with a null id are vectors like others; other columns are not looked at.
    A component beyond ``LARGEST`` after scaling raises an error, as its squares would not fit.

    Vectors and bounds are cached on the executors, two rounds at a time; what a lost executor held is
    computed again from the table by maps without a shuffle.
    """
    x = F.col(vec_col)
    whole = x.isNotNull() & (F.size(x) == size) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    ints = table.where(whole).select(F.col(id_col).alias("id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("bigint")).alias("v"))
    first = ints.orderBy(F.when(F.col("id").isNotNull(), F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)).asc_nulls_last(), "v").limit(k).collect()
    kind = ints.schema["id"].dataType.simpleString()
    if not first:
        return table.sparkSession.createDataFrame([], f"id {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    centroids = np.array([r.v for r in first], np.int64)
    k = len(centroids)
    schema = f"id {kind}, v binary, c int, u double, l binary"
    now, moved = ints.mapInArrow(lambda b: _started(b, size, k), schema), np.zeros(k)
    for n in range(rounds + 1):
        held, now = now, now.mapInArrow(lambda b, at=centroids, by=moved: _round(b, at, by), schema).persist()
        if n < rounds:
            got = now.select("v", "c").mapInArrow(lambda b: _sums(b, k, size), "c int, j int, s bigint").groupBy("c", "j").agg(F.sum("s").alias("s")).collect()
            total = np.zeros((k, size + 1), np.int64)
            for r in got:
                total[r.c, r.j + 1] = r.s
            some = total[:, 0] > 0
            fresh = centroids.copy()
            fresh[some] = total[some, 1:] // total[some, :1]
            moved, centroids = _up(np.sqrt(squared(fresh, centroids).astype(float))), fresh
        else:
            out = stored(now.mapInArrow(lambda b, at=centroids: _distances(b, at), f"id {kind}, cluster int, distance bigint"), "clusters")
            now.unpersist()
        held.unpersist()
    inertia = {r.cluster: r.s for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    named = [(j, inertia.get(j, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(centroids)]
    per = table.sparkSession.createDataFrame(named, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return out.join(F.broadcast(per), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
