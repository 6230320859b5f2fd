"""Centroid clustering: Lloyd rounds over integer vectors whose nearest centroids are found by the threshold algorithm."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common as C
from millrace.llm import vectors as V

#: Vectors whose lists are walked at a time.
BLOCK = 1024
_FAR = np.int64(1) << 62


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of v the number of its nearest centroid (ties: the smaller) and the squared distance.

    Threshold algorithm: each dimension has the centroids in order of their value there. From a vector's own value every list is walked outward, one entry a
    step; a centroid met for the first time is compared exactly. What no list has met yet is in every dimension at least as far as the list's next entry, so
    once the squares of these frontier distances add up to more than the best distance found, no other centroid can be nearer or tie, and the walk ends.
    """
    k, d = centroids.shape
    order = np.argsort(centroids, 0, kind="stable").T  # of each dimension
    value = np.take_along_axis(centroids.T, order, 1)
    padded = np.concatenate((np.full((d, 1), -_FAR), value, np.full((d, 1), _FAR)), 1)  # entry i is at i + 1
    dims = np.arange(d)
    cluster, distance = np.empty(len(v), np.int64), np.empty(len(v), np.int64)
    for at in range(0, len(v), BLOCK):
        x = v[at : at + BLOCK]
        hi = np.stack([np.searchsorted(value[j], x[:, j]) for j in range(d)], 1) + 1  # next entry upward
        lo = hi - 1  # next entry downward
        best = np.full((len(x), k), _FAR)
        open_ = np.arange(len(x))
        while len(open_):
            own, l, h = x[open_], lo[open_], hi[open_]
            down, up = own - padded[dims, l], padded[dims, h] - own
            lower = down <= up
            met = order[dims, np.where(lower, l, h) - 1]
            seen = np.zeros((len(open_), k), bool)
            seen[np.arange(len(open_))[:, None], met] = True
            row, c = np.nonzero(seen & (best[open_] == _FAR))
            best[open_[row], c] = ((own[row] - centroids[c]) ** 2).sum(1)
            l, h = l - lower, h + ~lower
            lo[open_], hi[open_] = l, h
            frontier = np.minimum(own - padded[dims, l], padded[dims, h] - own)
            ended = (l == 0) & (h == k + 1)  # a list that has been walked through has met every centroid
            bound = np.where(ended, 0, frontier)
            going = ~ended.any(1) & ((bound * bound).sum(1) <= best[open_].min(1))
            open_ = open_[going]
        cluster[at : at + BLOCK] = best.argmin(1)
        distance[at : at + BLOCK] = best.min(1)
    return cluster, distance


def _sums(centroids: np.ndarray):
    """Per task one row for each centroid that a vector was assigned to: how many and their component sums."""
    k, d = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]):
        n, s = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        for b in batches:
            if b.num_rows:
                v = V.matrix(b.column("v"))
                c, _ = nearest(v, centroids)
                n += np.bincount(c, minlength=k)
                np.add.at(s, c, v)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used]), pa.array(list(s[used]), pa.list_(pa.int64()))], ["cluster", "n", "s"])

    return C.lean(run)


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if b.num_rows:
                c, d = nearest(V.matrix(b.column("v")), centroids)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(c.astype(np.int32)), pa.array(d)], ["vec_id", "cluster", "distance"])

    return C.lean(run)


def centroid_clusters(df: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64, seed: int = 1, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of `dims` finite components, each taken as floor(scale * x).

    Centroids start as the k rows with the least SHA-256 of '<seed>:<vec_id>', in that order. A round assigns all vectors and moves each centroid that has any
    to their exact floor(sum / count); after the rounds vectors are assigned once more. Tasks send one row of sums for each centroid; k * dims numbers meet.

    Defined results: rows with a null, shorter or longer vector, or a null or non-finite component, are left out; a null vec_id comes last among the starts
    and keeps its row; repeated rows are vectors of their own; rows with equal hashes are ordered by vector; with fewer than k rows there are as many
    centroids as rows; an empty table gives an empty result; further columns are not read. A component of 2^27 and more after scaling is an error.
    """
    base = C.written(V.integers(df, scale, id_col, vec_col).where(F.size("v") == dims), "clustered-vectors")
    first = base.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "v").limit(k).collect()
    kinds = "vec_id long, cluster int, distance long"
    if not first:
        return base.select("vec_id", F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256")).limit(0)
    centroids = np.array([r.v for r in first], np.int64)
    for _ in range(rounds):
        got = V.summed(base.mapInArrow(_sums(centroids), "cluster int, n long, s array<long>"), ["cluster"], dims)
        for (c,), (n, s) in got.items():
            centroids[c] = [x // n for x in s]
    done = C.written(base.mapInArrow(_assigned(centroids), kinds), "clusters")
    inertia = {r.cluster: r.i for r in done.groupBy("cluster").agg(F.sum("distance").alias("i")).collect()}  # at most k rows
    rows = [(c, i, sum(inertia.values()), V.digest(centroids[c])) for c, i in inertia.items()]
    about = done.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
