"""Vectors: lengths, distances, and exact nearest neighbours over a partitioned index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.lineage import cut

#: Cells of the index. Their pivots are the rows with the least hashes; every row belongs to the cell of its nearest pivot.
PIVOTS = 128
#: Cells in which a query looks first, for a bound on its distances.
PROBES = 2
#: Base rows and queries that one group holds; a cell with more is dealt into several.
ROWS, QUERIES = 8192, 4096
#: Distances that a task computes at a time.
_CELLS = 1 << 16


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.try_divide(x.cast("double"), norm))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def _matrix(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a[:, None] - b) ** 2).sum(2))


def _to_pivots(pivots: np.ndarray, nearest: bool):
    """Adds to each row its distances to all pivots, or the nearest pivot's number and distance."""

    def run(batches: Iterator[pa.RecordBatch]):
        step = max(1, _CELLS // len(pivots))
        for b in batches:
            for at in range(0, b.num_rows, step):
                c = b.slice(at, step)
                d = _distances(_matrix(c.column("vector")), pivots)
                more = [pa.array(d.argmin(1).astype(np.int32)), pa.array(d.min(1))] if nearest else [pa.array(list(d), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*c.columns, *more], [*c.schema.names, *(["cell", "r"] if nearest else ["d"])])

    return run


def _labels(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The labels of both sides as numbers, -1 for null."""
    both = pa.chunked_array([*a.chunks, *b.chunks], a.type).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return both[: len(a)], both[len(a) :]


def _met(k: int, exclude: bool):
    """The k nearest of a group's base rows for each of its queries, ties by id. Base rows stand in order of their distance from the pivot, so that by the
    triangle inequality a query need only look at those whose distance differs from its own by its bound at most."""

    def run(q: pa.Table, base: pa.Table) -> pa.Table:
        out = []
        if q.num_rows and base.num_rows:
            q, base = q.sort_by("d"), base.sort_by("id")
            order = np.argsort(base.column("r").to_numpy(), kind="stable")
            ids, r, v = base.column("id").to_numpy()[order], base.column("r").to_numpy()[order], _matrix(base.column("vector"))[order]
            mine, other = _labels(q.column("label"), base.column("label")) if exclude else (None, None)
            other = other[order] if exclude else None
            qid, d, bound, qv = q.column("query").to_numpy(), q.column("d").to_numpy(), q.column("bound").to_numpy(), _matrix(q.column("vector"))
            step = max(1, _CELLS // len(ids))
            for at in range(0, len(qid), step):
                own = slice(at, min(len(qid), at + step))
                slack = 1e-9 * (1 + d[own])
                lo, hi = np.searchsorted(r, (d[own] - bound[own] - slack).min()), np.searchsorted(r, (d[own] + bound[own] + slack).max(), "right")
                if lo == hi:
                    continue
                near = _distances(qv[own], v[lo:hi])
                if exclude:
                    near = np.where((mine[own, None] != other[lo:hi]) & (mine[own, None] >= 0) & (other[lo:hi] >= 0), near, np.inf)
                some = ids[lo:hi]
                by_id = np.argsort(some, kind="stable")
                first = by_id[np.argsort(near[:, by_id], 1, kind="stable")[:, :k]]
                dist = np.take_along_axis(near, first, 1)
                row, col = np.nonzero(np.isfinite(dist))
                out.append((qid[own][row], some[first[row, col]], dist[row, col]))
        names = ["query", "neighbour", "distance"]
        return pa.table([np.concatenate(x) for x in zip(*out, strict=True)], names) if out else pa.table([pa.array([], pa.int64())] * 2 + [pa.array([], pa.float64())], names)

    return run


def _search(q: DataFrame, base: DataFrame, rows: list[int], k: int, exclude: bool) -> DataFrame:
    """(query, neighbour, distance) of the k nearest in each group for queries (query, vector, label, cell, d, bound), d being the distance to the cell's
    pivot. A cell of many rows or queries becomes several groups, so that none holds more than ROWS and QUERIES (give or take what hashing deals unevenly)."""
    asked = {r.cell: r["count"] for r in q.groupBy("cell").count().collect()}  # at most PIVOTS rows
    parts = lambda counts, most: F.get(F.array(*(F.lit(max(1, -(-counts.get(c, 0) // most))) for c in range(len(rows)))), F.col("cell"))
    nb, nq = parts(dict(enumerate(rows)), ROWS), parts(asked, QUERIES)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    a = q.select("*", F.pmod(F.xxhash64("query"), nq).cast("int").alias("_q"), every(nb).alias("_b"))
    b = base.where(F.col("cell").isin(list(asked))).select("*", F.pmod(F.xxhash64("id"), nb).cast("int").alias("_b"), every(nq).alias("_q"))
    return a.groupBy("cell", "_b", "_q").cogroup(b.groupBy("cell", "_b", "_q")).applyInArrow(_met(k, exclude), "query long, neighbour long, distance double")


def knn(queries: DataFrame, base: DataFrame, k: int, key: str, vector: str, exclude: str | None = None) -> DataFrame:
    """The k nearest rows of the base for every query by L2 distance, exactly; rows that share the query's `exclude` value (or have none) are left out; ties by
    key. key is an integer; a row without a vector is left out on both sides.

    An index deals all base rows to the cells of PIVOTS sampled rows. Each query first looks into its PROBES nearest cells, and then, with the k-th distance
    found there as its bound, into those cells that by the triangle inequality may hold something as near. Queries and rows meet in shuffled groups of
    bounded size; the driver sees the pivots and a row of counts for each.
    """
    label = lambda: (F.col(exclude) if exclude else F.lit(None).cast("int")).alias("label")
    shape = lambda d, name: d.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias(name), F.col(vector).cast("array<double>").alias("vector"), label())
    q, b = shape(queries, "query"), shape(base, "id")
    best = Window.partitionBy("query").orderBy("distance", "neighbour")
    ranked = lambda d: d.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    chosen = b.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()
    kind = q.schema["label"].dataType.simpleString()
    if not chosen:
        return ranked(b.select(F.col("id").alias("query"), F.col("id").alias("neighbour"), F.lit(0.0).alias("distance")).limit(0))
    pivots = np.array([r.vector for r in chosen])
    b = cut(b.mapInArrow(_to_pivots(pivots, True), f"id long, vector array<double>, label {kind}, cell int, r double"))
    about = {r.cell: r for r in b.groupBy("cell").agg(F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi")).collect()}
    rows = [about[c].n if c in about else 0 for c in range(len(pivots))]
    near, far = (F.array(*(F.lit(about[c][x]) for c in sorted(about))) for x in ("lo", "hi"))
    full = F.array(*map(F.lit, sorted(about)))
    q = cut(q.mapInArrow(_to_pivots(pivots, False), f"query long, vector array<double>, label {kind}, d array<double>"))
    # The cells with rows, each with the query's distance to the pivot and the least that a row there can have.
    cells = F.transform(full, lambda c, i: F.struct(F.greatest(F.lit(0.0), F.get("d", c) - F.get(far, i), F.get(near, i) - F.get("d", c)).alias("least"), F.get("d", c).alias("d"), c.alias("cell")))
    first = q.select("query", "vector", "label", F.explode(F.slice(F.array_sort(F.transform(cells, lambda x: F.struct(x["d"].alias("d"), x["cell"].alias("cell")))), 1, PROBES)).alias("c"))
    home = cut(first.select("query", "vector", "label", "c.cell", "c.d", F.lit(float("inf")).alias("bound")))
    found = cut(ranked(_search(home, b, rows, k, exclude is not None)).drop("rank"))
    bound = found.groupBy("query").agg(F.count("*").alias("n"), F.max("distance").alias("bound")).where(F.col("n") >= k).select(F.col("query").alias("_query"), "bound")
    rest = q.join(bound, F.col("query") == F.col("_query"), "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    rest = rest.select("query", "vector", "label", "bound", F.explode(cells).alias("c")).where(F.col("c.least") <= F.col("bound") * (1 + 1e-9) + 1e-9)
    rest = rest.select("query", "vector", "label", "c.cell", "c.d", "bound").join(home.select("query", "cell"), ["query", "cell"], "left_anti")
    return ranked(found.unionByName(_search(cut(rest), b, rows, k, exclude is not None)))
