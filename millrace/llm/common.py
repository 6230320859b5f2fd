"""What the operators of this subpackage share: table access, lineage cuts, and words of a batch as flat arrays."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.lineage import cut, shared_dir  # noqa: F401

#: Bytes of text that a task turns into arrays at a time; it bounds a Python worker's memory, not the work.
CHUNK_BYTES = 6 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of tables that this process has written and not yet removed.
_SCRATCH: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared folder and read again; for wide tables that several jobs read. `sweep` removes the tables."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SCRATCH.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch() -> int:
    """How many tables there are, for `sweep` to begin after them."""
    return len(_SCRATCH)


def sweep(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Removes the tables that `written` has made after the first `since`, all but the last `keep`; for when the results that read them have been written."""
    for path in _SCRATCH[since : len(_SCRATCH) - keep]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _SCRATCH.remove(path)


#: A table of ids is broadcast up to so many rows; beyond, the join is shuffled.
BROADCAST_ROWS = 1_000_000


def only(docs: DataFrame, ids: DataFrame, how: str = "left_semi", on: str = "doc_id") -> DataFrame:
    """docs with (or, left_anti, without) the ids in the column `on` of both; these are broadcast when few, whatever the table's size, and shuffled otherwise.

    The ids are looked at twice and so should be a written or checkpointed table."""
    key = ids.select(F.col(on).alias("_only"))  # a new column, as ids may come from docs
    return docs.join(F.broadcast(key) if key.count() <= BROADCAST_ROWS else key, F.col(on) == F.col("_only"), how)


def small(table: DataFrame) -> DataFrame:
    """A table that is computed once, and broadcast if a count shows that it has few rows."""
    table = cut(table)
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names, so that further columns cannot clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES, col: str = "text") -> Iterator[pa.RecordBatch]:
    """Row slices of the batches with about `limit` bytes of text each, a single longer text whole: operators hold up to about a hundred bytes of arrays for
    each byte of a slice, so a worker's memory bounds the longest text (20 MB of text take 2 GB)."""
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(b.column(col)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(size), 0
        while at < b.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield b.slice(at, to - at)
            at = to


def lean(run):
    """The function of batches, after which the worker gives back what it no longer uses: workers outlive tasks, and allocators keep what they have been given."""

    def lean_run(batches):
        try:
            yield from run(batches)
        finally:
            _POWERS[:] = [p[:1].copy() for p in _POWERS]
            pa.default_memory_pool().release_unused()
            _trim()

    return lean_run


def _trim() -> None:
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library than glibc
        pass


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column back to back, and the offsets of its rows; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "").cast(pa.large_string())
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off - off[0]


#: ASCII white space: space and \t\n\v\f\r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the runs of bytes other than ASCII white space; none crosses a row."""
    n = len(raw)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    gap = SPACE[raw]
    full = np.flatnonzero(np.diff(off) > 0)
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = gap[:-1], gap[1:]
    before[off[full]] = True
    after[off[full + 1] - 1] = True
    start = np.flatnonzero(~gap & before)
    return start, np.flatnonzero(~gap & after) + 1, np.searchsorted(off, start, "right") - 1


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n + n // 4, base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.cumprod(p, dtype=np.uint64, out=p)
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """Sums of byte values times rising powers: a span's hash is a difference of two, whatever its length."""
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _powers(len(raw) + 1)[0][: len(raw)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans; equal for equal bytes wherever they stand."""
    return mix((sums[end] - sums[start]) * _powers(len(sums))[1][start] + (end - start).astype(np.uint64))


def per_row(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    got = np.bincount(rows, weights, minlength=n)
    return got.astype(np.int64) if weights is None or weights.dtype.kind in "bi" else got


def repeated(key: np.ndarray) -> np.ndarray:
    """Which entries have a value that occurs more than once."""
    order = np.argsort(key)
    s = key[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    out = np.empty(len(s), bool)
    out[order] = same[1:] | same[:-1]
    return out


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return raw + (((raw >= 65) & (raw <= 90)).astype(np.uint8) << 5)
