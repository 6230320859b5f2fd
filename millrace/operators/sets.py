"""Top-k, sampling, splits and set operations. Anything random is a hash of the row's key and a seed, so that it is the same on every run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.lineage import cut, parts


def top_k(df: DataFrame, keys: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def best(df: DataFrame, order: list, n: int = 1) -> DataFrame:
    return df.orderBy(*order).limit(n)


def _unit(keys: list[str], seed: int) -> Column:
    """A number in [0, 1) from the keys and the seed: the first 28 bits of an MD5, so that other engines can draw the same parts."""
    digest = F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in keys), F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("double") / float(1 << 28)


def split_random(df: DataFrame, keys: list[str], shares: list[float], seed: int = 0, name: str = "part") -> DataFrame:
    """df with the number of its part, drawn with the given shares by hash."""
    u, at, part = _unit(keys, seed), 0.0, F.lit(len(shares) - 1)
    for i in range(len(shares) - 2, -1, -1):
        at = sum(shares[: i + 1]) / sum(shares)
        part = F.when(u < at, i).otherwise(part)
    return df.withColumn(name, part)


def position(df: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """df with the row's place from 0 in a total order, without bringing all rows to one task: rows are range-partitioned, and each range is numbered
    from where those before it end. The ranges are checkpointed, as bounds are sampled and would differ if they were drawn again."""
    d = cut(df.repartitionByRange(parts(df), *order).withColumn("_p", F.spark_partition_id()))
    w = Window.partitionBy("_p").orderBy(*order)
    sizes = d.groupBy("_p").count().withColumn("_start", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    return d.withColumn("_n", F.row_number().over(w) - 1).join(F.broadcast(sizes), "_p").withColumn(name, (F.col("_start") + F.col("_n")).cast("long")).drop("_p", "_n", "_start")


def split_position(df: DataFrame, order: list[str], shares: list[float], name: str = "part") -> DataFrame:
    """df with the number of its part by place in the order: 80/20 and 70/15/15 splits. Part ends are rounded down to whole rows."""
    n = df.count()
    ends = [int(n * sum(shares[: i + 1]) / sum(shares) + 1e-9) for i in range(len(shares) - 1)]
    d = position(df, order, "_pos")
    return d.withColumn(name, reduce(lambda a, b: a + b, ((F.col("_pos") >= e).cast("int") for e in ends), F.lit(0))).drop("_pos")


def split_date(df: DataFrame, date: str, at) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(date) < F.lit(at)), df.where(F.col(date) >= F.lit(at))


def time_folds(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """df with block 0..k in time order; fold i trains on blocks up to i and validates on block i + 1. The first block takes a remainder."""
    n = df.count()
    size = n // (k + 1)
    first = n - size * k
    d = position(df, order, "_pos")
    block = F.when(F.col("_pos") < first, 0).otherwise(F.floor((F.col("_pos") - first) / max(1, size)) + 1)
    return d.withColumn("block", block.cast("int")).drop("_pos")


def fold(df: DataFrame, i: int) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col("block") <= i), df.where(F.col("block") == i + 1)


#: Rows that may be sorted in one task to find where a sample ends.
FEW = 10_000
#: Bits of a hash by which rows are counted at a time.
_BITS = 14


def _some_of(df: DataFrame, n: int) -> DataFrame:
    """n rows of a table whose rows need not be told apart: each task's rows are numbered from where those of the tasks before end."""
    d = cut(df.withColumn("_p", F.spark_partition_id()))
    own = Window.partitionBy("_p").orderBy("_p")
    starts = d.groupBy("_p").count().withColumn("_start", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    return d.withColumn("_n", F.row_number().over(own)).join(F.broadcast(starts), "_p").where(F.col("_start") + F.col("_n") <= n).drop("_p", "_n", "_start")


def sample_rows(df: DataFrame, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows, or all: those with the least hashes of the keys and the seed, ties by the keys.

    Rows are counted by the leading bits of their hash; in the one bucket in which the n-th row lies they are counted by the next bits, until at most FEW rows
    are left, which are sorted. Then the n-th row is known, and the sample is a filter of the table, without a sort or shuffle, whatever n is. Only if several
    rows have the n-th one's keys does it take some of these besides.
    """
    h = F.xxhash64(*keys, F.lit(seed))
    bits = h.bitwiseXOR(F.lit(-(1 << 63)))  # hashes in order have these in order as unsigned numbers
    if n <= 0:
        return df.limit(0)
    below, at, shift, size = 0, F.lit(True), 64, None
    while size is None or size > FEW and shift > 0:
        step = min(_BITS, shift)
        shift -= step
        bucket = F.shiftrightunsigned(bits, shift)
        counts = sorted(df.where(at).groupBy(bucket.alias("b")).count().collect(), key=lambda r: r.b % (1 << 64))  # at most 2^_BITS rows
        for r in counts:
            if below + r["count"] >= n:
                at, size = bucket == r.b, r["count"]
                break
            below += r["count"]
        else:
            return df  # there are not so many
    last = df.where(at).select(h.alias("_h"), F.struct(*keys).alias("_k")).orderBy("_h", "_k").limit(n - below)
    key = F.struct(h.alias("_h"), F.struct(*keys).alias("_k"))
    edge = last.agg(F.max(F.struct("_h", "_k")).alias("e")) if size <= FEW else _key_at(df.where(at), h, keys, n - below)
    edge = cut(edge.select("e"))
    marked = df.join(F.broadcast(edge))
    inside, same = marked.where(key < F.col("e")).drop("e"), marked.where(key == F.col("e")).drop("e")
    missing = n - inside.count()
    return inside.unionByName(same if same.limit(missing + 1).count() <= missing else _some_of(same, missing))


def _key_at(df: DataFrame, h: Column, keys: list[str], n: int) -> DataFrame:
    """The (hash, keys) of the n-th row in their order, where more than FEW rows share one hash: equal keys are counted, then summed up over ranges."""
    from millrace.operators.prefix import running

    counts = df.groupBy(h.alias("_h"), F.struct(*keys).alias("_k")).agg(F.count("*").alias("_n"))
    up = running(counts, [], ["_h", "_k"], {"_up": F.col("_n")})
    return up.where(F.col("_up") >= n).agg(F.min(F.struct("_h", "_k")).alias("e"))


def balance(df: DataFrame, label: str, keys: list[str], seed: int = 0) -> DataFrame:
    """Larger classes cut down to the smallest one's count."""
    counts = {r[label]: r["count"] for r in df.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    n = min(counts.values(), default=0)
    parts = [df.where(F.col(label) == v) if c == n else sample_rows(df.where(F.col(label) == v), keys, n, seed) for v, c in counts.items()]
    return reduce(DataFrame.unionByName, parts) if parts else df.limit(0)


def class_weight(df: DataFrame, label: str) -> DataFrame:
    """One row: negatives over positives."""
    return df.agg(F.try_divide(F.count(F.when(F.col(label) == 0, 1)), F.count(F.when(F.col(label) == 1, 1))).alias("weight"))


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def compare_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """The distinct rows of two tables with one set of columns, and `side`: first, second or both. Null is a value. Sets stay tables; no row holds one."""
    mark = lambda d, k: d.select(*a.columns).distinct().withColumn("_m", F.lit(k))
    d = mark(a, 1).unionByName(mark(b, 2)).groupBy(*a.columns).agg(F.sum("_m").alias("_m"))
    return d.select(*a.columns, F.when(F.col("_m") == 1, "first").when(F.col("_m") == 2, "second").otherwise("both").alias("side"))


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return top_k(df, keys, order, 1, "_rank").drop("_rank")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows equally often, in whatever order. Fewer than all rows are compared once one differs."""
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
