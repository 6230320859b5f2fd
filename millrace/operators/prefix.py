"""Running sums over long series: a two-level scan, so that no task sorts a whole series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.lineage import cut, parts


def running(df: DataFrame, series: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """df with the sum of each column over the rows of the series so far, this one included, as SQL's sum: null until there is a value.

    Rows are dealt into ranges of (series, order) of a bounded number of rows, so that a long series lies in several; each range sums up its own rows, and what the ranges before it in
    the series have summed up is added. Ranges are checkpointed, as their bounds are sampled. A series has one such carry for each further range that it
    reaches into, so there are fewer carries than ranges, and they are broadcast. Rows that agree in series and order have some order among themselves.
    """
    d = df.withColumns({f"_x_{k}": c for k, c in sums.items()})
    d = d.repartitionByRange(parts(df), *series, *order).withColumn("_p", F.spark_partition_id())
    own = Window.partitionBy("_p", *series).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = cut(d.withColumns({k: F.sum(f"_x_{k}").over(own) for k in sums}))
    total = d.groupBy("_p", *series).agg(*(F.sum(f"_x_{k}").alias(f"_c_{k}") for k in sums))
    ranges = Window.partitionBy(*series).orderBy("_p")
    before = ranges.rowsBetween(Window.unboundedPreceding, -1)
    carry = total.withColumn("_before", F.lag("_p").over(ranges)).withColumns({f"_c_{k}": F.sum(f"_c_{k}").over(before) for k in sums}).where("_before is not null")
    carry = carry.select(F.col("_p").alias("_q"), *(F.col(c).alias(f"_s_{i}") for i, c in enumerate(series)), *(f"_c_{k}" for k in sums))
    on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_s_{i}")) for i, c in enumerate(series)), F.col("_p") == F.col("_q"))
    j = d.join(F.broadcast(carry), on, "left")
    j = j.withColumns({k: F.coalesce(F.col(k) + F.col(f"_c_{k}"), f"_c_{k}", k) for k in sums})
    return j.drop("_p", "_q", *(f"_s_{i}" for i in range(len(series))), *(f"_{x}_{k}" for k in sums for x in "xc"))
