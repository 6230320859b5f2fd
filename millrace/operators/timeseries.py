"""Rolling statistics of the last p rows of a group, lags, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.prefix import running

from millrace.functions.numeric import bias_free_kurtosis, bias_free_skew


def _longest(a: Column, holds) -> Column:
    """Length of the longest run of entries of the array for which holds(value, index) is true."""
    run = F.aggregate(
        F.transform(a, holds),
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")),
        lambda s, x: F.struct(F.when(x, s["now"] + 1).otherwise(0).alias("now"), F.greatest(s["best"], F.when(x, s["now"] + 1).otherwise(0)).alias("best")),
    )
    return run["best"]


def _mean(a: Column) -> Column:
    return F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a))


def statistics(x: Column, w, index: Column) -> dict[str, Column]:
    """Every statistic over a window, by name. x: the value as double; index: the row number in the group."""
    a, n = F.collect_list(x).over(w), F.count(x).over(w)
    step = lambda sign: F.transform(F.slice(F.col("_values"), 1, F.greatest(F.size("_values") - 1, F.lit(0))), lambda v, i: (F.get(F.col("_values"), i + 1) - v) * sign)
    return {
        "_values": a,
        "mean": F.avg(x).over(w),
        "median": F.percentile(x, F.lit(0.5)).over(w),
        "sum": F.coalesce(F.sum(x).over(w), F.lit(0.0)),
        "std": F.stddev(x).over(w),
        "max": F.max(x).over(w),
        "min": F.min(x).over(w),
        "kurtosis": bias_free_kurtosis(n, F.kurtosis(x).over(w)),
        "skewness": bias_free_skew(n, F.when(F.var_pop(x).over(w) > 0, F.skewness(x).over(w)).otherwise(0.0)),
        "quant_90": F.percentile(x, F.lit(0.9)).over(w),
        "quant_10": F.percentile(x, F.lit(0.1)).over(w),
        "trend": F.regr_slope(x, index).over(w),
        "size": n,
        "count_above_zero": F.sum(F.when(x > 0, 1).otherwise(0)).over(w),
        "minmax_std": F.stddev(x).over(w) > (F.max(x).over(w) - F.min(x).over(w)) / 2,
        "longest_period_above_mean": _longest(F.col("_values"), lambda v: v > F.col("_mean")),
        "longest_period_below_mean": _longest(F.col("_values"), lambda v: v < F.col("_mean")),
        "longest_consecutive_decreases": _longest(step(-1), lambda v: v > 0),
        "longest_consecutive_increases": _longest(step(1), lambda v: v > 0),
        "last_max": F.size("_values") - F.array_position("_values", F.array_max("_values")) + 1,
        "last_min": F.size("_values") - F.array_position("_values", F.array_min("_values")) + 1,
        "list": F.col("_values"),
    }


_FOLDS = ("longest_period_above_mean", "longest_period_below_mean", "longest_consecutive_decreases", "longest_consecutive_increases", "last_max", "last_min", "list")


def per_date(df: DataFrame, target: str, groups: list[str], date: str) -> DataFrame:
    """The target summed over rows of one group and date; a sum over nulls only is 0."""
    return df.groupBy(*groups, date).agg(F.coalesce(F.sum(target), F.lit(0)).cast("double").alias("_x"))


def rolling(df: DataFrame, target: str, groups: list[str], date: str, period: int, ops: list[str]) -> DataFrame:
    """df with <target>_<period>_<groups>_<op> for every op: the statistic over the last `period` dates of the group, null before there are so many.

    Rows of one group and date share their sum and so their values. All ops of a period share one sort; an array of the window is gathered only for ops that
    read its order.
    """
    w = Window.partitionBy(*groups).orderBy(date)
    frame = w.rowsBetween(-(period - 1), 0)
    made = statistics(F.col("_x"), frame, F.col("_i"))
    d = per_date(df, target, groups, date).withColumn("_i", F.row_number().over(w))
    if any(op in _FOLDS for op in ops):
        d = d.withColumn("_values", made["_values"]).withColumn("_mean", _mean(F.col("_values")))
    name = f"{target}_{period}_{'_'.join(groups)}_"
    d = d.select(*groups, date, "_i", *(made[op].alias(name + op) for op in ops))
    d = d.select(*groups, date, *(F.when(F.col("_i") >= period, F.col(name + op)).alias(name + op) for op in ops))
    return df.join(d, [*groups, date], "left")


def shifted(df: DataFrame, target: str, groups: list[str], date: str, period: int, kind: str = "shift") -> DataFrame:
    """df with the value `period` dates earlier (later if negative), or with kind='diff' the value less that one."""
    w = Window.partitionBy(*groups).orderBy(date)
    before = F.lag("_x", period).over(w) if period >= 0 else F.lead("_x", -period).over(w)
    value = before if kind == "shift" else F.col("_x") - before
    d = per_date(df, target, groups, date).select(*groups, date, value.alias(f"{target}_{period}_{'_'.join(groups)}_{kind}"))
    return df.join(d, [*groups, date], "left")


def previous_mean(df: DataFrame, target: str, groups: list[str], date: str, rows: int = 3) -> DataFrame:
    """df with the mean of the rows strictly before."""
    w = Window.partitionBy(*groups).orderBy(date).rowsBetween(-rows, -1)
    return df.withColumn(f"{target}_prev{rows}_mean", F.avg(target).over(w))


def cumulative_ratio(df: DataFrame, flag: Column, groups: list[str], order: list[str], name: str = "ratio") -> DataFrame:
    """df with the share of the group's rows so far, this one included, for which the flag holds. Sums over ranges: a group may be of any length."""
    d = running(df, groups, order, {"_hits": F.when(flag, 1).otherwise(0), "_rows": F.lit(1)})
    return d.withColumn(name, F.col("_hits") / F.col("_rows")).drop("_hits", "_rows")


def resample(df: DataFrame, date: str, freq: str, sensors: list[str], last: list[str] = (), groups: list[str] = (), fill: bool = True) -> DataFrame:
    """Bins of time with <sensor>_mean and <sensor>_std and the last value that is not null of other columns; with `fill`, bins without rows are null rows."""
    binned = F.window(date, freq)["start"].alias(date)
    aggs = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(date))).alias(c) for c in last]
    aggs += [f(c).alias(f"{c}_{k}") for c in sensors for k, f in (("mean", F.avg), ("std", F.stddev))]
    d = df.groupBy(*groups, binned).agg(*aggs)
    if not fill:
        return d
    span = d.groupBy(*groups).agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    return span.select(*groups, F.explode(F.sequence("_a", "_b", F.expr(f"interval {freq}"))).alias(date)).join(d, [*groups, date], "left")


def lagged_target(df: DataFrame, date: str, target: str, freq: str, least: float, groups: list[str] = ()) -> DataFrame:
    """Mean target of each bin, moved one bin later, where it is above `least`; bins after the series' last are left out. Without groups all bins are one series.

    As bins are equally wide, the bin before is found by its time, without an ordered window."""
    d = df.groupBy(*groups, F.window(date, freq)["start"].alias(date)).agg(F.avg(target).alias(target))
    last = d.groupBy(*groups).agg(F.max(date).alias("_last"))  # without groups one row
    moved = d.withColumn(date, F.col(date) + F.expr(f"interval {freq}"))
    moved = moved.join(last, [*groups]) if groups else moved.crossJoin(F.broadcast(last))
    return moved.where((F.col(date) <= F.col("_last")) & (F.col(target) > least)).drop("_last")
