"""Validation, drift, control charts and registries of metrics. Baselines are small tables with a version."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.prefix import running
from millrace.operators.project import family
from millrace.operators.steps import Fit, Step


def schema_table(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(f.name, family(f)) for f in df.schema.fields], "feature string, type string")


def compare_schema(base: DataFrame, current: DataFrame) -> DataFrame:
    """(feature, type, status): columns of one side only, missing or new; a changed type gives one row of each."""
    b, c = base.withColumn("_b", F.lit(True)), current.withColumn("_c", F.lit(True))
    return b.join(c, ["feature", "type"], "full").where("_b is null or _c is null").select("feature", "type", F.when(F.col("_c").isNull(), "missing").otherwise("new").alias("status"))


def numeric_drift(base: DataFrame, current: DataFrame, threshold: float = 0.15, thresholds: DataFrame | None = None) -> DataFrame:
    """(feature, property, baseline, current, ratio, distance) of profiles whose relative change is above the threshold, of the feature's own if it has one
    in `thresholds` (feature, threshold). The ratio is (current - baseline) / baseline; a baseline of 0 has none and is left out."""
    j = base.withColumnRenamed("value", "baseline").join(current.withColumnRenamed("value", "current"), ["feature", "property"])
    j = j.withColumn("ratio", F.try_divide(F.col("current") - F.col("baseline"), F.col("baseline"))).withColumn("distance", F.abs("ratio"))
    limit = F.lit(threshold)
    if thresholds is not None:
        j, limit = j.join(thresholds, "feature", "left"), F.coalesce("threshold", F.lit(threshold))
    return j.where(F.col("distance") > limit).select("feature", "property", "baseline", "current", "ratio", "distance")


def category_changes(base: DataFrame, current: DataFrame) -> DataFrame:
    """(feature, category, status): a row for each category of one profile only, missing or new. Any number of categories."""
    j = base.select("feature", "category", F.lit(True).alias("_b")).join(current.select("feature", "category", F.lit(True).alias("_c")), ["feature", "category"], "full")
    return j.where("_b is null or _c is null").select("feature", "category", F.when(F.col("_c").isNull(), "missing").otherwise("new").alias("status"))


def category_drift(base: DataFrame, current: DataFrame) -> DataFrame:
    """(feature, missing, new): categories of one profile only, in order. Only these are gathered, one row a feature; `category_changes` has them as rows."""
    side = lambda kind: F.sort_array(F.collect_list(F.when(F.col("status") == kind, F.col("category")))).alias(kind)
    return category_changes(base, current).groupBy("feature").agg(side("missing"), side("new"))


def frequency_drift(base: DataFrame, current: DataFrame, threshold: float = 0.15) -> DataFrame:
    """(feature, category, baseline, current, distance): of the categories both profiles have the one whose share changed most, where that is above the threshold."""
    j = base.withColumnRenamed("share", "baseline").join(current.withColumnRenamed("share", "current"), ["feature", "category"]).withColumn("distance", F.abs(F.col("current") - F.col("baseline")))
    top = j.groupBy("feature").agg(F.max(F.struct("distance", F.col("category").alias("category"), "baseline", "current")).alias("x"))
    return top.select("feature", "x.category", "x.baseline", "x.current", "x.distance").where(F.col("distance") > threshold)


def date_format_drift(base: DataFrame, current: DataFrame) -> DataFrame:
    return base.withColumnRenamed("format", "baseline").join(current.withColumnRenamed("format", "current"), "feature").where("baseline <> current")


def shifted_features(drift: DataFrame, schema: DataFrame, least: int = 4) -> DataFrame:
    """(feature, reason): features with `least` changed properties or more, and those whose column or type changed."""
    a = drift.groupBy("feature").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("feature", F.lit("distribution").alias("reason"))
    return a.unionByName(schema.select("feature").distinct().withColumn("reason", F.lit("input")))


def _categories(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, n): how often each column has each value that is not null, as text. Equal values are counted before they are shuffled."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols))
    return df.select(F.explode(pairs).alias("r")).select("r.*").where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))


class ValidationModel(Step):
    """Result rows (column, check, success, observed) of a table against the fitted expectations, from one aggregate, and one join for all sets of categories."""

    def apply(self, df, numeric, categories, flags, expected):
        e = expected
        row = df.agg(F.count("*").alias("n"), *(F.count(c).alias(f"k_{c}") for c in (*numeric, *categories, *flags)), *(f(c).cast("double").alias(f"{k}_{c}") for c in numeric for k, f in (("avg", F.avg), ("min", F.min), ("max", F.max))), *(F.count(F.when(F.col(c).isNotNull() & ~F.col(c).isin(0, 1), 1)).alias(f"f_{c}") for c in flags)).first()
        other = {}
        if categories:
            odd = _categories(df, categories).join(self.table("sets"), ["column", "value"], "left_anti")
            other = {r["column"]: r.n for r in odd.groupBy("column").agg(F.sum("n").alias("n")).collect()}  # a row for each column
        out = [(c, "non_null_share", row["n"] > 0 and row[f"k_{c}"] / row["n"] >= e["shares"][c], row[f"k_{c}"] / row["n"] if row["n"] else None) for c in (*numeric, *categories, *flags)]
        for c in numeric:
            lo, hi, mean, std = e["stats"][c]
            out += [(c, "mean_near", row[f"avg_{c}"] is not None and mean is not None and abs(row[f"avg_{c}"] - mean) <= (std or 0.0), row[f"avg_{c}"])]
            out += [(c, f"{k}_in_range", row[f"{k}_{c}"] is not None and lo is not None and lo <= row[f"{k}_{c}"] <= hi, row[f"{k}_{c}"]) for k in ("min", "max")]
        out += [(c, "in_set", c not in other, float(other.get(c, 0))) for c in categories] + [(c, "is_flag", row[f"f_{c}"] == 0, float(row[f"f_{c}"])) for c in flags]
        return df.sparkSession.createDataFrame(out, "column string, check string, success boolean, observed double")


class ValidationSuite(Fit):
    """Learns from training data: share of values, sets of categories, mean, deviation and range of numbers. The sets are a table, of any size."""

    step = ValidationModel

    def learn(self, df, numeric, categories, flags):
        row = df.agg(F.count("*").alias("n"), *(F.count(c).alias(f"k_{c}") for c in (*numeric, *categories, *flags)), *(f(c).cast("double").alias(f"{k}_{c}") for c in numeric for k, f in (("min", F.min), ("max", F.max), ("avg", F.avg), ("std", F.stddev)))).first()
        shares = {c: row[f"k_{c}"] / row["n"] if row["n"] else 0.0 for c in (*numeric, *categories, *flags)}
        found = {"expected": {"shares": shares, "stats": {c: [row[f"{k}_{c}"] for k in ("min", "max", "avg", "std")] for c in numeric}}}
        return found | ({"tables": {"sets": _categories(df, categories).select("column", "value")}} if categories else {})


def control_limits(df: DataFrame, cols: list[str], group: list[str] = ()) -> DataFrame:
    """(feature, mean, std, ucl, lcl, usl, lsl) rounded to three decimals: three and one standard deviations around the mean."""
    long = df.select(*group, F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in cols))).alias("r")).select(*group, "r.*")
    s = long.groupBy(*group, "feature").agg(F.avg("x").alias("mean"), F.stddev("x").alias("std"))
    return s.select(*group, "feature", *(F.round(x, 3).alias(k) for k, x in {"mean": F.col("mean"), "std": F.col("std"), "ucl": F.col("mean") + 3 * F.col("std"), "lcl": F.col("mean") - 3 * F.col("std"), "usl": F.col("mean") + F.col("std"), "lsl": F.col("mean") - F.col("std")}.items()))


#: Limits are broadcast up to so many series: values are not shuffled by series then, of which there may be one only.
BROADCAST_LIMITS = 100_000


def control_chart(df: DataFrame, order: str, cols: list[str], group: list[str] = (), limits: DataFrame | None = None, before: DataFrame | None = None) -> DataFrame:
    """Values in long form with their limits, an out-of-control flag (on or outside ucl and lcl) and the cumulative share of flags, by series.

    limits: given ones, which replace the computed. before: (group, feature, n, out), the points that each series has had already and how many of them were
    out of control. A series is a group and column; its running share comes from sums over ranges, so a series may be of any length."""
    group = list(group)
    long = df.select(*group, order, F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in cols))).alias("r")).select(*group, order, "r.*")
    limits = limits if limits is not None else control_limits(df, cols, group)
    few = not group or limits.count() <= BROADCAST_LIMITS
    j = long.join(F.broadcast(limits) if few else limits, [*group, "feature"]).withColumn("ooc", ((F.col("x") >= F.col("ucl")) | (F.col("x") <= F.col("lcl"))).cast("int"))
    j = running(j, [*group, "feature"], [order], {"_out": F.col("ooc"), "_n": F.lit(1)})
    out, n = F.col("_out"), F.col("_n")
    if before is not None:
        j = j.join(before.select(*group, "feature", F.col("n").alias("_n0"), F.col("out").alias("_out0")), [*group, "feature"], "left")
        out, n = F.coalesce(out + F.col("_out0"), out, "_out0"), n + F.coalesce("_n0", F.lit(0))
    return j.withColumn("ratio", out / n).drop("_out", "_n", "_out0", "_n0")


def series_state(chart: DataFrame, group: list[str] = (), before: DataFrame | None = None) -> DataFrame:
    """(group, feature, n, out) of the series after the chart's points, for the `before` of the next."""
    s = chart.select(*group, "feature", F.lit(1).cast("long").alias("n"), F.col("ooc").cast("long").alias("out"))
    s = s if before is None else s.unionByName(before)
    return s.groupBy(*group, "feature").agg(F.sum("n").alias("n"), F.sum("out").alias("out"))


def ooc_summary(chart: DataFrame, order: str, group: list[str] = (), ok: float = 0.05, warn: float = 0.07, cap: float = 0.15) -> DataFrame:
    """(feature, share, status): each series' last ratio, at most the cap, and whether that is ok, warn or bad."""
    last = chart.groupBy(*group, "feature").agg(F.max_by("ratio", order).alias("r"))
    return last.select(*group, "feature", F.least("r", F.lit(cap)).alias("share"), F.when(F.col("r") <= ok, "ok").when(F.col("r") < warn, "warn").otherwise("bad").alias("status"))


def null_counts(df: DataFrame) -> DataFrame:
    row = df.agg(*(F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in df.columns))
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("nulls")) for c in df.columns))).alias("r")).select("r.*")


#: Metrics for which more is better; of all others less is.
HIGHER = {"accuracy", "balanced_accuracy", "precision", "average_precision", "recall", "f1", "jaccard", "roc_auc", "r2", "explained_variance"}


def record_metrics(table: DataFrame | None, row: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """The table with a further row, rows of equal metrics kept once, the first by key."""
    both = row if table is None else table.unionByName(row)
    w = Window.partitionBy(*metrics).orderBy(*keys)
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def select_best(metrics: DataFrame, key: str, weights: dict[str, float]) -> str | None:
    """Walks the models by key; one replaces the best so far when the weighted sum of +1 for each metric it is better in and -1 for each it is worse in is not
    negative. The table has a row for each model and is folded on the driver."""
    best = None
    for r in metrics.orderBy(key).collect():
        if best is None:
            best = r
            continue
        score = sum(w * (0 if r[m] == best[m] else 1 if (r[m] > best[m]) == (m in HIGHER) else -1) for m, w in weights.items())
        best = r if score >= 0 else best
    return best[key] if best is not None else None


def promote(table: DataFrame, key: str, variant: str, baseline: str = "baseline", retired: str = "previous") -> DataFrame:
    """The variant's rows become the baseline, the baseline's the previous one."""
    return table.withColumn(key, F.when(F.col(key) == variant, baseline).when(F.col(key) == baseline, retired).otherwise(F.col(key)))


def pick_production(metrics: DataFrame, order: list[str]) -> DataFrame:
    return metrics.orderBy(*(F.desc_nulls_last(c) for c in order), *sorted(set(metrics.columns) - set(order))).limit(1)


def drift_thresholds(df: DataFrame, cols: list[str], value: float = 0.3) -> DataFrame:
    return df.sparkSession.createDataFrame([(c, value) for c in cols], "feature string, threshold double")


def log_rollout(log: DataFrame | None, model: str, at, spark) -> DataFrame:
    """The log with a further rollout; its history stays."""
    row = spark.createDataFrame([(model, at)], "model string, rollout timestamp_ntz")
    return row if log is None else log.unionByName(row)


def active_model(log: DataFrame) -> DataFrame:
    return log.agg(F.max_by("model", F.struct("rollout", "model")).alias("model"))


def changed(df: DataFrame, baseline: DataFrame) -> bool:
    """Whether retraining is due: the tables differ in a row."""
    from millrace.operators.sets import same_rows

    return not same_rows(df, baseline)


