"""Metrics of predictions, each from one aggregate, and curves over thresholds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.lineage import cut
from millrace.operators.quantiles import quantiles


def regression_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row: mae, mse, rmse, median error, r2, msle, rmsle, mape in per cent, largest error, explained variance, Poisson and gamma deviance.

    Logarithms take what is above -1, deviances what is positive; mape leaves out y = 0. The median is exact, found in a few passes."""
    a, b = F.col(y).cast("double"), F.col(p).cast("double")
    e = a - b
    log = F.when((a > -1) & (b > -1), F.log1p(a) - F.log1p(b))
    both = (a > 0) & (b > 0)
    metrics = {
        "mae": F.avg(F.abs(e)),
        "mse": F.avg(e * e),
        "r2": 1 - F.try_divide(F.sum(e * e), F.var_pop(a) * F.count(a)),
        "msle": F.avg(log * log),
        "mape": F.avg(F.abs(F.try_divide(e, a))) * 100,
        "max_error": F.max(F.abs(e)),
        "explained_variance": 1 - F.try_divide(F.var_pop(e), F.var_pop(a)),
        "poisson_deviance": F.avg(F.when(both, 2 * (a * F.log(a / b) - e))),
        "gamma_deviance": F.avg(F.when(both, 2 * (e / b - F.log(a / b)))),
    }
    median, m = quantiles(df.where(a.isNotNull() & b.isNotNull()), {"e": F.abs(e)}, [0.5], metrics)
    root = lambda v: None if v is None else math.sqrt(v)
    m |= {"rmse": root(m["mse"]), "rmsle": root(m["msle"]), "median_ae": median["e"][0]}
    names = ["mae", "mse", "rmse", "median_ae", "r2", "msle", "rmsle", "mape", "max_error", "explained_variance", "poisson_deviance", "gamma_deviance"]
    return df.sparkSession.createDataFrame([tuple(m[k] for k in names)], ", ".join(f"{k} double" for k in names))


def counts(df: DataFrame, y: str, p: str) -> DataFrame:
    """tp, fp, tn, fn of 0/1 columns."""
    n = lambda a, b: F.count(F.when((F.col(y) == a) & (F.col(p) == b), 1))
    return df.agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(0, 0).alias("tn"), n(1, 0).alias("fn"))


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def class_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row of metrics of 0/1 predictions; AUC, average precision, log loss and Brier score here take the class as the score, hence _on_classes."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    n, pos, neg = tp + fp + tn + fn, tp + fn, tn + fp
    precision, recall, other = _share(tp, tp + fp), _share(tp, pos), _share(tn, neg)
    wrong = _share(fp + fn, n)
    return counts(df, y, p).select(
        _share(tp + tn, n).alias("accuracy"),
        ((recall + other) / 2).alias("balanced_accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        ((recall + other) / 2).alias("recall_macro"),
        _share(tp + tn, n).alias("recall_micro"),
        _share(recall * pos + other * neg, n).alias("recall_weighted"),
        _share(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _share(tp, tp + fp + fn).alias("jaccard"),
        ((recall + other) / 2).alias("roc_auc_on_classes"),
        (precision * recall + _share(pos, n) * (1 - recall)).alias("average_precision_on_classes"),
        (wrong * 36.04365338911715).alias("log_loss_on_classes"),
        wrong.alias("brier_on_classes"),
    )


def curve(df: DataFrame, y: str, s: str) -> DataFrame:
    """(score, tp, fp) cumulated from the highest score down, a row for each distinct score; scores are counted first, so the running sum goes over these.

    Distinct scores are range-partitioned; each range's sums start from those of the ranges above it."""
    n = df.where(F.col(y).isNotNull() & F.col(s).isNotNull()).groupBy(F.col(s).alias("score")).agg(F.sum(F.col(y).cast("long")).alias("p"), F.sum(1 - F.col(y).cast("long")).alias("q"))
    d = cut(n.repartitionByRange(F.desc("score")).withColumn("_r", F.spark_partition_id()))
    w = Window.partitionBy("_r").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    above = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    starts = d.groupBy("_r").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).select("_r", F.coalesce(F.sum("p").over(above), F.lit(0)).alias("_p"), F.coalesce(F.sum("q").over(above), F.lit(0)).alias("_q"))
    return d.select("_r", "score", F.sum("p").over(w).alias("tp"), F.sum("q").over(w).alias("fp")).join(F.broadcast(starts), "_r").select("score", (F.col("tp") + F.col("_p")).alias("tp"), (F.col("fp") + F.col("_q")).alias("fp"))


def roc(df: DataFrame, y: str, s: str) -> DataFrame:
    c = curve(df, y, s)
    total = c.agg(F.max("tp").alias("_t"), F.max("fp").alias("_f"))
    return c.crossJoin(F.broadcast(total)).select("score", F.try_divide("fp", "_f").alias("fpr"), F.try_divide("tp", "_t").alias("tpr"))


def score_metrics(df: DataFrame, y: str, s: str) -> DataFrame:
    """One row: ROC AUC (ties count half), average precision, log loss and Brier score of probabilities. AUC comes from counts of scores and running sums."""
    a, p = F.col(y).cast("double"), F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col(s).cast("double")))
    plain = df.where(a.isNotNull() & F.col(s).isNotNull()).agg((-F.avg(a * F.log(p) + (1 - a) * F.log(1 - p))).alias("log_loss"), F.avg((a - F.col(s)) * (a - F.col(s))).alias("brier"))
    n = df.where(a.isNotNull() & F.col(s).isNotNull()).groupBy(F.col(s).alias("score")).agg(F.sum(F.col(y).cast("long")).alias("p"), F.sum(1 - F.col(y).cast("long")).alias("q"))
    j = n.join(curve(df, y, s), "score")
    area = j.agg(F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2)).alias("_a"), F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("_b"), F.sum("p").alias("_p"), F.sum("q").alias("_q"))
    return area.crossJoin(plain).select(F.try_divide("_a", F.col("_p") * F.col("_q")).alias("roc_auc"), F.try_divide("_b", "_p").alias("average_precision"), "log_loss", "brier")


def by_threshold(df: DataFrame, y: str, s: str, thresholds: list[float], gain: float = 8.0, cost: float = 3.0) -> DataFrame:
    """(threshold, tp, fp, fn, f1, profit) for predictions score >= threshold. Scores fall into the thresholds' steps first, so one pass over the rows
    suffices; the steps are then summed up from above."""
    ts = sorted(thresholds)
    step = F.size(F.filter(F.lit(ts), lambda x: F.col(s) >= x))
    n = df.where(F.col(y).isNotNull() & F.col(s).isNotNull()).groupBy(step.alias("k")).agg(F.sum(F.col(y).cast("long")).alias("p"), F.sum(1 - F.col(y).cast("long")).alias("q"))
    grid = df.sparkSession.createDataFrame([(i + 1, float(x)) for i, x in enumerate(ts)], "i int, threshold double")
    m = grid.join(F.broadcast(n), F.lit(True)).groupBy("i", "threshold").agg(F.sum(F.when(F.col("k") >= F.col("i"), F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("k") >= F.col("i"), F.col("q")).otherwise(0)).alias("fp"), F.sum(F.when(F.col("k") < F.col("i"), F.col("p")).otherwise(0)).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return m.select("threshold", "tp", "fp", "fn", F.coalesce(F.try_divide(2.0 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"), (gain * tp - cost * fp).alias("profit"))


def first_maximum(curve_: DataFrame, metric: str) -> DataFrame:
    return curve_.orderBy(F.desc(metric), "threshold").limit(1)


def confusion(df: DataFrame, y: str, p: str) -> DataFrame:
    """(y, p, n, share of y's rows in per cent)."""
    n = df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count("*").alias("n"))
    return n.join(n.groupBy("y").agg(F.sum("n").alias("_t")), "y").select("y", "p", "n", (F.col("n") * 100.0 / F.col("_t")).alias("share"))


def class_report(df: DataFrame, y: str, p: str) -> DataFrame:
    """(label, precision, recall, f1, support) for each class."""
    n = df.groupBy(F.col(y).cast("string").alias("y"), F.col(p).cast("string").alias("p")).agg(F.count("*").alias("n"))
    true = n.groupBy(F.col("y").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("hit"))
    j = true.join(n.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("found")), "label", "left")
    precision, recall = _share(F.col("hit"), F.col("found")), _share(F.col("hit"), F.col("support"))
    return j.select("label", precision.alias("precision"), recall.alias("recall"), _share(2 * precision * recall, precision + recall).alias("f1"), "support")


def multiclass_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row: accuracy, macro and micro F1 (that of single labels is the accuracy)."""
    hit = F.avg(F.when(F.col(y) == F.col(p), 1.0).otherwise(0.0))
    return df.agg(hit.alias("accuracy"), hit.alias("f1_micro")).crossJoin(class_report(df, y, p).agg(F.avg("f1").alias("f1_macro")))


def residuals(df: DataFrame, y: str, p: str) -> DataFrame:
    e = F.col(y) - F.col(p)
    return df.where(e.isNotNull()).agg(F.count("*").alias("n"), F.avg(e).alias("mean"), F.stddev(e).alias("std"), F.min(e).alias("min"), F.max(e).alias("max"))


def score_histogram(df: DataFrame, y: str, s: str, bins: int = 10) -> DataFrame:
    """(label, bin, n): scores in [0, 1] by equal bins from 1; 1 itself is in the last."""
    return df.groupBy(F.col(y).alias("label"), F.least(F.floor(F.col(s) * bins) + 1, F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def quality_gate(metrics: DataFrame, f1: float = 0.6, auc: float = 0.8) -> DataFrame:
    return metrics.withColumn("passed", (F.col("f1") >= f1) | (F.col("roc_auc") >= auc))


def decide(df: DataFrame, s: str, threshold: float = 0.32) -> DataFrame:
    return df.withColumn("decision", F.when(F.col(s) >= threshold, 1).when(F.col(s).isNotNull(), 0))


def false_negatives(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.where((F.col(y) == 1) & (F.col(p) == 0))
