"""Aggregates: monthly panels, point-in-time samples, recency features, profiles and shares."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.numeric import bias_free_kurtosis, bias_free_skew
from millrace.operators.quantiles import quantiles


def split_date(df: DataFrame, col: str) -> DataFrame:
    """df with ano and mes of an ISO date string or date."""
    d = F.col(col).cast("date")
    return df.withColumns({"ano": F.year(d), "mes": F.month(d)})


def monthly_panel(df: DataFrame, customer: str, date: str, sums: list[str], ticket: str) -> DataFrame:
    """Sums of each customer's month, compras_mes (item rows with a ticket), cupons_mes (distinct tickets) and the month's first day, in one aggregate.

    Rows without a customer or date are left out; a sum over nulls only is 0."""
    month = F.trunc(date, "month").alias("date")
    d = df.where(F.col(customer).isNotNull() & F.col(date).isNotNull())
    return d.groupBy(customer, month).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums), F.count(ticket).alias("compras_mes"), F.count_distinct(ticket).alias("cupons_mes"))


def churn_samples(panel: DataFrame, customer: str, sums: list[str], first, last, feature_range: int = 2, target_range: int = 1, inclusive: bool = False, quantity: str | None = None, prefix: str = "agg_l3m_") -> DataFrame:
    """Point-in-time churn samples from a monthly panel, for all reference months in one plan.

    For a reference month r a customer with a row in r gets that row's values, sums over [r - feature_range months, r] named with the prefix, and target 1
    when there is no row in the target window, or, if `quantity` is given, when that column's sum there is missing or not positive. The window is
    [r + 1 month, r + 1 + target_range months), or closed at the end with `inclusive`. first and last are the panel's first and last month;
    r runs from first + feature_range to the last month whose window lies in the panel.

    Every panel row is sent to the at most feature_range + target_range + 2 reference months it matters for; one aggregate by customer and month follows.
    """
    ahead = target_range + (1 if inclusive else 0)
    start, stop = F.add_months(F.lit(first).cast("date"), feature_range), F.add_months(F.lit(last).cast("date"), -target_range)
    shift = F.explode(F.sequence(F.lit(-feature_range), F.lit(ahead))).alias("_k")  # month of the row less reference month
    sent = panel.select(customer, "date", *sums, "compras_mes", shift).withColumn("_r", F.add_months("date", -F.col("_k"))).where((F.col("_r") >= start) & (F.col("_r") <= stop))
    now, past, future = F.col("_k") == 0, F.col("_k") <= 0, F.col("_k") >= 1
    columns = [*sums, "compras_mes"]
    made = sent.groupBy(customer, F.col("_r").alias("date")).agg(
        *(F.max(F.when(now, F.col(c))).alias(c) for c in columns),
        *(F.sum(F.when(past, F.col(c))).alias(f"{prefix}{c}") for c in columns),
        F.max(now.cast("int")).alias("_now"),
        F.sum(F.when(future, F.col(quantity) if quantity else 1)).alias("_later"),
    )
    return made.where("_now = 1").withColumn("target", F.when(F.coalesce(F.col("_later"), F.lit(0)) <= 0, 1).otherwise(0)).drop("_now", "_later")


#: What a recency feature may compute of a value within a mask.
STATS = {
    "count": lambda x: F.count(x),
    "sum": lambda x: F.coalesce(F.sum(x), F.lit(0)),
    "mean": lambda x: F.avg(x),
    "min": lambda x: F.min(x),
    "max": lambda x: F.max(x),
    "nunique": lambda x: F.count_distinct(x),
    "mode": lambda x: F.mode(x, True),
}


def recency_features(df: DataFrame, key: str, specs: dict[str, tuple[str, Column, Column]], order: list[str] = (), every: bool = True) -> DataFrame:
    """Features of each key from one aggregate; without `every` only of keys with a row within some mask, and other rows are left out before any shuffle. specs: name -> (statistic, mask, value); of several modes the smallest is taken.

    The statistic 'first' is the value of the earliest row by `order` within the mask that has one, the smallest of several there."""

    def stat(kind: str, mask: Column, value: Column) -> Column:
        if kind != "first":
            return STATS[kind](F.when(mask, value))
        if not order:
            raise ValueError("the statistic 'first' needs an order")
        return F.min(F.when(mask & value.isNotNull(), F.struct(*order, value.alias("_value"))))["_value"]

    d = df.where(F.col(key).isNotNull())
    d = d if every else d.where(reduce(lambda a, b: a | b, (mask for _, mask, _ in specs.values())))
    return d.groupBy(key).agg(*(stat(*spec).alias(name) for name, spec in specs.items()))


def frequencies(df: DataFrame, col: str, normalize: bool = False) -> DataFrame:
    """Value counts, or shares; nulls are left out."""
    n = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("_total")))).select(col, (F.col("n") / F.col("_total")).alias("share")) if normalize else n


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def cluster_profile(df: DataFrame, cluster: str, category: str, values: list) -> DataFrame:
    """Shares in per cent of the given categories within each cluster, one column each; other categories count in the total."""
    share = lambda v: (F.count(F.when(F.col(category) == v, 1)) * 100.0 / F.count("*")).alias(str(v))
    return df.groupBy(cluster).agg(*map(share, values))


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """A row for each column: count, mean, std, min, quartiles and max. The quartiles are exact; all columns are read together, a few times over."""
    stats = {"n": F.count, "mean": F.avg, "std": F.stddev, "min": F.min, "max": F.max}
    q, x = quantiles(df, {c: F.col(c) for c in cols}, [0.25, 0.5, 0.75], {f"{c}|{k}": f(c).cast("double") for c in cols for k, f in stats.items()})
    rows = [(c, *(x[f"{c}|{k}"] for k in ("n", "mean", "std", "min")), *q[c], x[f"{c}|max"]) for c in cols]
    return df.sparkSession.createDataFrame(rows, "feature string, n double, mean double, std double, min double, q25 double, q50 double, q75 double, max double")


#: What a profile says of a column besides its quantiles q50 and q75.
PROPERTIES = {
    "mean": F.avg,
    "std": F.stddev,
    "min": F.min,
    "max": F.max,
    "skew": lambda c: bias_free_skew(F.count(c), F.skewness(c)),
    "kurtosis": lambda c: bias_free_kurtosis(F.count(c), F.kurtosis(c)),
}


def profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, property, value) of numeric columns. Skewness and kurtosis are free of bias, quantiles exact; all columns are read together, a few times over."""
    q, x = quantiles(df, {c: F.col(c) for c in cols}, [0.5, 0.75], {f"{c}|{k}": f(c).cast("double") for c in cols for k, f in PROPERTIES.items()})
    rows = [(c, k, v) for c in cols for k, v in (*((k, x[f"{c}|{k}"]) for k in PROPERTIES), ("q50", q[c][0]), ("q75", q[c][1]))]
    return df.sparkSession.createDataFrame(rows, "feature string, property string, value double")


def category_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, category, share) of string columns in one aggregate; nulls are left out."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("category")) for c in cols))).alias("r")).select("r.*").where("category is not null")
    counts = long.groupBy("feature", "category").agg(F.count("*").alias("n"))
    return counts.join(counts.groupBy("feature").agg(F.sum("n").alias("total")), "feature").select("feature", "category", (F.col("n") / F.col("total")).alias("share"))


def date_format(df: DataFrame, cols: list[str], formats: dict[str, str]) -> DataFrame:
    """(feature, format) of string columns: the first format that reads every value that is not null, 'custom' if none does."""
    n = df.agg(*(F.count(c).alias(c) for c in cols), *(F.count(F.try_to_timestamp(c, F.lit(p))).alias(f"{c}|{k}") for c in cols for k, p in formats.items()))
    guess = lambda c: F.coalesce(*(F.when((F.col(f"`{c}|{k}`") == F.col(c)) & (F.col(c) > 0), F.lit(k)) for k in formats), F.lit("custom"))
    return n.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), guess(c).alias("format")) for c in cols))).alias("r")).select("r.*")


def coverage(base: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """Distinct keys of the base, those of them with an event, and the share."""
    flagged = base.select(key).distinct().join(events.select(key).distinct().withColumn("_e", F.lit(1)), key, "left")
    return flagged.agg(F.count("*").alias("base"), F.count("_e").alias("covered")).withColumn("share", F.try_divide("covered", "base"))


def active_ids(df: DataFrame, key: str, date: str, since) -> DataFrame:
    return df.where(F.col(date) >= F.lit(since)).select(key).distinct()
