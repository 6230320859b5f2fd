"""Scaling, outliers, power transforms and moments."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.steps import Fit, Step


class SinCosModel(Step):
    def apply(self, df, cols, top):
        new = {}
        for c in cols:
            angle = 2 * math.pi * F.try_divide(F.least(F.col(c), F.lit(top[c])), F.lit(top[c]))
            new |= {f"{c}_{name}": F.when(~F.isnan(f(angle)), f(angle)) for name, f in (("cos", F.cos), ("sen", F.sin))}
        df = df.withColumns(new).drop(*cols)
        return df.select(*sorted(df.columns))


class SinCos(Fit):
    """<column>_sen and <column>_cos of the value's share of the fitted maximum, as a full turn; larger values count as the maximum; columns are sorted by name.

    A maximum of 0, or a share that is not a number, gives null."""

    step = SinCosModel

    def learn(self, df, cols):
        row = df.agg(*(F.max(c).alias(c) for c in cols)).first()
        return {"top": {c: row[c] for c in cols}}


def annual_cosine(c: Column, start) -> Column:
    return F.cos(F.datediff(c, F.lit(start)) * (2 * math.pi / 365.25))


def yeo_johnson(x: Column, lam: float) -> Column:
    up = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if abs(lam - 2) < 1e-12 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).when(x < 0, down)


class YeoJohnsonModel(Step):
    def apply(self, df, cols, lambdas):
        return df.withColumns({c: yeo_johnson(F.col(c), lambdas[c]) for c in cols})


class YeoJohnson(Fit):
    """Power transform to a normal shape with the most likely lambda in [-2, 2]: each of three rounds tries a finer grid for all columns in one aggregate."""

    step = YeoJohnsonModel

    def learn(self, df, cols):
        best, width = dict.fromkeys(cols, 0.0), 2.0
        for _ in range(3):
            grid = {c: sorted({max(-2.0, min(2.0, best[c] + width * k / 8)) for k in range(-8, 9)}) for c in cols}
            found = {}
            for at in range(0, len(cols), 5):
                some = cols[at : at + 5]
                aggs = [F.var_pop(yeo_johnson(F.col(c), lam)).alias(f"v{i}_{k}") for i, c in enumerate(some) for k, lam in enumerate(grid[c])]
                aggs += [x for i, c in enumerate(some) for x in (F.count(c).alias(f"n{i}"), F.sum(F.signum(c) * F.log1p(F.abs(c))).alias(f"s{i}"))]
                row = df.agg(*aggs).first()
                for i, c in enumerate(some):
                    like = {lam: -row[f"n{i}"] / 2 * math.log(v) + (lam - 1) * row[f"s{i}"] for k, lam in enumerate(grid[c]) if (v := row[f"v{i}_{k}"])}
                    found[c] = max(like, key=like.get) if like else 1.0
            best, width = found, width / 8
        return {"lambdas": best}


class OutliersModel(Step):
    def apply(self, df, cols, bounds, band=3.0, action="clip"):
        new = {}
        for c in cols:
            lo, mean, hi = bounds[c]
            x = F.col(c)
            to = {"mean": lambda: F.lit(mean), "max": lambda: F.lit(hi), "clip": lambda: F.when(x <= lo, lo).otherwise(hi)}[action]()
            new[c] = F.when((x <= lo) | (x >= hi), to).otherwise(x)
        return df.withColumns(new)


class Outliers(Fit):
    """Values on or outside mean +- band * sample standard deviation become the mean (`mean`), the nearer bound (`clip`) or the upper bound (`max`)."""

    step = OutliersModel

    def learn(self, df, cols, band=3.0, action="clip"):
        row = df.agg(*(f(c).alias(f"{k}_{c}") for c in cols for k, f in (("m", F.avg), ("s", F.stddev)))).first()
        return {"bounds": {c: [row[f"m_{c}"] - band * row[f"s_{c}"], row[f"m_{c}"], row[f"m_{c}"] + band * row[f"s_{c}"]] for c in cols}}


class ScaleModel(Step):
    def apply(self, df, cols, shift, size, kind="minmax"):
        return df.withColumns({c: F.try_divide(F.col(c) - shift[c], F.lit(size[c])) for c in cols})

    def inverse(self, df: DataFrame) -> DataFrame:
        v = self.values
        return df.withColumns({c: F.col(c) * v["size"][c] + v["shift"][c] for c in v["cols"]})


class Scale(Fit):
    """To [0, 1] (`minmax`) or to mean 0 and population deviation 1 (`standard`), with an inverse; a constant column gives null."""

    step = ScaleModel

    def learn(self, df, cols, kind="minmax"):
        low, size = (F.min, lambda c: F.max(c) - F.min(c)) if kind == "minmax" else (F.avg, F.stddev_pop)
        row = df.agg(*(f(c).cast("double").alias(f"{k}_{c}") for c in cols for k, f in (("l", low), ("s", size)))).first()
        return {"shift": {c: row[f"l_{c}"] for c in cols}, "size": {c: row[f"s_{c}"] for c in cols}}


def bias_free_skew(n: Column, skew: Column) -> Column:
    """From the population skewness; null under three values."""
    return F.when(n >= 3, skew * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)))


def bias_free_kurtosis(n: Column, kurtosis: Column) -> Column:
    """From the population excess kurtosis; null under four values."""
    return F.when(n >= 4, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0)) * ((n + 1) * kurtosis + 6))
