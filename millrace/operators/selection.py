"""Statistics of columns and feature selection. What reaches the driver is a row of statistics, a matrix over columns, or a list of names."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.lineage import cut
from millrace.operators.sets import position
from millrace.operators.steps import Fit, Step


def constant_columns(df: DataFrame, cols: list[str] | None = None) -> list[str]:
    """Columns with one value and no null (or nulls only: they hold no value at all)."""
    cols = cols or df.columns
    row = df.agg(F.count("*").alias("_n"), *(x for i, c in enumerate(cols) for x in (F.count(c).alias(f"n{i}"), F.min(c).alias(f"a{i}"), F.max(c).alias(f"b{i}")))).first()
    return [c for i, c in enumerate(cols) if (row[f"n{i}"] == row["_n"] and row[f"a{i}"] == row[f"b{i}"]) or row[f"n{i}"] == 0]


def variances(df: DataFrame, cols: list[str], sample: bool = True) -> DataFrame:
    """(feature, variance) from one aggregate."""
    row = df.agg(*((F.var_samp if sample else F.var_pop)(c).alias(c) for c in cols))
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("variance")) for c in cols))).alias("r")).select("r.*")


def quasi_constant(df: DataFrame, cols: list[str], threshold: float = 0.01) -> list[str]:
    """Columns whose sample variance is below the threshold."""
    return [r.feature for r in variances(df, cols).collect() if r.variance is not None and r.variance < threshold]


class LowVarianceModel(Step):
    def apply(self, df, cols, dropped, threshold=0.01):
        return df.drop(*dropped)


class LowVariance(Fit):
    """Drops columns whose population variance is at most the threshold."""

    step = LowVarianceModel

    def learn(self, df, cols, threshold=0.01):
        return {"dropped": [r.feature for r in variances(df, cols, sample=False).collect() if r.variance is not None and r.variance <= threshold]}


def duplicate_columns(df: DataFrame, cols: list[str] | None = None) -> list[tuple[str, str]]:
    """Pairs (kept, later) of columns of one type that are equal in every row, nulls included: hashes in one aggregate name the candidates, a second checks them."""
    cols, types = cols or df.columns, dict(df.dtypes)
    sums = df.agg(*(F.sum(F.xxhash64(F.col(c).cast("string"), F.coalesce(F.xxhash64(*df.columns), F.lit(0))) % 1_000_003).alias(c) for c in cols)).first()
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :] if sums[a] == sums[b] and types[a] == types[b]]
    if not pairs:
        return []
    same = df.agg(*(F.bool_and(F.equal_null(F.col(a), F.col(b))).alias(str(i)) for i, (a, b) in enumerate(pairs))).first()
    return [p for i, p in enumerate(pairs) if same[str(i)]]


def _entropy(counts: DataFrame, by: list[str]) -> DataFrame:
    total = counts.groupBy(*by).agg(F.sum("n").alias("_t"))
    return counts.join(total, by) if by else counts.crossJoin(F.broadcast(total))


def entropy(df: DataFrame, x: str) -> DataFrame:
    """One row: the entropy of a column in nats; null is a value."""
    p = F.col("n") / F.col("_t")
    return _entropy(df.groupBy(x).agg(F.count("*").alias("n")), []).agg((-F.sum(p * F.log(p))).alias("entropy"))


def uncertainty(df: DataFrame, cols: list[str], targets: list[str] | None = None) -> DataFrame:
    """(x, y, u): Theil's U(x|y), the share of x's entropy that y explains, 1 where x has none, for every two of the columns (x in targets only, if given).

    One pass counts all pairs of columns in long form; entropies follow from the counts."""
    targets = targets or cols
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))
    pairs = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), text(x).alias("vx"), text(y).alias("vy")) for x in targets for y in cols if x != y))
    n = df.select(F.explode(pairs).alias("r")).groupBy("r.x", "r.y", "r.vx", "r.vy").agg(F.count("*").alias("n"))
    per_y = n.groupBy("x", "y", "vy").agg(F.sum("n").alias("ny"))
    per_x = n.groupBy("x", "y", "vx").agg(F.sum("n").alias("nx"))
    total = per_x.groupBy("x", "y").agg(F.sum("nx").alias("t"))
    both = n.join(per_y, ["x", "y", "vy"]).join(total, ["x", "y"]).groupBy("x", "y").agg((-F.sum(F.col("n") / F.col("t") * F.log(F.col("n") / F.col("ny")))).alias("hxy"))
    own = per_x.join(total, ["x", "y"]).groupBy("x", "y").agg((-F.sum(F.col("nx") / F.col("t") * F.log(F.col("nx") / F.col("t")))).alias("hx"))
    return own.join(both, ["x", "y"]).select("x", "y", F.when(F.col("hx") <= 1e-15, 1.0).otherwise((F.col("hx") - F.col("hxy")) / F.col("hx")).alias("u"))


def redundant(u: DataFrame, threshold: float = 0.95) -> list[str]:
    return sorted(r.x for r in u.where(F.col("u") >= threshold).select("x").distinct().collect())


def correlation_long(df: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, r) of every two columns from one aggregate, each over rows where both are known."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    row = df.agg(*(F.corr(F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))).alias(f"{i}") for i, (a, b) in enumerate(pairs)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(str(i)).alias("r")) for i, (a, b) in enumerate(pairs)))).alias("x")).select("x.*")


def correlation_matrix(df: DataFrame, cols: list[str]) -> np.ndarray:
    """Over rows without nulls, from one pass; a constant column has nan."""
    from pyspark.ml.stat import Correlation

    d = VectorAssembler(inputCols=cols, outputCol="_v").transform(df.select(*(F.col(c).cast("double") for c in cols)).dropna())
    return Correlation.corr(d, "_v").first()[0].toArray()


def correlated_groups(r: np.ndarray, cols: list[str], threshold: float) -> list[list[str]]:
    """Columns with those they correlate with at the threshold, a column in one group only, in order."""
    left, groups = list(range(len(cols))), []
    while left:
        i = left.pop(0)
        near = [j for j in left if abs(r[i, j]) >= threshold]
        if near:
            groups.append([cols[k] for k in (i, *near)])
            left = [j for j in left if j not in near]
    return groups


def later_correlated(r: np.ndarray, cols: list[str], threshold: float) -> list[str]:
    """The later column of every pair above the threshold."""
    return [c for j, c in enumerate(cols) if any(abs(r[i, j]) > threshold for i in range(j))]


def forest(df: DataFrame, features: list[str], label: str, task: str = "classification", trees: int = 200, depth: int = 6, seed: int = 7):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.regression import RandomForestRegressor

    kind = RandomForestClassifier if task == "classification" else RandomForestRegressor
    d = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df).select("features", F.col(label).cast("double").alias("label"))
    return kind(numTrees=trees, maxDepth=depth, seed=seed).fit(d)


class SelectByCorrelationModel(Step):
    def apply(self, df, dropped, **options):
        return df.drop(*dropped)


class SelectByCorrelation(Fit):
    """Takes the strongest group of correlated columns, keeps its member of most importance in a forest, drops the others, and goes on."""

    step = SelectByCorrelationModel

    def learn(self, df, cols, label, threshold=0.8, trees=50):
        r, dropped, kept, left = np.nan_to_num(correlation_matrix(df, cols)), [], [], list(range(len(cols)))
        while True:
            free = [i for i in left if cols[i] not in kept]
            best = max(((abs(r[i, j]), i) for i in free for j in left if i != j), default=(0, 0))
            if best[0] < threshold:
                return {"dropped": dropped}
            group = [j for j in left if j == best[1] or abs(r[best[1], j]) >= threshold]
            weight = forest(df, [cols[j] for j in group], label, trees=trees).featureImportances.toArray()
            keep = group[int(np.argmax(weight))]
            kept.append(cols[keep])
            dropped += [cols[j] for j in group if j != keep]
            left = [j for j in left if j not in group or j == keep]


def vif(r: np.ndarray) -> np.ndarray:
    """Variance inflation of each column from the correlation matrix; infinite for a column that others determine."""
    out = np.empty(len(r))
    for i in range(len(r)):
        rest = [j for j in range(len(r)) if j != i]
        if not rest:
            return np.ones(1)
        b, *_ = np.linalg.lstsq(r[np.ix_(rest, rest)], r[rest, i], rcond=1e-10)
        left = 1 - float(r[i, rest] @ b)
        out[i] = math.inf if left < 1e-9 else 1 / left
    return out


def remove_multicollinearity(r: np.ndarray, cols: list[str], threshold: float = 10.0, limit: int = 3) -> list[str]:
    """The columns to keep: of the largest sets whose inflations are all below the threshold the one with the least sum. Each level tries to drop one of the
    limit + 1 columns of most inflation."""
    seen: set[tuple[int, ...]] = set()
    best: tuple[int, float, tuple[int, ...]] | None = None
    todo = [tuple(range(len(cols)))]
    while todo:
        level, todo = todo, []
        for own in level:
            v = vif(r[np.ix_(own, own)]) if len(own) > 1 else np.ones(len(own))
            if (v < threshold).all():
                if best is None or (-len(own), v.sum()) < best[:2]:
                    best = (-len(own), float(v.sum()), own)
                continue
            for k in sorted(np.flatnonzero(v >= threshold), key=lambda k: (-v[k], k))[: limit + 1]:
                less = own[:k] + own[k + 1 :]
                if less and less not in seen:
                    seen.add(less)
                    todo.append(less)
        if best is not None:
            break
    return [cols[i] for i in best[2]] if best else []


def mutual_information(df: DataFrame, cols: list[str], label: str, folds: int = 5, bins: int = 10, key: str | None = None, seed: int = 1) -> DataFrame:
    """(feature, information), averaged over hash folds, of columns in equal-frequency bins with a label, beside a random column `_probe`, best first."""
    d = df.withColumn("_probe", F.pmod(F.xxhash64(*([key] if key else df.columns), F.lit(seed)), F.lit(1 << 20)) / float(1 << 20))
    names = [*cols, "_probe"]
    edges = d.agg(*(F.percentile_approx(F.col(c).cast("double"), F.lit([i / bins for i in range(1, bins)]), F.lit(2000)).alias(c) for c in names)).first()
    bin_ = lambda c: reduce(lambda a, b: a + b, ((F.col(c) > e).cast("int") for e in edges[c] or []), F.lit(0))
    fold = F.pmod(F.xxhash64(*([key] if key else df.columns), F.lit(seed + 1)), F.lit(folds))
    long = d.select(fold.alias("fold"), F.col(label).alias("y"), F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), bin_(c).alias("v")) for c in names))).alias("r")).groupBy("fold", "r.feature", "r.v", "y").agg(F.count("*").alias("n"))
    keys = ["fold", "feature"]
    nv, ny, nt = (long.groupBy(*keys, *k).agg(F.sum("n").alias(name)) for k, name in ((["v"], "nv"), (["y"], "ny"), ([], "nt")))
    j = long.join(nv, [*keys, "v"]).join(ny, [*keys, "y"]).join(nt, keys)
    info = j.groupBy(*keys).agg(F.sum(F.col("n") / F.col("nt") * F.log(F.col("n") * F.col("nt") / (F.col("nv") * F.col("ny")))).alias("i"))
    return info.groupBy("feature").agg(F.avg("i").alias("information")).orderBy(F.desc("information"), "feature")


def _shift(n: int, k: int) -> tuple[int, int]:
    """a and b of the k-th bijection pos -> (a * pos + b) mod n of the places 0 to n - 1; a * pos stays within a long."""
    rng = np.random.default_rng(k)
    most = max(2, min(n, (1 << 62) // max(1, n)))
    a = next(x for x in (int(rng.integers(1, most)) for _ in range(10_000)) if math.gcd(x, n) == 1)
    return a, int(rng.integers(1, max(2, n)))


def importance(df: DataFrame, cols: list[str], label: str, task: str = "classification", key: str = "id", trees: int = 50, repeats: int = 3, seed: int = 1) -> DataFrame:
    """(feature, importance, permutation): a forest's importances and, averaged over repeats, what shuffling a column costs in accuracy (or in R2), beside a random probe.

    The rows are put into a random order once. A repeat is a bijection of their places: each row is joined to the one at its image, and every column in turn
    takes the value from there; so one sort serves all columns and repeats, and one join all columns of a repeat."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator

    names = [*cols, "_probe"]
    d = df.select(key, label, *cols).withColumn("_probe", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)).dropna()
    model = forest(d, names, label, task, trees, seed=seed)
    judge = MulticlassClassificationEvaluator(metricName="accuracy") if task == "classification" else RegressionEvaluator(metricName="r2")
    score = lambda x: judge.evaluate(model.transform(VectorAssembler(inputCols=names, outputCol="features").transform(x).withColumn("label", F.col(label).cast("double"))))
    placed = cut(position(d.withColumn("_h", F.xxhash64(key, F.lit(seed + 100))), ["_h", key], "_pos").select("_pos", label, *names))
    n, base, lost = placed.count(), score(d), dict.fromkeys(names, 0.0)
    for k in range(repeats):
        a, b = _shift(n, seed + k) if n > 1 else (1, 0)
        other = placed.select(((F.col("_pos") * a + b) % max(1, n)).alias("_pos"), *(F.col(c).alias(f"_other_{c}") for c in names))
        both = cut(placed.join(other, "_pos"))
        for c in names:
            lost[c] += (base - score(both.withColumn(c, F.col(f"_other_{c}")).select(label, *names))) / repeats
    return df.sparkSession.createDataFrame([(c, float(model.featureImportances[i]), float(lost[c])) for i, c in enumerate(names)], "feature string, importance double, permutation double")


def correlation_ratio(df: DataFrame, categories: list[str], value: str) -> DataFrame:
    """(feature, eta): the root of the share of the value's variance that lies between a column's categories; all columns in one pass; 0 without variance."""
    long = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("y"), F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("v")) for c in categories))).alias("r")).where("r.v is not null")
    g = long.groupBy("r.feature", "r.v").agg(F.count("*").alias("n"), F.avg("y").alias("m"), F.sum(F.col("y") * F.col("y")).alias("q"))
    t = g.groupBy("feature").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum("q").alias("q"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("b"))
    total, between = F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.col("b") - F.col("s") * F.col("s") / F.col("n")
    return t.select("feature", F.when(total > 1e-12, F.sqrt(F.greatest(between, F.lit(0.0)) / total)).otherwise(0.0).alias("eta"))


def select_features(df: DataFrame, numeric: list[str], categories: list[str], label: str, share: float = 0.9, threshold: float = 10.0) -> list[str]:
    """Constant and duplicate columns go, numeric ones are freed of collinearity and must beat the random probe, and of the categorical ones those of most
    correlation ratio, up to the share, stay."""
    gone = set(constant_columns(df, [*numeric, *categories])) | {b for _, b in duplicate_columns(df, [*numeric, *categories])}
    numeric = [c for c in numeric if c not in gone]
    if len(numeric) > 1:
        numeric = remove_multicollinearity(np.nan_to_num(correlation_matrix(df, numeric)), numeric, threshold)
    info = {r.feature: r.information for r in mutual_information(df, numeric, label).collect()} if numeric else {"_probe": 0.0}
    ranked = [r.feature for r in correlation_ratio(df, [c for c in categories if c not in gone], label).orderBy(F.desc("eta"), "feature").collect()] if categories else []
    return [c for c in numeric if info[c] > info["_probe"]] + ranked[: math.ceil(share * len(ranked))]


def common(*lists: list[str]) -> list[str]:
    """Names in all lists, in the first one's order."""
    return [c for c in lists[0] if all(c in x for x in lists[1:])]


