"""Models of Spark ML behind one interface, clustering and isolation forests as Spark jobs, searches, and scores."""

from __future__ import annotations

import itertools
import math
import queue
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml import classification as MC
from pyspark.ml import regression as MR
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.numeric import Scale
from millrace.operators.lineage import parts

KINDS = {
    ("boosting", "classification"): lambda **o: MC.GBTClassifier(**o),
    ("boosting", "regression"): lambda **o: MR.GBTRegressor(**o),
    ("forest", "classification"): lambda **o: MC.RandomForestClassifier(**o),
    ("forest", "regression"): lambda **o: MR.RandomForestRegressor(**o),
    ("logistic", "classification"): lambda **o: MC.LogisticRegression(**o),
    ("ols", "regression"): lambda **o: MR.LinearRegression(**({"solver": "normal", "fitIntercept": False} | o)),
}


class _Dealt(Pipeline):
    """A pipeline that fits itself to rows dealt into parts of bounded size: trees and logistic models keep their rows by the parts in which they get them, which
    grow with the files' splits. A table of one part's rows stays as it is."""

    def _fit(self, dataset):
        n = parts(dataset)
        return super()._fit(dataset.repartition(n) if n > dataset.sparkSession.sparkContext.defaultParallelism else dataset)


def pipeline(kind: str, task: str, features: list[str], label: str, **options) -> Pipeline:
    """Assembler and model; rows with a null feature are skipped. For boosting, validationIndicatorCol names a boolean column for early stopping."""
    return _Dealt(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), KINDS[kind, task](labelCol=label, featuresCol="features", **options)])


def score(df: DataFrame, name: str = "score") -> DataFrame:
    """df of a fitted classifier with the probability of class 1."""
    return df.withColumn(name, vector_to_array("probability")[1])


def one_vs_rest(features: list[str], label: str, **options) -> Pipeline:
    """Boosted trees for several classes."""
    return _Dealt(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), MC.OneVsRest(classifier=MC.GBTClassifier(**options), labelCol=label, featuresCol="features")])


def draws(grid: dict[str, list], n: int | None = None, seed: int = 0) -> list[dict]:
    """All combinations, or n distinct ones drawn at random."""
    every = [dict(zip(grid, v)) for v in itertools.product(*grid.values())]
    if n is None or n >= len(every):
        return every
    return [every[i] for i in np.random.default_rng(seed).choice(len(every), n, replace=False)]


#: Jobs of a search that run side by side.
PARALLEL = 4


def side_by_side(spark, jobs: list, parallel: int = PARALLEL) -> list:
    """The results of functions that each start Spark jobs, in their order, at most `parallel` at a time. Each runs in a thread that inherits the caller's
    properties and has a scheduler pool of its own, so that under fair scheduling none waits for another's tasks. The first failure ends the search."""
    pools = queue.SimpleQueue()
    for i in range(min(parallel, max(1, len(jobs)))):
        pools.put(f"trial-{i}")

    def run(job):
        name = pools.get()
        try:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
            return job()
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)
            pools.put(name)

    if parallel <= 1 or len(jobs) <= 1:
        return [job() for job in jobs]
    with ThreadPoolExecutor(parallel) as threads:
        return [f.result() for f in [threads.submit(inheritable_thread_target(spark)(run), job) for job in jobs]]


def search(df: DataFrame, make, trials: list[dict], folds: list[tuple[DataFrame, DataFrame]], judge, higher: bool = True, parallel: int = PARALLEL) -> DataFrame:
    """(trial, options, metric) with the mean metric over (train, validation) folds, best first. make(**options) gives an estimator, judge an evaluator. Trials
    and folds are fitted side by side."""
    fitted = lambda options, a, b: lambda: judge.evaluate(make(**options).fit(a).transform(b))
    got = side_by_side(df.sparkSession, [fitted(options, a, b) for options in trials for a, b in folds], parallel)
    rows = [(i, str(sorted(options.items())), float(sum(got[i * len(folds) : (i + 1) * len(folds)]) / len(folds))) for i, options in enumerate(trials)]
    order = F.desc("metric") if higher else F.asc("metric")
    return df.sparkSession.createDataFrame(rows, "trial int, options string, metric double").orderBy(order, "trial")


def refit(df: DataFrame, make, trials: list[dict], report: DataFrame):
    """The best trial's model fitted to all rows."""
    return make(**trials[report.first().trial]).fit(df)


# Clustering of mixed columns.


def _nearest(numeric: list[str], categories: list[str], centroids: list[dict], gamma: float) -> Column:
    """The number of the nearest centroid and its distance: squared differences plus gamma for each category that differs."""
    found = None
    for i, c in enumerate(centroids):
        d = F.lit(0.0)
        for k in numeric:
            d = d + F.pow(F.col(k) - F.lit(float(c[k])), F.lit(2.0))
        for k in categories:
            d = d + F.when(F.equal_null(F.col(k), F.lit(c[k])), 0.0).otherwise(gamma)
        x = F.struct(d.alias("distance"), F.lit(i).alias("cluster"))
        found = x if found is None else F.least(found, x)
    return found


def mixed(df: DataFrame, numeric: list[str], categories: list[str]) -> DataFrame:
    """The columns k_prototypes works on: numbers scaled to [0, 1], then categories as text."""
    d = Scale(cols=numeric, kind="minmax").fit(df).transform(df)
    others = [c for c in df.columns if c not in numeric and c not in categories]
    return d.select(*others, *numeric, *(F.col(c).cast("string").alias(c) for c in categories))


def k_prototypes(df: DataFrame, numeric: list[str], categories: list[str], k: int, gamma: float = 0.5, rounds: int = 20, seed: int = 0) -> tuple[DataFrame, list[dict], float]:
    """df with cluster, the centroids (means and most frequent values) and the cost. Numbers should be scaled alike, as `mixed` does. A round is one aggregate; only
    centroids reach the driver. Starts from the rows of least hashes."""
    start = df.select(*numeric, *categories).dropna(subset=numeric).distinct().orderBy(F.xxhash64(*numeric, *categories, F.lit(seed))).limit(k).collect()
    centroids, cost = [r.asDict() for r in start], math.inf
    for _ in range(rounds):
        placed = df.dropna(subset=numeric).withColumn("_x", _nearest(numeric, categories, centroids, gamma))
        got = placed.groupBy("_x.cluster").agg(F.sum("_x.distance").alias("_cost"), *(F.avg(c).alias(c) for c in numeric), *(F.mode(c, True).alias(c) for c in categories)).collect()
        now = sum(r["_cost"] for r in got)
        for r in got:
            centroids[r.cluster] = {c: r[c] for c in (*numeric, *categories)}
        if now >= cost - 1e-9 * abs(cost) if cost < math.inf else False:
            break
        cost = now
    return df.withColumn("cluster", _nearest(numeric, categories, centroids, gamma)["cluster"]), centroids, cost


def mixture(df: DataFrame, features: list[str], k: int, seed: int = 0) -> tuple[DataFrame, dict]:
    """df with cluster, and log likelihood, AIC and BIC of a Gaussian mixture."""
    d = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df)
    m = GaussianMixture(k=k, featuresCol="features", seed=seed).fit(d)
    n, dim, like = d.count(), len(features), m.summary.logLikelihood
    free = k * (dim + dim * (dim + 1) / 2) + k - 1
    return m.transform(d).withColumnRenamed("prediction", "cluster"), {"log_likelihood": like, "aic": 2 * free - 2 * like, "bic": free * math.log(n) - 2 * like}


def davies_bouldin(df: DataFrame, features: list[str], cluster: str = "cluster") -> float:
    """Mean over clusters of the worst ratio of scatters to centroid distance. Means and scatters come from two aggregates."""
    d = df.select(F.col(cluster).alias("_c"), *features).dropna()
    means = {r["_c"]: [r[f] for f in features] for r in d.groupBy("_c").agg(*(F.avg(f).alias(f) for f in features)).collect()}
    far = F.lit(None).cast("double")
    for c, m in means.items():
        far = F.when(F.col("_c") == c, F.sqrt(sum((F.pow(F.col(f) - float(x), F.lit(2.0)) for f, x in zip(features, m)), F.lit(0.0)))).otherwise(far)
    scatter = {r["_c"]: r.s for r in d.groupBy("_c").agg(F.avg(far).alias("s")).collect()}
    worst = [max(((scatter[a] + scatter[b]) / (math.dist(means[a], means[b]) or math.inf) for b in means if b != a), default=0.0) for a in means]
    return sum(worst) / len(worst) if worst else 0.0


def silhouette(df: DataFrame, features: list[str], cluster: str = "cluster") -> float:
    from pyspark.ml.evaluation import ClusteringEvaluator

    d = VectorAssembler(inputCols=features, outputCol="_f", handleInvalid="skip").transform(df)
    return ClusteringEvaluator(featuresCol="_f", predictionCol=cluster).evaluate(d)


def search_clusters(df: DataFrame, features: list[str], ks: list[int], seed: int = 0, parallel: int = PARALLEL) -> DataFrame:
    """(k, bic, aic, davies_bouldin) of a mixture for each k, fitted side by side."""

    def judged(k: int):
        placed, info = mixture(df, features, k, seed)
        placed = placed.cache()
        try:
            return k, info["bic"], info["aic"], davies_bouldin(placed, features)
        finally:
            placed.unpersist()

    rows = side_by_side(df.sparkSession, [lambda k=k: judged(k) for k in ks], parallel)
    return df.sparkSession.createDataFrame(rows, "k int, bic double, aic double, davies_bouldin double")


def pca(df: DataFrame, features: list[str], k: int = 4) -> DataFrame:
    """(component, explained, cumulative) of standardised columns."""
    d = VectorAssembler(inputCols=features, outputCol="_f", handleInvalid="skip").transform(df)
    d = StandardScaler(inputCol="_f", outputCol="_s", withMean=True).fit(d).transform(d)
    e = PCA(k=min(k, len(features)), inputCol="_s", outputCol="_p").fit(d).explainedVariance.toArray()
    return df.sparkSession.createDataFrame([(i + 1, float(v), float(e[: i + 1].sum())) for i, v in enumerate(e)], "component int, explained double, cumulative double")


# Isolation forest.


def _grow(x: np.ndarray, rng, depth: int) -> tuple:
    if depth == 0 or len(x) <= 1 or (x.max(0) == x.min(0)).all():
        return (len(x),)
    axis = rng.choice(np.flatnonzero(x.max(0) > x.min(0)))
    at = rng.uniform(x[:, axis].min(), x[:, axis].max())
    low = x[:, axis] < at
    return int(axis), float(at), _grow(x[low], rng, depth - 1), _grow(x[~low], rng, depth - 1)


def _expected(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _paths(tree: tuple, x: np.ndarray, depth: float = 0.0) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), depth + float(_expected(tree[0])))
    axis, at, a, b = tree
    low, out = x[:, axis] < at, np.empty(len(x))
    out[low], out[~low] = _paths(a, x[low], depth + 1), _paths(b, x[~low], depth + 1)
    return out


def isolation_forest(df: DataFrame, key: str, features: list[str], trees: int = 100, size: int = 256, contamination: float = 0.1, seed: int = 0) -> DataFrame:
    """df with anomaly_score in (0, 1) and is_anomaly for the `contamination` share of highest scores.

    Each tree grows in a task of its own from at most `size` rows, those with the least hashes for that tree, as isolation forests subsample by design; trees of bounded
    size are shipped to the tasks that score every row. Rows with a null feature have no score."""
    x = df.select(key, *(F.col(f).cast("double").alias(f) for f in features)).dropna()
    share = F.lit(min(1.0, 4 * size / max(1, x.count())))
    drawn_at = lambda tree: F.pmod(F.xxhash64(F.col(key), tree, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    # A row is copied only for the trees that draw it.
    tree = F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda i: drawn_at(i) < share)).alias("_tree")
    drawn = x.select("*", tree).withColumn("_h", drawn_at(F.col("_tree")))

    def grow(t: pa.Table) -> pa.Table:
        t = t.sort_by([("_h", "ascending"), (key, "ascending")]).slice(0, size)
        number = t.column("_tree")[0].as_py()
        data = np.column_stack([t.column(f).to_numpy() for f in features])
        return pa.table({"number": pa.array([number], pa.int32()), "tree": [repr(_grow(data, np.random.default_rng(seed + number), math.ceil(math.log2(size))))]})

    import ast

    grown = [ast.literal_eval(r.tree) for r in drawn.groupBy("_tree").applyInArrow(grow, "number int, tree string").orderBy("number").collect()]

    def judge(batches):
        for b in batches:
            data = np.column_stack([b.column(f).to_numpy(zero_copy_only=False) for f in features])
            mean = np.mean([_paths(t, data) for t in grown], 0) if grown else np.zeros(len(data))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(2.0 ** (-mean / float(_expected(size))))], [key, "anomaly_score"])

    scores = x.mapInArrow(judge, f"{key} {dict(x.dtypes)[key]}, anomaly_score double")
    limit = scores.agg(F.percentile_approx("anomaly_score", F.lit(1 - contamination), F.lit(10_000))).first()[0]
    return df.join(scores, key, "left").withColumn("is_anomaly", F.col("anomaly_score") > F.lit(limit))


def batch_scores(df: DataFrame, ids: list[str], score_col: str, model: str, batch: str, at) -> DataFrame:
    """The table a scoring run writes: ids, score, reference date, model, batch, status, and an id for every prediction made from its keys."""
    return df.select(*ids, F.col(score_col).alias("predict"), F.lit(at).cast("timestamp_ntz").alias("ts_run"), F.lit(model).alias("id_model"), F.lit(batch).alias("id_batch"), F.sha2(F.concat_ws("|", *ids, F.lit(model), F.lit(batch)), 256).alias("id_pred"), F.when(F.col(score_col).isNotNull(), "ok").otherwise("no_score").alias("model_status"))
