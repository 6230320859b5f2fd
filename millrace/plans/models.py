"""Models, scores and metrics over the driver's tables."""

from __future__ import annotations

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from millrace.operators import metrics as E
from millrace.operators import models as M
from millrace.operators import sets as S
from millrace.plans.registry import Registry

R = Registry()


def scored(t):
    """Labels with a score that only depends on the text's length, so that SQL can make it too."""
    d = t("documents").join(t("labels"), "doc_id")
    return d.select("doc_id", F.col("quality").alias("y"), F.round(F.least(F.lit(1.0), F.col("n_chars") / 2000.0), 2).alias("s"))


SCORED = "(SELECT doc_id, quality AS y, round(least(1.0, n_chars / 2000.0), 2) AS s, CASE WHEN round(least(1.0, n_chars / 2000.0), 2) >= 0.5 THEN 1 ELSE 0 END AS p FROM documents JOIN labels USING (doc_id))"


def classed(t):
    return scored(t).withColumn("p", F.when(F.col("s") >= 0.5, 1).otherwise(0))


def _round(d, digits=6):
    return d.select(*(F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in d.dtypes))


_XY = "(SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem)"


@R.query("l15_regression_metrics", f"""SELECT round(avg(abs(y - p)), 4) mae, round(avg((y - p) ^ 2), 4) mse, round(sqrt(avg((y - p) ^ 2)), 4) rmse, round(quantile_cont(abs(y - p), 0.5), 4) median_ae, round(1 - sum((y - p) ^ 2) / (var_pop(y) * count(*)), 4) r2,
    round(avg((ln(1 + y) - ln(1 + p)) ^ 2), 4) msle, round(sqrt(avg((ln(1 + y) - ln(1 + p)) ^ 2)), 4) rmsle, round(avg(abs((y - p) / y)) * 100, 4) mape, round(max(abs(y - p)), 4) max_error, round(1 - var_pop(y - p) / var_pop(y), 4) explained_variance,
    round(avg(2 * (y * ln(y / p) - (y - p))), 4) poisson_deviance, round(avg(2 * ((y - p) / p - ln(y / p))), 4) gamma_deviance FROM {_XY}""")
def _(t):
    return _round(E.regression_metrics(t("lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p")), "y", "p"), 4)


@R.query("l16_class_metrics", f"""WITH c AS (SELECT count(*) FILTER (y = 1 AND p = 1)::DOUBLE tp, count(*) FILTER (y = 0 AND p = 1)::DOUBLE fp, count(*) FILTER (y = 0 AND p = 0)::DOUBLE tn, count(*) FILTER (y = 1 AND p = 0)::DOUBLE fn FROM {SCORED}),
    m AS (SELECT *, tp / (tp + fp) pr, tp / (tp + fn) re, tn / (tn + fp) sp, tp + fp + tn + fn n FROM c)
    SELECT round((tp + tn) / n, 6) accuracy, round((re + sp) / 2, 6) balanced_accuracy, round(pr, 6) "precision", round(re, 6) recall, round((re + sp) / 2, 6) recall_macro, round((tp + tn) / n, 6) recall_micro, round((tp + tn) / n, 6) recall_weighted,
    round(2 * tp / (2 * tp + fp + fn), 6) f1, round(tp / (tp + fp + fn), 6) jaccard, round((re + sp) / 2, 6) roc_auc_on_classes, round(pr * re + (tp + fn) / n * (1 - re), 6) average_precision_on_classes, round((fp + fn) / n * 36.04365338911715, 6) log_loss_on_classes, round((fp + fn) / n, 6) brier_on_classes FROM m""")
def _(t):
    return _round(E.class_metrics(classed(t), "y", "p"))


@R.query("l16_score_metrics", f"""WITH d AS (SELECT * FROM {SCORED}), g AS (SELECT s, sum(y) p, sum(1 - y) q FROM d GROUP BY 1), c AS (SELECT *, sum(p) OVER w tp, sum(q) OVER w fp FROM g WINDOW w AS (ORDER BY s DESC)),
    pq AS (SELECT sum(y) p, sum(1 - y) q FROM d) SELECT round((SELECT sum(q * (tp - p / 2)) FROM c) / (p * q), 6) roc_auc, round((SELECT sum(p * tp / (tp + fp)) FROM c) / p, 6) average_precision,
    round((SELECT -avg(y * ln(greatest(1e-15, least(1 - 1e-15, s))) + (1 - y) * ln(1 - greatest(1e-15, least(1 - 1e-15, s)))) FROM d), 6) log_loss, round((SELECT avg((y - s) ^ 2) FROM d), 6) brier FROM pq""")
def _(t):
    return _round(E.score_metrics(scored(t), "y", "s"))


_GRID = "SELECT unnest(range(10, 100, 2)) / 100.0 AS threshold"
_CURVE = f"SELECT threshold, count(*) FILTER (y = 1 AND s >= threshold) tp, count(*) FILTER (y = 0 AND s >= threshold) fp, count(*) FILTER (y = 1 AND s < threshold) fn FROM ({{0}}), {SCORED} GROUP BY 1"


@R.query("l17_f1_by_threshold", f"SELECT threshold::DOUBLE AS threshold, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM ({_CURVE.format(_GRID)})")
def _(t):
    d = E.by_threshold(scored(t), "y", "s", [k / 100 for k in range(10, 100, 2)])
    return d.select("threshold", F.round("f1", 6).alias("f1"))


@R.query("l17_best_threshold", f"SELECT threshold::DOUBLE AS threshold FROM ({_CURVE.format(_GRID)}) ORDER BY round(2.0 * tp / (2 * tp + fp + fn), 9) DESC, threshold LIMIT 1")
def _(t):
    return E.first_maximum(E.by_threshold(scored(t), "y", "s", [k / 100 for k in range(10, 100, 2)]).withColumn("f1", F.round("f1", 9)), "f1").select("threshold")


@R.query("l17b_profit_by_threshold", f"SELECT threshold::DOUBLE AS threshold, (8 * tp - 3 * fp)::DOUBLE AS profit FROM ({_CURVE.format('SELECT unnest(range(10, 100, 5)) / 100.0 AS threshold')})")
def _(t):
    return E.by_threshold(scored(t), "y", "s", [k / 100 for k in range(10, 100, 5)]).select("threshold", "profit")


@R.query("l18_confusion", f"SELECT y, p, count(*) n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY y), 6) AS share FROM {SCORED} GROUP BY 1, 2")
def _(t):
    return _round(E.confusion(classed(t), "y", "p"))


@R.query("l18_class_report", f"SELECT CAST(k AS VARCHAR) AS label, round(h / nullif(f, 0), 6) AS \"precision\", round(h / s, 6) AS recall, round(2 * h / (f + s), 6) AS f1, s AS support FROM (SELECT k, count(*) FILTER (y = k AND p = k) h, count(*) FILTER (p = k) f, count(*) FILTER (y = k) s FROM {SCORED}, (SELECT unnest([0, 1]) k) GROUP BY 1)")
def _(t):
    return _round(E.class_report(classed(t), "y", "p"))


@R.query("l19_roc", f"SELECT s AS score, round(sum(sum(1 - y)) OVER w / (SELECT sum(1 - y) FROM {SCORED}), 6) AS fpr, round(sum(sum(y)) OVER w / (SELECT sum(y) FROM {SCORED}), 6) AS tpr FROM {SCORED} GROUP BY s WINDOW w AS (ORDER BY s DESC)")
def _(t):
    return _round(E.roc(scored(t), "y", "s"))


@R.query("l20_residuals", f"SELECT count(*) n, round(avg(y - p), 4) mean, round(stddev(y - p), 4) std, round(min(y - p), 4) min, round(max(y - p), 4) max FROM {_XY}")
def _(t):
    return _round(E.residuals(t("lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p")), "y", "p"), 4)


@R.query("l21_score_histogram", f"SELECT y AS label, CAST(least(floor(s * 10) + 1, 10) AS BIGINT) AS bin, count(*) n FROM {SCORED} GROUP BY 1, 2")
def _(t):
    return E.score_histogram(scored(t), "y", "s")


@R.query("l22_quality_gate", f"""WITH d AS (SELECT * FROM {SCORED}), c AS (SELECT 2.0 * count(*) FILTER (y = 1 AND p = 1) / (2 * count(*) FILTER (y = 1 AND p = 1) + count(*) FILTER (y <> p)) AS f1 FROM d), g AS (SELECT s, sum(y) p, sum(1 - y) q FROM d GROUP BY 1),
    k AS (SELECT *, sum(p) OVER (ORDER BY s DESC) tp FROM g), pq AS (SELECT sum(y) p, sum(1 - y) q FROM d) SELECT gate, f1 >= gate OR (SELECT sum(q * (tp - p / 2)) FROM k) / (p * q) >= gate + 0.2 AS passed FROM c, pq, (SELECT unnest([0.1, 0.6]) AS gate)""")
def _(t):
    m = E.class_metrics(classed(t), "y", "p").select("f1").crossJoin(E.score_metrics(scored(t), "y", "s").select("roc_auc"))
    tried = [E.quality_gate(m, f1=g, auc=g + 0.2).select(F.lit(g).alias("gate"), "passed") for g in (0.1, 0.6)]
    return tried[0].unionByName(tried[1])


@R.query("l23_batch_scores", f"SELECT doc_id, s AS predict, 'm1' AS id_model, 'ok' AS model_status FROM {SCORED}")
def _(t):
    return M.batch_scores(scored(t), ["doc_id"], "s", "m1", "b1", "2024-01-01 00:00:00").select("doc_id", "predict", "id_model", "model_status")


@R.query("l24_decisions_per_year", "SELECT year(o_orderdate) AS ano, round(avg(CASE WHEN o_totalprice / 500000 >= 0.32 THEN 1 ELSE 0 END), 6) AS taxa FROM orders GROUP BY 1")
def _(t):
    d = E.decide(t("orders").withColumn("s", F.col("o_totalprice") / 500000), "s")
    return d.groupBy(F.year("o_orderdate").alias("ano")).agg(F.round(F.avg("decision"), 6).alias("taxa"))


@R.query("l25_false_negatives", f"SELECT doc_id FROM {SCORED} WHERE y = 1 AND p = 0")
def _(t):
    return E.false_negatives(classed(t), "y", "p").select("doc_id")


@R.query("l8c_multiclass_metrics", "WITH d AS (SELECT o_orderstatus y, CASE WHEN o_orderdate < TIMESTAMP '1995-06-17' THEN 'F' ELSE 'O' END p FROM orders), k AS (SELECT DISTINCT y AS k FROM d), m AS (SELECT k, count(*) FILTER (y = k AND p = k)::DOUBLE h, count(*) FILTER (p = k) f, count(*) FILTER (y = k) s FROM d, k GROUP BY 1) SELECT round((SELECT avg(CASE WHEN y = p THEN 1.0 ELSE 0 END) FROM d), 6) AS accuracy, round((SELECT avg(CASE WHEN y = p THEN 1.0 ELSE 0 END) FROM d), 6) AS f1_micro, round((SELECT avg(2 * h / (f + s)) FROM m), 6) AS f1_macro")
def _(t):
    d = t("orders").select(F.col("o_orderstatus").alias("y"), F.when(F.col("o_orderdate") < F.lit("1995-06-17").cast("timestamp_ntz"), "F").otherwise("O").alias("p"))
    return _round(E.multiclass_metrics(d, "y", "p"))


# Fitted models: rows only, their behaviour is tested on separable data.

_FEATURES = ["l_quantity", "l_extendedprice", "l_discount"]


def _rows(t):
    d = t("lineitem").select("l_orderkey", "l_linenumber", *_FEATURES, F.when(F.col("l_extendedprice") > 30000 + 200000 * F.col("l_discount"), 1.0).otherwise(0.0).alias("y"))
    return d.withColumn("valid", F.pmod(F.xxhash64("l_orderkey"), F.lit(5)) == 0)


@R.query("l1_boosted_trees")
def _(t):
    d = _rows(t)
    m = M.pipeline("boosting", "classification", _FEATURES, "y", maxIter=5, validationIndicatorCol="valid", seed=1).fit(d)
    return E.class_metrics(m.transform(d).withColumn("p", F.col("prediction").cast("int")), "y", "p")


@R.query("l2_random_forest")
def _(t):
    d = _rows(t)
    return M.score(M.pipeline("forest", "classification", _FEATURES, "y", numTrees=5, seed=1).fit(d).transform(d)).select("l_orderkey", "l_linenumber", "score")


@R.query("l3_logistic", None)
def _(t):
    d = _rows(t)
    return M.score(M.pipeline("logistic", "classification", _FEATURES, "y", maxIter=10).fit(d).transform(d)).select("l_orderkey", "l_linenumber", "score")


@R.query("l4_ols", "SELECT round(sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity), 4) AS slope FROM lineitem")
def _(t):
    m = M.pipeline("ols", "regression", ["l_quantity"], "l_extendedprice").fit(t("lineitem"))
    return t("region").sparkSession.createDataFrame([(round(float(m.stages[-1].coefficients[0]), 4),)], "slope double")


@R.query("l5_multiclass_trees")
def _(t):
    d = t("lineitem").select("l_orderkey", "l_linenumber", *_FEATURES, F.floor(F.col("l_quantity") / 18).cast("double").alias("y"))
    return M.one_vs_rest(_FEATURES, "y", maxIter=2, maxDepth=3).fit(d).transform(d).select("l_orderkey", "l_linenumber", "prediction")


@R.query("l6_scores")
def _(t):
    d = _rows(t)
    return M.score(M.pipeline("boosting", "classification", _FEATURES, "y", maxIter=3, seed=1).fit(d).transform(d)).select("l_orderkey", "l_linenumber", "score")


@R.query("l7_search")
def _(t):
    d = S.time_folds(_rows(t), ["l_orderkey", "l_linenumber"], 2).cache()
    make = lambda **o: M.pipeline("forest", "classification", _FEATURES, "y", seed=1, **o)
    return M.search(d, make, M.draws({"numTrees": [3, 5], "maxDepth": [2, 4]}, 3, seed=2), [S.fold(d, 0), S.fold(d, 1)], BinaryClassificationEvaluator(labelCol="y"))


@R.query("l8_refit")
def _(t):
    d = _rows(t)
    make, trials = (lambda **o: M.pipeline("logistic", "classification", _FEATURES, "y", **o)), [{"regParam": 0.0}, {"regParam": 0.5}]
    report = M.search(d, make, trials, [(d.where("not valid"), d.where("valid"))], BinaryClassificationEvaluator(labelCol="y"))
    return M.score(M.refit(d, make, trials, report).transform(d)).select("l_orderkey", "l_linenumber", "score")


@R.query("l8b_grid")
def _(t):
    d = _rows(t)
    make = lambda **o: M.pipeline("forest", "classification", _FEATURES, "y", seed=1, **o)
    return M.search(d, make, M.draws({"numTrees": [3], "maxDepth": [2, 3]}), [(d.where("not valid"), d.where("valid"))], BinaryClassificationEvaluator(labelCol="y"))


@R.query("l8d_experiments", "SELECT l_returnflag AS trial, round(avg(l_discount), 6) AS error FROM lineitem GROUP BY 1 ORDER BY 2, 1")
def _(t):
    return t("lineitem").groupBy(F.col("l_returnflag").alias("trial")).agg(F.round(F.avg("l_discount"), 6).alias("error")).orderBy("error", "trial")


@R.query("l9_k_prototypes")
def _(t):
    d = M.mixed(t("customer").select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment"), ["c_acctbal"], ["c_nationkey", "c_mktsegment"])
    return M.k_prototypes(d, ["c_acctbal"], ["c_nationkey", "c_mktsegment"], 4, rounds=5)[0]


@R.query("l10_mixture")
def _(t):
    return M.mixture(t("customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], 2)[0].select("c_custkey", "cluster")


@R.query("l11_isolation_forest")
def _(t):
    return M.isolation_forest(t("part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey", ["p_size", "p_retailprice"], trees=20)


_TWO = "SELECT c_acctbal x, CASE WHEN c_acctbal > 4500 THEN 1 ELSE 0 END c FROM customer"


@R.query("l12_cluster_scores", f"""WITH d AS ({_TWO}), k AS (SELECT c, count(*)::DOUBLE n, sum(x) s, sum(x * x) q FROM d GROUP BY 1), v AS (SELECT d.x, a.n AS n, (a.n * x * x - 2 * x * a.s + a.q) / (a.n - 1) AS a, (b.n * x * x - 2 * x * b.s + b.q) / b.n AS b FROM d JOIN k a ON a.c = d.c JOIN k b ON b.c <> d.c)
    SELECT round(avg((b - a) / greatest(a, b)), 5) AS silhouette FROM v""")
def _(t):
    d = t("customer").select("c_acctbal", F.when(F.col("c_acctbal") > 4500, 1).otherwise(0).alias("cluster"))
    return t("region").sparkSession.createDataFrame([(round(M.silhouette(d, ["c_acctbal"]), 5),)], "silhouette double")


@R.query("l12_davies_bouldin", "WITH d AS (SELECT c_acctbal x, CASE WHEN c_acctbal > 4500 THEN 1 ELSE 0 END c FROM customer), m AS (SELECT c, avg(x) m FROM d GROUP BY 1), s AS (SELECT c, avg(abs(x - m)) s, max(m) m FROM d JOIN m USING (c) GROUP BY 1) SELECT round(sum(s) / (max(m) - min(m)), 6) AS davies_bouldin FROM s")
def _(t):
    d = t("customer").select("c_acctbal", F.when(F.col("c_acctbal") > 4500, 1).otherwise(0).alias("cluster"))
    return t("region").sparkSession.createDataFrame([(round(M.davies_bouldin(d, ["c_acctbal"]), 6),)], "davies_bouldin double")


@R.query("l13_search_clusters")
def _(t):
    return M.search_clusters(t("customer").select("c_acctbal"), ["c_acctbal"], [2, 3])


@R.query("l14_pca_two", "SELECT CAST(k AS INTEGER) AS component, round(CASE k WHEN 1 THEN (1 + r) / 2 ELSE (1 - r) / 2 END, 6) AS explained, round(CASE k WHEN 1 THEN (1 + r) / 2 ELSE 1 END, 6) AS cumulative FROM (SELECT abs(corr(l_quantity, l_extendedprice)) AS r FROM lineitem), range(1, 3) t(k)")
def _(t):
    d = M.pca(t("lineitem"), ["l_quantity", "l_extendedprice"])
    return d.select("component", F.round("explained", 6).alias("explained"), F.round("cumulative", 6).alias("cumulative"))


@R.query("l14_pca")
def _(t):
    return M.pca(t("lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


queries, oracle_sql = R.queries, R.oracle_sql
