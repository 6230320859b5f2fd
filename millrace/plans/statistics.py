"""Statistics and feature selection over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import selection as S
from millrace.plans.registry import Registry

R = Registry()
_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _names(t, names, column="feature"):
    return t("region").sparkSession.createDataFrame([(n,) for n in names], f"{column} string")


@R.query("f1_constant_columns", "SELECT feature FROM (SELECT 'p_size' AS feature, count(DISTINCT p_size) n FROM part UNION ALL SELECT 'p_brand', count(DISTINCT p_brand) FROM part UNION ALL SELECT 'k', count(DISTINCT 3) FROM part) WHERE n <= 1")
def _(t):
    return _names(t, S.constant_columns(t("part").select("p_size", "p_brand").withColumn("k", F.lit(3))))


@R.query("f2_quasi_constant", "SELECT feature FROM (SELECT 'l_quantity' feature, var_samp(l_quantity) v FROM lineitem UNION ALL SELECT 'l_discount', var_samp(l_discount) FROM lineitem UNION ALL SELECT 'l_tax', var_samp(l_tax) FROM lineitem) WHERE v < 0.01")
def _(t):
    return _names(t, S.quasi_constant(t("lineitem"), ["l_quantity", "l_discount", "l_tax"]))


@R.query("f3_low_variance", "SELECT l_orderkey, l_quantity FROM lineitem")
def _(t):
    d = t("lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax")
    return S.LowVariance(cols=["l_quantity", "l_discount", "l_tax"]).fit(d).transform(d)


_SAME = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, bool_and(CAST({a} AS VARCHAR) IS NOT DISTINCT FROM CAST({b} AS VARCHAR)) AS same FROM (SELECT *, p_brand AS again FROM part)" for a, b in (("p_brand", "p_type"), ("p_brand", "p_size"), ("p_brand", "again"), ("p_type", "p_size"), ("p_type", "again"), ("p_size", "again")))


@R.query("f4_duplicate_columns", f"SELECT a, b FROM ({_SAME}) WHERE same")
def _(t):
    d = t("part").select("p_brand", "p_type", "p_size").withColumn("again", F.col("p_brand"))
    return t("part").sparkSession.createDataFrame(S.duplicate_columns(d), "a string, b string")


@R.query("f5_entropy", "SELECT round(-sum(p * ln(p)), 6) AS entropy FROM (SELECT count(*) / (SELECT count(*) FROM orders) AS p FROM orders GROUP BY o_orderpriority)")
def _(t):
    return S.entropy(t("orders"), "o_orderpriority").withColumn("entropy", F.round("entropy", 6))


_CATS = ["l_returnflag", "l_linestatus", "l_linenumber"]


def _u(x, y):
    return f"""SELECT '{x}' AS x, '{y}' AS y, round((hx - hxy) / hx, 6) AS u FROM (SELECT -sum(p * ln(p)) hx FROM (SELECT count(*) / (SELECT count(*) FROM lineitem) p FROM lineitem GROUP BY {x})),
    (SELECT -sum(n / t * ln(n / ny)) hxy FROM (SELECT {x}, {y}, count(*) n FROM lineitem GROUP BY 1, 2) JOIN (SELECT {y}, count(*) ny FROM lineitem GROUP BY 1) USING ({y}), (SELECT count(*) t FROM lineitem))"""


@R.query("f7_theils_u_matrix", " UNION ALL ".join(_u(x, y) for x in _CATS for y in _CATS if x != y))
def _(t):
    return S.uncertainty(t("lineitem"), _CATS).withColumn("u", F.round("u", 6))


@R.query("f6_theils_u", _u("l_returnflag", "l_linestatus"))
def _(t):
    return S.uncertainty(t("lineitem"), ["l_returnflag", "l_linestatus"], ["l_returnflag"]).withColumn("u", F.round("u", 6))


@R.query("f8_theils_u_target", " UNION ALL ".join(_u("l_returnflag", y) for y in _CATS[1:]) + " ORDER BY u DESC")
def _(t):
    return S.uncertainty(t("lineitem"), _CATS, ["l_returnflag"]).withColumn("u", F.round("u", 6)).orderBy(F.desc("u"))


@R.query("f9_correlation", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(_NUM) for b in _NUM[i + 1 :]))
def _(t):
    return S.correlation_long(t("lineitem"), _NUM).withColumn("r", F.round("r", 6))


@R.query("f10_correlated_groups", "SELECT 'l_extendedprice' AS feature WHERE (SELECT abs(corr(l_quantity, l_extendedprice)) FROM lineitem) > 0.5")
def _(t):
    return _names(t, S.later_correlated(S.correlation_matrix(t("lineitem"), _NUM), _NUM, 0.5))


@R.query("f11_select_by_correlation")
def _(t):
    d = t("lineitem").select(*_NUM, F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y")).withColumn("double_q", F.col("l_quantity") * 2)
    return _names(t, S.SelectByCorrelation(cols=["l_quantity", "double_q", "l_discount"], label="y", threshold=0.9, trees=5).fit(d).values["dropped"])


@R.query("f12_vif", "SELECT f AS feature, round(1 / (1 - r * r), 6) AS vif FROM (SELECT corr(l_quantity, l_extendedprice) r FROM lineitem), (SELECT unnest(['l_quantity', 'l_extendedprice']) AS f)")
def _(t):
    cols = ["l_quantity", "l_extendedprice"]
    v = S.vif(S.correlation_matrix(t("lineitem"), cols))
    return t("region").sparkSession.createDataFrame([(c, round(float(x), 6)) for c, x in zip(cols, v)], "feature string, vif double")


@R.query("f13_multicollinearity", "SELECT unnest(['b', 'l_tax', 'l_quantity']) AS feature")
def _(t):
    d = t("lineitem").select("l_quantity", F.col("l_discount").alias("b"), "l_tax", (F.col("l_quantity") + 10 * F.col("l_discount")).alias("s"))
    cols = d.columns
    return _names(t, S.remove_multicollinearity(S.correlation_matrix(d, cols), cols))


@R.query("f14_mutual_information")
def _(t):
    d = t("lineitem").select("l_orderkey", "l_linenumber", *_NUM, F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"))
    return S.mutual_information(d, _NUM, "y")


@R.query("f15_importance")
def _(t):
    d = t("orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("o_custkey"), F.when(F.col("o_totalprice") > 200000, 1).otherwise(0).alias("y"))
    return S.importance(d, ["o_totalprice", "o_custkey"], "y", key="o_orderkey", trees=5, repeats=1)


_ETA = "SELECT '{0}' AS feature, round(sqrt(sum(n * (m - g) ^ 2) / (SELECT sum((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) ^ 2) FROM orders)), 5) AS eta FROM (SELECT {0}, count(*) n, avg(o_totalprice) m FROM orders GROUP BY 1), (SELECT avg(o_totalprice) g FROM orders)"


@R.query("f16_correlation_ratio", " UNION ALL ".join(_ETA.format(c) for c in ("o_orderstatus", "o_orderpriority")))
def _(t):
    return S.correlation_ratio(t("orders"), ["o_orderstatus", "o_orderpriority"], "o_totalprice").withColumn("eta", F.round("eta", 5))


@R.query("f17_select_features")
def _(t):
    d = t("lineitem").select(*_NUM, "l_linestatus", "l_linenumber", F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"))
    return _names(t, S.select_features(d, _NUM, ["l_linestatus", "l_linenumber"], "y"))


_SPREAD = " UNION ALL ".join(f"SELECT '{c}' AS feature, var_samp({c}) AS sample, var_pop({c}) AS whole FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax"))


@R.query("u5_common_features", f"SELECT feature FROM ({_SPREAD}) WHERE sample < 0.01 AND whole <= 0.01")
def _(t):
    d, cols = t("lineitem"), ["l_quantity", "l_discount", "l_tax"]
    return _names(t, S.common(S.quasi_constant(d, cols), S.LowVariance(cols=cols).fit(d).values["dropped"]))


queries, oracle_sql = R.queries, R.oracle_sql
