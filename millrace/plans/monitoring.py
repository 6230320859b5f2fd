"""Validation, drift, control charts and registries over the driver's tables."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from millrace.operators import aggregate as A
from millrace.operators import monitor as M
from millrace.plans.registry import Registry
from millrace.plans.relations import _FORMAT

R = Registry()
_OLD, _NEW = "o_orderdate < TIMESTAMP '1995-06-01'", "o_orderdate >= TIMESTAMP '1995-06-01'"


def _halves(t):
    d = t("orders").withColumn("x", F.when(F.col("o_orderdate") >= F.lit("1995-06-01").cast("timestamp_ntz"), F.col("o_totalprice") * 1.5).otherwise(F.col("o_totalprice")))
    cut = F.col("o_orderdate") < F.lit("1995-06-01").cast("timestamp_ntz")
    return d.where(cut), d.where(~cut)


@R.query("m1_compare_schema", "SELECT * FROM (VALUES ('p_size', 'int', 'missing'), ('p_size', 'str', 'new'), ('p_type', 'str', 'missing'), ('extra', 'int', 'new')) v(feature, type, status)")
def _(t):
    d = t("part")
    return M.compare_schema(M.schema_table(d), M.schema_table(d.drop("p_type").withColumns({"p_size": F.col("p_size").cast("string"), "extra": F.lit(1)})))


@R.query("m2_baseline", "SELECT 'p_size' AS feature, 'mean' AS property, round(avg(p_size), 6) AS value FROM part UNION ALL SELECT 'p_size', 'std', round(stddev(p_size), 6) FROM part UNION ALL SELECT 'p_size', 'max', CAST(max(p_size) AS DOUBLE) FROM part")
def _(t):
    return A.profile(t("part"), ["p_size"]).where("property in ('mean', 'std', 'max')").withColumn("value", F.round("value", 6))


_STAT = "SELECT avg(x) AS mean, stddev(x) AS std, min(x) AS min, max(x) AS max, quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.75) AS q75, skewness(x) AS skew, kurtosis(x) AS kurtosis FROM (SELECT o_totalprice * {1} AS x FROM orders WHERE {0})"
_DRIFT = f"""SELECT 'x' AS feature, property, baseline, current, (current - baseline) / baseline AS ratio FROM (SELECT property, value AS baseline FROM ({_STAT.format(_OLD, 1)}) UNPIVOT (value FOR property IN (mean, std, min, max, q50, q75, skew, kurtosis)))
    JOIN (SELECT property, value AS current FROM ({_STAT.format(_NEW, 1.5)}) UNPIVOT (value FOR property IN (mean, std, min, max, q50, q75, skew, kurtosis))) USING (property) WHERE abs((current - baseline) / baseline) > {{0}}"""


@R.query("m3_numeric_drift", f"SELECT feature, property, round(ratio, 5) AS ratio, round(abs(ratio), 5) AS distance FROM ({_DRIFT.format(0.15)})")
def _(t):
    a, b = _halves(t)
    d = M.numeric_drift(A.profile(a, ["x"]), A.profile(b, ["x"]))
    return d.select("feature", "property", F.round("ratio", 5).alias("ratio"), F.round("distance", 5).alias("distance"))


@R.query("m17_drift_thresholds", f"SELECT feature, property FROM ({_DRIFT.format(0.45)})")
def _(t):
    a, b = _halves(t)
    return M.numeric_drift(A.profile(a, ["x"]), A.profile(b, ["x"]), thresholds=M.drift_thresholds(a, ["x"], 0.45)).select("feature", "property")


_BRANDS = "(SELECT list(DISTINCT p_brand) FROM part WHERE p_size {})"


_KINDS = "SELECT p_brand || '-' || CAST(p_size % 5 AS VARCHAR) AS kind, p_size FROM part"


@R.query("m4_category_drift", f"SELECT 'kind' AS feature, list_sort(list_filter(a, lambda x: NOT list_contains(b, x))) AS missing, list_sort(list_filter(b, lambda x: NOT list_contains(a, x))) AS new FROM (SELECT list(DISTINCT kind) FILTER (p_size % 5 < 3) a, list(DISTINCT kind) FILTER (p_size % 5 > 1) b FROM ({_KINDS}))")
def _(t):
    p = t("part").select(F.concat("p_brand", F.lit("-"), (F.col("p_size") % 5).cast("string")).alias("kind"), "p_size")
    return M.category_drift(A.category_profile(p.where("p_size % 5 < 3"), ["kind"]), A.category_profile(p.where("p_size % 5 > 1"), ["kind"]))


@R.query("m5_frequency_drift", "SELECT 'o_orderstatus' AS feature, o_orderstatus AS category, round(b, 6) AS baseline, round(c, 6) AS current FROM (SELECT o_orderstatus, count(*) FILTER (o_orderkey % 3 = 0) / (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 0) b, count(*) FILTER (o_orderkey % 3 > 0) / (SELECT count(*) FROM orders WHERE o_orderkey % 3 > 0) c FROM orders GROUP BY 1) ORDER BY abs(b - c) DESC, category DESC LIMIT 1")
def _(t):
    o = t("orders")
    d = M.frequency_drift(A.category_profile(o.where("o_orderkey % 3 = 0"), ["o_orderstatus"]), A.category_profile(o.where("o_orderkey % 3 > 0"), ["o_orderstatus"]), 0.0)
    return d.select("feature", "category", F.round("baseline", 6).alias("baseline"), F.round("current", 6).alias("current"))


@R.query("m6_date_format_drift", f"SELECT 'd' AS feature, b AS baseline, c AS current FROM (SELECT {_FORMAT.format('d')} AS b FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') d FROM orders)), (SELECT {_FORMAT.format('d')} AS c FROM (SELECT strftime(o_orderdate, '%d/%m/%Y') d FROM orders)) WHERE b <> c")
def _(t):
    kinds = {"yyyy-MM-dd": "yyyy-MM-dd", "dd/MM/yyyy": "dd/MM/yyyy"}
    of = lambda p: A.date_format(t("orders").select(F.date_format("o_orderdate", p).alias("d")), ["d"], kinds)
    return M.date_format_drift(of("yyyy-MM-dd"), of("dd/MM/yyyy"))


@R.query("m7_shifted_features", f"SELECT 'x' AS feature, 'distribution' AS reason FROM ({_DRIFT.format(0.15)}) HAVING count(*) >= 4 UNION ALL SELECT 'p_type', 'input'")
def _(t):
    a, b = _halves(t)
    schema = M.compare_schema(M.schema_table(t("part")), M.schema_table(t("part").drop("p_type")))
    return M.shifted_features(M.numeric_drift(A.profile(a, ["x"]), A.profile(b, ["x"])), schema)


@R.query("m8_validation", "SELECT * FROM (VALUES ('o_totalprice', 'non_null_share', true), ('o_totalprice', 'mean_near', true), ('o_totalprice', 'min_in_range', true), ('o_totalprice', 'max_in_range', (SELECT max(o_totalprice) * 2 <= max(o_totalprice) FROM orders)), ('o_orderstatus', 'non_null_share', true), ('o_orderstatus', 'in_set', false), ('flag', 'non_null_share', true), ('flag', 'is_flag', true)) v(\"column\", \"check\", success)")
def _(t):
    d = t("orders").select("o_totalprice", "o_orderstatus", (F.col("o_orderkey") % 2).cast("tinyint").alias("flag"))
    now = d.withColumns({"o_orderstatus": F.when(F.col("o_orderstatus") == "P", "X").otherwise(F.col("o_orderstatus")), "o_totalprice": F.when(F.col("o_totalprice") >= t("orders").agg(F.max("o_totalprice")).first()[0], F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice"))})
    return M.ValidationSuite(numeric=["o_totalprice"], categories=["o_orderstatus"], flags=["flag"]).fit(d).transform(now).drop("observed")


_CHART = """WITH s AS (SELECT user_id, round(avg(value), 3) mean, round(stddev(value), 3) std, round(avg(value) + 3 * stddev(value), 3) ucl, round(avg(value) - 3 * stddev(value), 3) lcl FROM events GROUP BY 1)
    SELECT user_id, event_id, CASE WHEN value >= ucl OR value <= lcl THEN 1 ELSE 0 END AS ooc, round(sum(CASE WHEN value >= ucl OR value <= lcl THEN 1 ELSE 0 END) OVER w / row_number() OVER w, 6) AS ratio FROM events JOIN s USING (user_id) WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)"""


@R.query("m9_control_chart", _CHART)
def _(t):
    return M.control_chart(t("events"), "event_id", ["value"], ["user_id"]).select("user_id", "event_id", "ooc", F.round("ratio", 6).alias("ratio"))


@R.query("m9_control_limits", "SELECT user_id, 'value' AS feature, round(avg(value), 3) mean, round(stddev(value), 3) std, round(avg(value) + stddev(value), 3) usl, round(avg(value) - stddev(value), 3) lsl FROM events GROUP BY 1")
def _(t):
    return M.control_limits(t("events"), ["value"], ["user_id"]).drop("ucl", "lcl")


@R.query("m10_ooc_summary", f"SELECT user_id, 'value' AS feature, least(round(ratio, 6), 0.15)::DOUBLE AS share, CASE WHEN ratio <= 0.05 THEN 'ok' WHEN ratio < 0.07 THEN 'warn' ELSE 'bad' END AS status FROM ({_CHART}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def _(t):
    c = M.control_chart(t("events"), "event_id", ["value"], ["user_id"]).withColumn("ratio", F.round("ratio", 6))
    return M.ooc_summary(c, "event_id", ["user_id"])


@R.query("m11_given_limits", "SELECT event_id, CASE WHEN value >= 120 OR value <= 1 THEN 1 ELSE 0 END AS ooc FROM events")
def _(t):
    limits = t("events").sparkSession.createDataFrame([("value", 1.0, 120.0)], "feature string, lcl double, ucl double")
    return M.control_chart(t("events").withColumn("g", F.col("user_id")), "event_id", ["value"], limits=limits).select("event_id", "ooc")


def _metrics(t):
    return t("supplier").groupBy(F.concat(F.lit("m"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0")).alias("model")).agg(F.round(F.avg("s_acctbal"), 4).alias("f1"), F.round(F.stddev("s_acctbal"), 4).alias("brier"))


_MET = "SELECT 'm' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS model, round(avg(s_acctbal), 4) AS f1, round(stddev(s_acctbal), 4) AS brier FROM supplier GROUP BY 1"


@R.query("m12_record_metrics", _MET)
def _(t):
    m = _metrics(t)
    return M.record_metrics(m, m.withColumn("model", F.concat("model", F.lit("_again"))), ["model"], ["f1", "brier"])


@R.query("m13_select_best", f"SELECT model FROM ({_MET}) WHERE f1 IS NOT NULL AND brier IS NOT NULL ORDER BY f1 DESC, brier, model DESC LIMIT 1")
def _(t):
    best = M.select_best(_metrics(t).dropna(), "model", {"f1": 2.0, "brier": 1.0})
    return t("region").sparkSession.createDataFrame([(best,)] if best is not None else [], "model string")


@R.query("m14_promote", f"SELECT CASE WHEN model = 'm03' THEN 'baseline' WHEN model = 'baseline' THEN 'previous' ELSE model END AS model FROM ({_MET} UNION ALL SELECT 'baseline', 0, 0)")
def _(t):
    m = _metrics(t).select("model")
    return M.promote(m.unionByName(m.limit(1).select(F.lit("baseline").alias("model"))), "model", "m03")


@R.query("m15_pick_production", f"SELECT model FROM ({_MET}) ORDER BY f1 DESC NULLS LAST, brier DESC NULLS LAST, model LIMIT 1")
def _(t):
    return M.pick_production(_metrics(t), ["f1", "brier"]).select("model")


_ALTERED = "EXISTS ((SELECT * FROM supplier EXCEPT ALL SELECT * FROM {0}) UNION ALL (SELECT * FROM {0} EXCEPT ALL SELECT * FROM supplier))"


@R.query("m16_changed", f"SELECT {_ALTERED.format('(SELECT * FROM supplier ORDER BY s_suppkey DESC)')} AS same, {_ALTERED.format('(SELECT * FROM supplier WHERE s_suppkey > 1)')} AS edited")
def _(t):
    d = t("supplier")
    return d.sparkSession.createDataFrame([(M.changed(d.orderBy(F.desc("s_suppkey")), d), M.changed(d.where("s_suppkey > 1"), d))], "same boolean, edited boolean")


@R.query("m18_active_model", "SELECT 'm_' || o_orderpriority AS model FROM orders ORDER BY o_orderdate DESC, 1 DESC LIMIT 1")
def _(t):
    log = t("orders").select(F.concat(F.lit("m_"), "o_orderpriority").alias("model"), F.col("o_orderdate").alias("rollout"))
    return M.active_model(M.log_rollout(log, "first", datetime.datetime(1980, 1, 1), log.sparkSession))


@R.query("m19_null_counts", "SELECT 'big' AS feature, count(*) FILTER (p_size <= 40) AS nulls FROM part UNION ALL SELECT 'p_partkey', 0")
def _(t):
    return M.null_counts(t("part").select("p_partkey", F.when(F.col("p_size") > 40, 1).alias("big")))


queries, oracle_sql = R.queries, R.oracle_sql
