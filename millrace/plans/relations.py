"""Joins, aggregates, sorts, splits and set operations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import aggregate as A
from millrace.operators import joins as J
from millrace.operators import sets as S
from millrace.plans.registry import Registry

R = Registry()


def items(t):
    """Item rows of customers: lineitem with its order's customer and date."""
    o = t("orders").select(F.col("o_orderkey").alias("cupom"), F.col("o_custkey").alias("cod_cliente"), F.col("o_orderdate").alias("data_venda"))
    i = t("lineitem").select(F.col("l_orderkey").alias("cupom"), F.col("l_quantity").alias("qtd"), F.col("l_extendedprice").alias("val"))
    return i.join(o, "cupom")


ITEMS = "(SELECT o_orderkey cupom, o_custkey cod_cliente, o_orderdate data_venda, l_quantity qtd, l_extendedprice val FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
PANEL = f"(SELECT cod_cliente, CAST(date_trunc('month', data_venda) AS DATE) AS date, sum(qtd) qtd, sum(val) val, count(cupom) compras_mes, count(DISTINCT cupom) cupons_mes FROM {ITEMS} GROUP BY 1, 2)"


def panel(t):
    return A.monthly_panel(items(t), "cod_cliente", "data_venda", ["qtd", "val"], "cupom")


@R.query("j1_join_activations", "SELECT l_orderkey, l_linenumber, l_shipdate, o_orderstatus FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON l_orderkey = o_orderkey WHERE l_shipdate IS NOT NULL")
def _(t):
    i = t("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    a = t("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return J.join_activations(i, a, ["l_orderkey"], "l_shipdate")


@R.query("j2_join_dim", "SELECT n_regionkey, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(t):
    n = t("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    return J.join_dim(t("customer").select("c_custkey", "c_nationkey"), n, ["c_nationkey"]).drop("c_nationkey")


@R.query("j3_left_with_flag", "SELECT p_partkey, CASE WHEN l_partkey IS NULL THEN 0 ELSE 1 END sold FROM part LEFT JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity >= 50) ON p_partkey = l_partkey")
def _(t):
    sold = t("lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return J.left_with_flag(t("part").select("p_partkey"), sold, ["p_partkey"], "sold")


@R.query("j4_left_latest", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) = 1) ON c_custkey = o_custkey")
def _(t):
    o = t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    return J.left_latest(t("customer").select("c_custkey"), o, ["c_custkey"], "o_orderdate", ["o_orderkey"]).select("c_custkey", "o_orderkey")


@R.query("j5_enrich", "SELECT c_custkey, n, n2 AS b_n FROM customer LEFT JOIN (SELECT o_custkey, count(*) n FROM orders GROUP BY 1) x ON c_custkey = x.o_custkey LEFT JOIN (SELECT o_custkey, count(*) n2 FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) y ON c_custkey = y.o_custkey")
def _(t):
    o = t("orders").withColumnRenamed("o_custkey", "c_custkey")
    n = lambda d: d.groupBy("c_custkey").agg(F.count("*").alias("n"))
    return J.enrich(t("customer").select("c_custkey"), {"a": n(o), "b": n(o.where("o_orderstatus = 'P'"))}, ["c_custkey"])


@R.query("j6_join_named", "SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def _(t):
    return J.join_named(t("supplier").select("s_suppkey", "s_nationkey"), t("nation").select("n_nationkey", "n_name"), {"s_nationkey": "n_nationkey"}).drop("s_nationkey")


_KIND = "SELECT DISTINCT user_id, CAST(ts AS DATE) dia FROM events WHERE event_type = '{}'"


@R.query("j7_event_outcomes", f"SELECT user_id, dia, CASE WHEN c.user_id IS NULL THEN 0 ELSE 1 END clicked, CASE WHEN p.user_id IS NULL THEN 0 ELSE 1 END bought FROM ({_KIND.format('view')}) LEFT JOIN ({_KIND.format('click')}) c USING (user_id, dia) LEFT JOIN ({_KIND.format('purchase')}) p USING (user_id, dia)")
def _(t):
    e = t("events").select("user_id", F.to_date("ts").alias("dia"), "event_type")
    of = lambda k: e.where(F.col("event_type") == k).drop("event_type")
    return J.join_event_outcomes(of("view"), {"clicked": of("click"), "bought": of("purchase")}, ["user_id", "dia"])


@R.query("j8_range_join", "SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 30 DAY")
def _(t):
    o = t("orders").select(F.col("o_orderkey"), "o_orderdate")
    i = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_shipdate")
    near = (F.col("l_shipdate") >= F.col("o_orderdate")) & (F.col("l_shipdate") < F.col("o_orderdate") + F.expr("interval 30 days"))
    return J.range_join(o, i, ["o_orderkey"], near).select("o_orderkey", "l_linenumber")


@R.query("j9_restrict_ids", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def _(t):
    ids = t("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return J.restrict_ids(t("orders").select("o_orderkey", "o_custkey"), ids, "o_custkey").drop("o_custkey")


@R.query("j10_remaining", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(t):
    return J.remaining(t("customer").select("c_custkey"), t("orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@R.query("j11_set_difference", "SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1995 EXCEPT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996")
def _(t):
    of = lambda y: t("orders").where(F.year("o_orderdate") == y).select("o_custkey").distinct()
    return J.remaining(of(1995), of(1996), ["o_custkey"])


@R.query("j12_feature_union", "SELECT k, a, b FROM (SELECT o_custkey k, count(*) a FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) FULL JOIN (SELECT c_custkey k, c_acctbal b FROM customer WHERE c_acctbal < 1000) USING (k)")
def _(t):
    a = t("orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("a"))
    b = t("customer").where("c_acctbal < 1000").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("b"))
    return J.feature_union([a, b], ["k"])


@R.query("j13_align_to", "SELECT d.dia, n FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) dia FROM lineitem) d LEFT JOIN (SELECT CAST(o_orderdate AS DATE) dia, count(*) n FROM orders GROUP BY 1) USING (dia)")
def _(t):
    n = t("orders").groupBy(F.to_date("o_orderdate").alias("dia")).agg(F.count("*").alias("n"))
    return J.align_to(n, t("lineitem").select(F.to_date("l_shipdate").alias("dia")), "dia")


@R.query("j14_text_lookup", "SELECT a.doc_id, count(b.doc_id) n FROM documents a LEFT JOIN documents b ON a.text = b.text GROUP BY 1")
def _(t):
    d = t("documents").select("doc_id", "text")
    return J.text_lookup(d, d.select("text", F.col("doc_id").alias("other")), "text", "other").groupBy("doc_id").agg(F.count("other").alias("n"))


@R.query("j15_prediction_labels", "SELECT quality, n_chars > 500 AS p, count(*) n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2")
def _(t):
    p = t("documents").select("doc_id", (F.col("n_chars") > 500).alias("p"))
    return p.join(t("labels"), "doc_id").groupBy("quality", "p").agg(F.count("*").alias("n"))


@R.query("a1_split_date", "SELECT o_orderkey, year(o_orderdate) ano, month(o_orderdate) mes FROM orders")
def _(t):
    return A.split_date(t("orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d")), "d").drop("d")


@R.query("a2_monthly_sums", f"SELECT cod_cliente, date, round(qtd, 2) qtd, round(val, 2) val FROM {PANEL}")
def _(t):
    return panel(t).select("cod_cliente", "date", F.round("qtd", 2).alias("qtd"), F.round("val", 2).alias("val"))


@R.query("a3_monthly_counts", f"SELECT cod_cliente, date, compras_mes, cupons_mes FROM {PANEL}")
def _(t):
    return panel(t).select("cod_cliente", "date", "compras_mes", "cupons_mes")


@R.query("a4_monthly_panel", f"SELECT cod_cliente, date, round(qtd, 2) qtd, round(val, 2) val, compras_mes, cupons_mes FROM {PANEL}")
def _(t):
    return panel(t).withColumns({"qtd": F.round("qtd", 2), "val": F.round("val", 2)})


def _churn_sql(first, last, window, target, prefix="agg_l3m_"):
    return f"""WITH p AS (SELECT * FROM {PANEL}), r AS (SELECT CAST(unnest(generate_series(DATE '{first}' + INTERVAL 2 MONTH, DATE '{last}' - INTERVAL {window} MONTH, INTERVAL 1 MONTH)) AS DATE) AS r),
    agg AS (SELECT cod_cliente, r, sum(qtd) q, sum(val) v, CAST(sum(compras_mes) AS BIGINT) c FROM p JOIN r ON p.date BETWEEN r - INTERVAL 2 MONTH AND r GROUP BY 1, 2)
    SELECT m.cod_cliente, m.date, round(m.qtd, 2) qtd, round(m.val, 2) val, m.compras_mes, round(q, 2) {prefix}qtd, round(v, 2) {prefix}val, c {prefix}compras_mes, CASE WHEN {target} THEN 0 ELSE 1 END target
    FROM p m JOIN agg ON m.cod_cliente = agg.cod_cliente AND m.date = agg.r"""


_ROUND = ("qtd", "val")
_SPAN = ("1995-01-01", "1996-06-01")


def churn(t, **options):
    d = panel(t)
    prefix = options.get("prefix", "agg_l3m_")
    got = A.churn_samples(d, "cod_cliente", ["qtd", "val"], *_SPAN, **options)
    return got.withColumns({c: F.round(c, 2) for c in (*_ROUND, *(prefix + x for x in _ROUND))})


@R.query("a6_churn_samples", _churn_sql(*_SPAN, 1, "EXISTS (SELECT 1 FROM p n WHERE n.cod_cliente = m.cod_cliente AND n.date = m.date + INTERVAL 1 MONTH)"))
def _(t):
    return churn(t)


@R.query("a6b_churn_samples_3m", _churn_sql(*_SPAN, 3, "coalesce((SELECT sum(qtd) FROM p n WHERE n.cod_cliente = m.cod_cliente AND n.date BETWEEN m.date + INTERVAL 1 MONTH AND m.date + INTERVAL 4 MONTH), 0) > 0", "avg_l3m_"))
def _(t):
    return churn(t, target_range=3, inclusive=True, quantity="qtd", prefix="avg_l3m_")


@R.query("a5_trailing_sums", f"WITH p AS (SELECT * FROM {PANEL}) SELECT m.cod_cliente, m.date, round(sum(n.qtd), 2) AS agg_l3m_qtd FROM p m JOIN p n ON m.cod_cliente = n.cod_cliente AND n.date BETWEEN m.date - INTERVAL 2 MONTH AND m.date WHERE m.date BETWEEN DATE '1995-03-01' AND DATE '1996-05-01' GROUP BY 1, 2")
def _(t):
    return churn(t).select("cod_cliente", "date", "agg_l3m_qtd")


@R.query("a6_churn_rate", f"SELECT date, count(*) clientes, round(avg(target), 6) churn FROM ({_churn_sql(*_SPAN, 1, 'EXISTS (SELECT 1 FROM p n WHERE n.cod_cliente = m.cod_cliente AND n.date = m.date + INTERVAL 1 MONTH)')}) GROUP BY 1")
def _(t):
    return churn(t).groupBy("date").agg(F.count("*").alias("clientes"), F.round(F.avg("target"), 6).alias("churn"))


@R.query(
    "a9_recency_features",
    """SELECT user_id, count(value) FILTER (ts > TIMESTAMP '2024-01-20') AS n_1m, round(coalesce(sum(value) FILTER (ts > TIMESTAMP '2024-01-10'), 0), 3) AS sum_3m, round(avg(value) FILTER (ts > TIMESTAMP '2024-01-10'), 8) AS mean_3m,
    count(DISTINCT event_type) FILTER (ts > TIMESTAMP '2024-01-10') AS kinds_3m, round(max(value) FILTER (ts > TIMESTAMP '2024-01-10') - min(value) FILTER (ts > TIMESTAMP '2024-01-10'), 3) AS span_3m, arg_min(event_type, (ts, event_id)) FILTER (ts > TIMESTAMP '2024-01-10') AS first_3m FROM events GROUP BY user_id""",
)
def _(t):
    ts, v = F.col("ts"), F.col("value")
    m1, m3 = ts > F.lit("2024-01-20").cast("timestamp_ntz"), ts > F.lit("2024-01-10").cast("timestamp_ntz")
    specs = {"n_1m": ("count", m1, v), "sum_3m": ("sum", m3, v), "mean_3m": ("mean", m3, v), "kinds_3m": ("nunique", m3, F.col("event_type")), "hi": ("max", m3, v), "lo": ("min", m3, v), "first_3m": ("first", m3, F.col("event_type"))}
    d = A.recency_features(t("events"), "user_id", specs, ["ts", "event_id"])
    return d.select("user_id", "n_1m", F.round("sum_3m", 3).alias("sum_3m"), F.round("mean_3m", 8).alias("mean_3m"), "kinds_3m", F.round(F.col("hi") - F.col("lo"), 3).alias("span_3m"), "first_3m")


@R.query("a10_mode", "SELECT user_id, first(event_type ORDER BY n DESC, event_type) AS moda FROM (SELECT user_id, event_type, count(*) n FROM events GROUP BY 1, 2) GROUP BY 1")
def _(t):
    return A.recency_features(t("events"), "user_id", {"moda": ("mode", F.lit(True), F.col("event_type"))})


@R.query("a11_frequencies", "SELECT o_orderpriority, round(count(*) / (SELECT count(*) FROM orders), 6) AS share FROM orders GROUP BY 1")
def _(t):
    return A.frequencies(t("orders"), "o_orderpriority", True).withColumn("share", F.round("share", 6))


@R.query("a11_value_counts", "SELECT o_orderpriority, count(*) n FROM orders GROUP BY 1")
def _(t):
    return A.frequencies(t("orders"), "o_orderpriority")


@R.query("a12_crosstab", "SELECT quality, toxic, count(*) n FROM labels GROUP BY 1, 2")
def _(t):
    return A.crosstab(t("labels"), "quality", "toxic")


@R.query("a13_cluster_profile", "SELECT c_nationkey, round(count(*) FILTER (c_mktsegment = 'BUILDING') * 100.0 / count(*), 4) AS \"BUILDING\", round(count(*) FILTER (c_mktsegment = 'MACHINERY') * 100.0 / count(*), 4) AS \"MACHINERY\" FROM customer GROUP BY 1")
def _(t):
    d = A.cluster_profile(t("customer"), "c_nationkey", "c_mktsegment", ["BUILDING", "MACHINERY"])
    return d.withColumns({c: F.round(c, 4) for c in ("BUILDING", "MACHINERY")})


@R.query("a14_describe", "SELECT 'l_quantity' feature, CAST(count(l_quantity) AS DOUBLE) n, round(avg(l_quantity), 4) mean, round(stddev(l_quantity), 4) std, min(l_quantity) min, quantile_cont(l_quantity, 0.25) q25, quantile_cont(l_quantity, 0.5) q50, quantile_cont(l_quantity, 0.75) q75, max(l_quantity) max FROM lineitem")
def _(t):
    return A.describe(t("lineitem"), ["l_quantity"]).withColumns({c: F.round(c, 4) for c in ("mean", "std")})


_PROFILE = "SELECT '{0}' feature, property, round(value, 4) AS value FROM (SELECT avg({0}) AS mean, stddev({0}) AS std, CAST(min({0}) AS DOUBLE) AS min, CAST(max({0}) AS DOUBLE) AS max, CAST(quantile_cont({0}, 0.5) AS DOUBLE) AS q50, CAST(quantile_cont({0}, 0.75) AS DOUBLE) AS q75, skewness({0}) AS skew, kurtosis({0}) AS kurtosis FROM {1}) UNPIVOT (value FOR property IN (mean, std, min, max, q50, q75, skew, kurtosis))"


@R.query("a15_profile", " UNION ALL ".join(_PROFILE.format(c, "lineitem") for c in ("l_quantity", "l_discount", "l_tax")))
def _(t):
    return A.profile(t("lineitem"), ["l_quantity", "l_discount", "l_tax"]).withColumn("value", F.round("value", 4))


@R.query("a15_category_profile", "SELECT 'l_returnflag' feature, l_returnflag category, round(count(*) / (SELECT count(*) FROM lineitem), 6) AS share FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linestatus', l_linestatus, round(count(*) / (SELECT count(*) FROM lineitem), 6) FROM lineitem GROUP BY 2")
def _(t):
    return A.category_profile(t("lineitem"), ["l_returnflag", "l_linestatus"]).withColumn("share", F.round("share", 6))


_FORMAT = "CASE WHEN bool_and(regexp_full_match({0}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')) THEN 'yyyy-MM-dd' WHEN bool_and(regexp_full_match({0}, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}')) THEN 'dd/MM/yyyy' ELSE 'custom' END"


@R.query("a15_date_format", f"SELECT 'd' AS feature, {_FORMAT.format('d')} AS format FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') d FROM orders) UNION ALL SELECT 's', {_FORMAT.format('o_orderstatus')} FROM orders")
def _(t):
    d = t("orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), F.col("o_orderstatus").alias("s"))
    return A.date_format(d, ["d", "s"], {"yyyy-MM-dd": "yyyy-MM-dd", "dd/MM/yyyy": "dd/MM/yyyy"})


@R.query("a16_metric_mean", "SELECT round(avg(p), 6) p, round(avg(r), 6) r FROM (SELECT l_returnflag, avg(l_discount) p, avg(l_tax) r FROM lineitem GROUP BY 1)")
def _(t):
    m = t("lineitem").groupBy("l_returnflag").agg(F.avg("l_discount").alias("p"), F.avg("l_tax").alias("r"))
    return m.agg(F.round(F.avg("p"), 6).alias("p"), F.round(F.avg("r"), 6).alias("r"))


@R.query("a17_per_month", "SELECT year(ts) ano, month(ts) mes, count(*) n FROM events GROUP BY 1, 2")
def _(t):
    return t("events").groupBy(F.year("ts").alias("ano"), F.month("ts").alias("mes")).agg(F.count("*").alias("n"))


@R.query("a18_coverage", "SELECT count(*) base, count(o_custkey) covered, count(o_custkey) / count(*) AS share FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey")
def _(t):
    return A.coverage(t("customer"), t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@R.query("a19_active_ids", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'")
def _(t):
    return A.active_ids(t("orders"), "o_custkey", "o_orderdate", "1998-01-01")


@R.query("a20_positive_ratio", "SELECT round(avg(quality), 6) AS ratio FROM labels")
def _(t):
    return t("labels").agg(F.round(F.avg("quality"), 6).alias("ratio"))


@R.query("t1_sort", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def _(t):
    return t("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")


@R.query("t2_top_k", "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders QUALIFY rank <= 3")
def _(t):
    return S.top_k(t("orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).drop("o_totalprice")


@R.query("t3_best", "SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_size DESC, p_partkey LIMIT 5")
def _(t):
    return S.best(t("part"), [F.desc("p_retailprice"), F.desc("p_size"), "p_partkey"], 5).select("p_partkey")


@R.query("t4_split_position", "SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey) - 1 < floor(0.8 * (SELECT count(*) FROM orders)) THEN 0 ELSE 1 END AS part FROM orders")
def _(t):
    return S.split_position(t("orders").select("o_orderkey"), ["o_orderkey"], [0.8, 0.2])


@R.query("t5_split_date", "SELECT CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 'train' ELSE 'valid' END AS part, count(*) n, round(count(*) / (SELECT count(*) FROM orders), 6) AS share FROM orders GROUP BY 1")
def _(t):
    a, b = S.split_date(t("orders"), "o_orderdate", "1997-01-01")
    d = a.select(F.lit("train").alias("part")).unionByName(b.select(F.lit("valid").alias("part")))
    return d.groupBy("part").agg(F.count("*").alias("n")).join(A.frequencies(d, "part", True), "part").withColumn("share", F.round("share", 6))


@R.query("t6_split_random", "SELECT o_orderkey, CASE WHEN ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || '|3'), 1, 7))::BIGINT / 268435456.0 < 0.85 THEN 0 ELSE 1 END AS part FROM orders")
def _(t):
    return S.split_random(t("orders").select("o_orderkey"), ["o_orderkey"], [0.85, 0.15], seed=3)


@R.query("t7_time_folds", "SELECT o_orderkey, CAST(CASE WHEN p < n - 4 * (n // 5) THEN 0 ELSE (p - (n - 4 * (n // 5))) // (n // 5) + 1 END AS INTEGER) AS block FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS p, (SELECT count(*) FROM orders) AS n FROM orders)")
def _(t):
    return S.time_folds(t("orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 4).select("o_orderkey", "block")


@R.query("t8_balance", "SELECT quality, (SELECT count(*) FROM labels WHERE quality = 0) AS n FROM labels GROUP BY 1")
def _(t):
    return S.balance(t("labels"), "quality", ["doc_id"]).groupBy("quality").agg(F.count("*").alias("n"))


@R.query("t9_class_weight", "SELECT count(*) FILTER (toxic = 0) / count(*) FILTER (toxic = 1) AS weight FROM labels")
def _(t):
    return S.class_weight(t("labels"), "toxic")


@R.query("t10_sample_rows", "SELECT least(count(*), 100) AS n, least(count(DISTINCT o_orderkey), 100) AS d, least(count(*), 100) AS found FROM orders")
def _(t):
    some = S.sample_rows(t("orders"), ["o_orderkey"], 100, 5).select("o_orderkey", F.lit(1).alias("x"))
    return t("orders").join(some, "o_orderkey", "left").agg(F.count("x").alias("n"), F.count_distinct(F.when(F.col("x") == 1, F.col("o_orderkey"))).alias("d"), F.sum("x").alias("found"))


@R.query("t11_three_way_split", "SELECT CASE WHEN p < floor(0.7 * n + 1e-9) THEN 0 WHEN p < floor(0.85 * n + 1e-9) THEN 1 ELSE 2 END AS part, count(*) AS c FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS p, (SELECT count(*) FROM orders) AS n FROM orders) GROUP BY 1")
def _(t):
    d = t("orders").select("o_orderkey", F.xxhash64("o_orderkey", F.lit(9)).alias("h"))
    return S.split_position(d, ["h", "o_orderkey"], [70, 15, 15]).groupBy("part").agg(F.count("*").alias("c"))


@R.query("u1_union_all", "SELECT c_custkey AS k, c_acctbal AS bal, NULL::VARCHAR AS nome FROM customer UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier")
def _(t):
    return S.union_all(t("customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal")), t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("nome")))


@R.query("u2_distinct", "SELECT DISTINCT p_brand, p_size FROM part")
def _(t):
    return t("part").select("p_brand", "p_size").distinct()


@R.query("u3_category_sets", "SELECT list_sort(list_filter(a, lambda x: NOT list_contains(b, x))) AS missing, list_sort(list_filter(a, lambda x: list_contains(b, x))) AS common FROM (SELECT list(DISTINCT p_brand) FILTER (p_size < 10) a, list(DISTINCT p_brand) FILTER (p_size > 49) b FROM part)")
def _(t):
    p = t("part")
    d = S.compare_sets(p.where("p_size < 10").select("p_brand"), p.where("p_size > 49").select("p_brand"))
    side = lambda kind, name: F.array_sort(F.collect_list(F.when(F.col("side") == kind, F.col("p_brand")))).alias(name)
    return d.agg(side("first", "missing"), side("both", "common"))


_EDITED = "(SELECT * REPLACE (CASE WHEN p_partkey = 7 THEN -1 ELSE p_size END AS p_size) FROM part)"


@R.query("u4_same_rows", f"""SELECT NOT EXISTS ((SELECT * FROM part EXCEPT ALL SELECT * FROM (SELECT * FROM part ORDER BY p_partkey DESC)) UNION ALL (SELECT * FROM (SELECT * FROM part ORDER BY p_partkey DESC) EXCEPT ALL SELECT * FROM part)) AS shuffled,
    NOT EXISTS ((SELECT * FROM part EXCEPT ALL SELECT * FROM {_EDITED}) UNION ALL (SELECT * FROM {_EDITED} EXCEPT ALL SELECT * FROM part)) AS changed""")
def _(t):
    d = t("part")
    other = d.withColumn("p_size", F.when(F.col("p_partkey") == 7, -1).otherwise(F.col("p_size")))
    return d.sparkSession.createDataFrame([(S.same_rows(d, d.orderBy(F.desc("p_partkey"))), S.same_rows(d, other))], "shuffled boolean, changed boolean")


@R.query("w5_first_per_key", "SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber) = 1")
def _(t):
    return S.first_per_key(t("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), ["l_orderkey"], [F.desc("l_shipdate"), "l_linenumber"]).drop("l_shipdate")


queries, oracle_sql = R.queries, R.oracle_sql
