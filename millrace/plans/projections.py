"""Projections, dates, numbers and encoders over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import dates as D
from millrace.functions import numeric as N
from millrace.operators import encode as E
from millrace.operators import project as P
from millrace.plans.registry import Registry

R = Registry()


@R.query("p1_apply_types", "SELECT o_orderkey, CAST(o_custkey AS DOUBLE) o_custkey, CAST(round(o_totalprice) AS BIGINT) o_totalprice, o_orderstatus FROM orders")
def _(t):
    d = t("orders").select("o_orderkey", "o_custkey", F.round("o_totalprice").alias("o_totalprice"), "o_orderstatus")
    return P.ApplyTypes(float=["o_custkey"], int=["o_totalprice"], category=["o_orderstatus"]).transform(d)


@R.query("p2_try_numeric", "SELECT c_custkey, TRY_CAST(substr(c_name, 10) AS DOUBLE) n, TRY_CAST(c_mktsegment AS DOUBLE) seg FROM customer")
def _(t):
    d = t("customer").select("c_custkey", F.substring("c_name", 10, 99).alias("n"), F.col("c_mktsegment").alias("seg"))
    return P.try_numeric(d, ["n", "seg"])


@R.query("p3_select", "SELECT p_partkey, p_size FROM part")
def _(t):
    return P.ColumnSelector(cols=["p_partkey", "p_size"]).transform(t("part"))


@R.query("p4_drop", "SELECT p_partkey, p_brand, p_size FROM part")
def _(t):
    return P.ColumnDropper(cols=["p_name", "p_type", "p_retailprice", "absent"]).transform(t("part"))


@R.query("p5_type_selector", "SELECT o_totalprice FROM orders")
def _(t):
    d = t("orders")
    return P.TypeSelector(include=["float"]).fit(d).transform(d)


@R.query("p6_rename", "SELECT s_suppkey AS id, s_name AS nome FROM supplier")
def _(t):
    return P.lower_columns(P.rename(t("supplier").select("s_suppkey", "s_name"), {"s_suppkey": "ID", "s_name": "Nome"}))


@R.query("p7_row_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 30 AND l_returnflag = 'R'")
def _(t):
    step = P.RowFilter(fitting=["l_quantity between 10 and 30", "l_returnflag = 'R'"], scoring=["l_returnflag = 'R'"])
    return step.transform(t("lineitem")).select("l_orderkey", "l_linenumber")


@R.query("p8_drop_null", "SELECT event_id, CASE WHEN value > 50 THEN value END v FROM events WHERE value > 50")
def _(t):
    return P.drop_null(t("events").select("event_id", F.when(F.col("value") > 50, F.col("value")).alias("v")), ["v"])


@R.query("p9_fill_null", "SELECT event_id, CASE WHEN value > 50 THEN value ELSE 0 END v, CASE WHEN value > 50 THEN event_type ELSE 'missing' END e FROM events")
def _(t):
    big = F.col("value") > 50
    return P.FillNull().transform(t("events").select("event_id", F.when(big, F.col("value")).alias("v"), F.when(big, F.col("event_type")).alias("e")))


@R.query("p10_mean_imputer", "SELECT event_id, CASE WHEN value > 50 THEN 0 ELSE 1 END v_dropind, round(coalesce(CASE WHEN value > 50 THEN value END, (SELECT avg(value) FROM events WHERE value > 50)), 4) v FROM events")
def _(t):
    d = t("events").select("event_id", F.when(F.col("value") > 50, F.col("value")).alias("v"))
    return P.MeanImputer(cols=["v"], indicator=True).fit(d).transform(d).withColumn("v", F.round("v", 4))


@R.query("p11_clip_negative", "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal ELSE 0 END c_acctbal FROM customer")
def _(t):
    return P.ClipNegative(cols=["c_acctbal"]).transform(t("customer").select("c_custkey", "c_acctbal"))


@R.query("p12_encode_sex", "SELECT o_orderkey, CASE lower(o_orderstatus) WHEN 'f' THEN 0.0::DOUBLE WHEN 'm' THEN 1.0 ELSE 0.5 END AS sexo FROM orders")
def _(t):
    return t("orders").select("o_orderkey", P.encode_sex(F.col("o_orderstatus")).alias("sexo"))


@R.query("p13_recode_12", "SELECT o_orderkey, abs(1 + o_orderkey % 2 - 2) AS flag FROM orders")
def _(t):
    return t("orders").select("o_orderkey", P.recode_12(1 + F.col("o_orderkey") % 2).alias("flag"))


@R.query("p14_binarize_score", "SELECT event_id, CASE WHEN s BETWEEN 0 AND 7 THEN 0 WHEN s BETWEEN 8 AND 10 THEN 1 END AS target FROM (SELECT event_id, event_id % 13 - 1 AS s FROM events)")
def _(t):
    return t("events").select("event_id", P.binarize_score(F.col("event_id") % 13 - 1).alias("target"))


_UF = "['SP','RJ','BA','XX','AM','RS','DF'][1 + s_suppkey % 7]"


@R.query("p15_lookup_region", f"SELECT s_suppkey, uf, CASE uf WHEN 'SP' THEN 'sudeste' WHEN 'RJ' THEN 'sudeste' WHEN 'BA' THEN 'nordeste' WHEN 'AM' THEN 'norte' WHEN 'RS' THEN 'sul' WHEN 'DF' THEN 'centro-oeste' ELSE 'null' END AS regiao FROM (SELECT s_suppkey, {_UF} AS uf FROM supplier)")
def _(t):
    uf = F.element_at(F.array(*map(F.lit, ["SP", "RJ", "BA", "XX", "AM", "RS", "DF"])), (F.col("s_suppkey") % 7 + 1).cast("int"))
    return P.lookup_region(t("supplier").select("s_suppkey", uf.alias("uf")), "uf")


@R.query("p16_lookup_value", "SELECT s_suppkey, s_nationkey, round(m, 2) AS gdp FROM supplier LEFT JOIN (SELECT c_nationkey, avg(c_acctbal) AS m FROM customer WHERE c_nationkey < 12 GROUP BY 1) ON s_nationkey = c_nationkey")
def _(t):
    table = t("customer").where("c_nationkey < 12").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.round(F.avg("c_acctbal"), 2).alias("gdp"))
    return P.lookup(t("supplier").select("s_suppkey", "s_nationkey"), table, "s_nationkey", "gdp")


@R.query("p17_classify_contains", "SELECT p_partkey, CASE WHEN contains(p_type, 'STEEL') THEN 'ACO' WHEN contains(p_type, 'BRASS') THEN 'LATAO' WHEN contains(p_type, 'PROMO') THEN 'PROMO' ELSE 'GERAL' END AS classe FROM part")
def _(t):
    return t("part").select("p_partkey", P.classify_contains(F.col("p_type"), [("STEEL", "ACO"), ("BRASS", "LATAO"), ("PROMO", "PROMO")]).alias("classe"))


@R.query("p18_encode_map", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END AS code FROM orders")
def _(t):
    return t("orders").select("o_orderkey", P.encode_map(F.col("o_orderstatus"), {"F": 0, "O": 1, "P": 2}).alias("code"))


@R.query("p19_delta_mean", "SELECT l_orderkey, l_linenumber, round(l_discount - l_tax, 4) AS temp_delta, round((l_discount + l_tax) / 2, 4) AS temp_mean FROM lineitem")
def _(t):
    a, b = F.col("l_discount"), F.col("l_tax")
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(a - b, 4).alias("temp_delta"), F.round((a + b) / 2, 4).alias("temp_mean"))


@R.query("p20_zfill", "SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 11, '0') AS cpf FROM customer")
def _(t):
    return t("customer").select("c_custkey", P.zfill(F.col("c_custkey")).alias("cpf"))


@R.query("p21_two_scores", "SELECT o_orderkey, coalesce(a, b) AS nota FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END a, CASE WHEN o_orderkey % 2 = 0 THEN 1.0 END b FROM orders) WHERE a IS NOT NULL OR (b IS NOT NULL AND o_orderdate > DATE '1997-01-01')")
def _(t):
    d = t("orders").select("o_orderkey", "o_orderdate", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).alias("a"), F.when(F.col("o_orderkey") % 2 == 0, 1.0).alias("b"))
    return P.two_scores(d, "a", "b", "o_orderdate", "1997-01-01", "nota").select("o_orderkey", "nota")


@R.query("p22_presence_flag", "SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') THEN 1 ELSE 0 END AS has FROM customer")
def _(t):
    o = t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return P.presence_flag(t("customer").select("c_custkey"), o, ["c_custkey"], "has")


@R.query("p23_custom_step", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand")
def _(t):
    return P.CustomStep(statement="select p_brand, count(*) as n from __THIS__ group by p_brand").transform(t("part"))


@R.query("p24_between_dates", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-07-01'")
def _(t):
    return t("orders").where(P.between_dates(F.col("o_orderdate"), "1996-01-01", "1996-07-01")).select("o_orderkey")


@R.query("p25_valid_text", "SELECT doc_id FROM documents WHERE text IS NOT NULL AND text NOT IN ('', '<NA>')")
def _(t):
    return t("documents").where(P.valid_text(F.col("text"))).select("doc_id")


@R.query(
    "d1_d8_date_columns",
    """SELECT event_id, hour(ts) hora, day(ts) dia, month(ts) mes, year(ts) ano, isodow(ts) dia_semana, dayofyear(ts) dia_ano,
    CAST(ceil((day(ts) + isodow(date_trunc('month', ts)) - 1) / 7.0) AS INTEGER) semana_mes,
    CASE WHEN day(ts) <= 9 THEN 1 WHEN day(ts) <= 17 THEN 2 WHEN day(ts) <= 24 THEN 3 ELSE 4 END quarto_mes, weekofyear(ts) semana_ano,
    CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END fds, CASE WHEN hour(ts) <= 6 THEN 'madrugada' WHEN hour(ts) <= 12 THEN 'manha' WHEN hour(ts) <= 18 THEN 'tarde' ELSE 'noite' END periodo_dia FROM events""",
)
def _(t):
    return D.with_date_columns(t("events").select("event_id", "ts"), "ts").drop("ts")


_DAYS = "CAST(floor(date_diff('second', o_orderdate, TIMESTAMP '{0}') / 86400.0) + 1 AS INTEGER)"


@R.query(
    "d9_days_to_events",
    f"""WITH x AS (SELECT o_orderkey, {_DAYS.format('1996-12-25')} AS "dias_para_natal1996", {_DAYS.format('1997-12-25')} AS "dias_para_natal1997", {_DAYS.format('1997-05-11')} AS "dias_para_maes1997",
    CAST(o_orderdate AS DATE) IN (DATE '1996-12-25', DATE '1997-12-25') AS natal, CAST(o_orderdate AS DATE) IN (DATE '1997-05-11') AS maes FROM orders)
    SELECT *, list_min(list_filter([dias_para_natal1996, dias_para_natal1997, dias_para_maes1997], lambda v: v >= 0)) AS dias_prox_evento FROM x""",
)
def _(t):
    return D.days_to_events(t("orders").select("o_orderkey", "o_orderdate"), "o_orderdate", {"natal": ["1996-12-25", "1997-12-25"], "maes": ["1997-05-11"]}).drop("o_orderdate")


@R.query("d10_days_since", "SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') AS idade FROM orders")
def _(t):
    return t("orders").select("o_orderkey", D.days_since(F.lit("1999-01-01").cast("date"), F.col("o_orderdate")).cast("bigint").alias("idade"))


@R.query("d11_months_on_book", "SELECT o_custkey, (1999 - min(year(o_orderdate))) * 12 + 1 - month(min(o_orderdate)) AS mob FROM orders GROUP BY 1")
def _(t):
    first = t("orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first"))
    return first.select("o_custkey", D.months_on_book(F.lit("1999-01-01").cast("date"), F.col("first")).cast("bigint").alias("mob"))


@R.query("d12_horizon", "SELECT event_id, ts + INTERVAL 5 MINUTE AS predict_to FROM events")
def _(t):
    return t("events").select("event_id", D.horizon(F.col("ts")).alias("predict_to"))


@R.query("n1_sin_cos", "SELECT p_partkey, round(cos(2 * pi() * p_size / (SELECT max(p_size) FROM part)), 6) AS p_size_cos, round(sin(2 * pi() * p_size / (SELECT max(p_size) FROM part)), 6) + 0.0 AS p_size_sen FROM part")
def _(t):
    d = t("part").select("p_partkey", F.col("p_size").cast("double"))
    got = N.SinCos(cols=["p_size"]).fit(d).transform(d)
    return got.select("p_partkey", F.round("p_size_cos", 6).alias("p_size_cos"), (F.round("p_size_sen", 6) + 0.0).alias("p_size_sen"))


@R.query("n2_annual_cosine", "SELECT o_orderkey, round(cos(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) * 2 * pi() / 365.25), 6) AS cos_ano FROM orders")
def _(t):
    return t("orders").select("o_orderkey", F.round(N.annual_cosine(F.col("o_orderdate"), "1992-01-01"), 6).alias("cos_ano"))


@R.query("n3_yeo_johnson_apply", "SELECT c_custkey, round(CASE WHEN c_acctbal >= 0 THEN (pow(c_acctbal + 1, 0.5) - 1) / 0.5 ELSE -(pow(1 - c_acctbal, 1.5) - 1) / 1.5 END, 4) AS x FROM customer")
def _(t):
    return t("customer").select("c_custkey", F.round(N.yeo_johnson(F.col("c_acctbal"), 0.5), 4).alias("x"))


def transformed_sql(x: str, lam: str) -> str:
    """The power transform of x with lambda, in SQL."""
    up = f"CASE WHEN abs({lam}) < 1e-12 THEN ln(1 + {x}) ELSE (pow({x} + 1, {lam}) - 1) / nullif({lam}, 0) END"
    down = f"CASE WHEN abs({lam} - 2) < 1e-12 THEN -ln(1 - {x}) ELSE -(pow(1 - {x}, 2 - {lam}) - 1) / nullif(2 - {lam}, 0) END"
    return f"CASE WHEN {x} >= 0 THEN {up} WHEN {x} < 0 THEN {down} END"


def yeo_johnson_sql(table: str, col: str, source: str = "c") -> str:
    """The likeliest lambda of a column, by three rounds of a finer grid around the best one so far."""
    ctes = [f"x AS (SELECT CAST({col} AS DOUBLE) AS x FROM {source})", "s AS (SELECT count(x) AS n, sum(sign(x) * ln(1 + abs(x))) AS s FROM x)"]
    for i, width in enumerate((2.0, 0.25, 0.03125)):
        around = "0.0" if i == 0 else f"(SELECT lam FROM r{i - 1})"
        ctes.append(f"g{i} AS (SELECT DISTINCT greatest(-2.0, least(2.0, {around} + {width} * k / 8)) AS lam FROM range(-8, 9) t(k))")
        ctes.append(f"r{i} AS (SELECT CAST(lam AS DOUBLE) AS lam FROM x, g{i}, s GROUP BY lam, n, s ORDER BY -n / 2 * ln(var_pop({transformed_sql('x', 'CAST(lam AS DOUBLE)')})) + (lam - 1) * s DESC NULLS LAST, lam LIMIT 1)")
    return f"WITH {', '.join(ctes)} SELECT lam FROM r2"


@R.query("n3_yeo_johnson_fit", f"WITH c AS (SELECT o_orderkey, o_totalprice FROM orders), l AS ({yeo_johnson_sql('c', 'o_totalprice')}) SELECT o_orderkey, round({transformed_sql('o_totalprice', 'lam')}, 3) AS x, lam FROM c, l")
def _(t):
    d = t("orders").select("o_orderkey", "o_totalprice")
    m = N.YeoJohnson(cols=["o_totalprice"]).fit(d)
    return m.transform(d).select("o_orderkey", F.round("o_totalprice", 3).alias("x"), F.lit(m.values["lambdas"]["o_totalprice"]).alias("lam"))


@R.query("n4_outliers", "WITH s AS (SELECT avg(l_extendedprice) m, stddev(l_extendedprice) d FROM lineitem) SELECT l_orderkey, l_linenumber, round(greatest(m - d, least(m + d, l_extendedprice)), 3) AS x FROM lineitem, s")
def _(t):
    d = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("x"))
    return N.Outliers(cols=["x"], band=1.0).fit(d).transform(d).withColumn("x", F.round("x", 3))


@R.query("n4_outliers_mean", "WITH s AS (SELECT avg(l_extendedprice) m, stddev(l_extendedprice) d FROM lineitem) SELECT l_orderkey, l_linenumber, round(CASE WHEN l_extendedprice <= m - d OR l_extendedprice >= m + d THEN m ELSE l_extendedprice END, 3) AS x FROM lineitem, s")
def _(t):
    d = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("x"))
    return N.Outliers(cols=["x"], band=1.0, action="mean").fit(d).transform(d).withColumn("x", F.round("x", 3))


@R.query("n5_minmax", "SELECT p_partkey, round((p_retailprice - (SELECT min(p_retailprice) FROM part)) / (SELECT max(p_retailprice) - min(p_retailprice) FROM part), 6) AS x FROM part")
def _(t):
    d = t("part").select("p_partkey", F.col("p_retailprice").alias("x"))
    return N.Scale(cols=["x"]).fit(d).transform(d).withColumn("x", F.round("x", 6))


@R.query("n5_standard", "SELECT p_partkey, round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_pop(p_retailprice) FROM part), 5) AS x FROM part")
def _(t):
    d = t("part").select("p_partkey", F.col("p_retailprice").alias("x"))
    return N.Scale(cols=["x"], kind="standard").fit(d).transform(d).withColumn("x", F.round("x", 5))


@R.query("n6_moments", "SELECT l_returnflag, round(skewness(l_extendedprice), 6) AS skew, round(kurtosis(l_extendedprice), 6) AS kurt FROM lineitem GROUP BY 1")
def _(t):
    n = F.count("l_extendedprice")
    return t("lineitem").groupBy("l_returnflag").agg(F.round(N.bias_free_skew(n, F.skewness("l_extendedprice")), 6).alias("skew"), F.round(N.bias_free_kurtosis(n, F.kurtosis("l_extendedprice")), 6).alias("kurt"))


@R.query("e1_one_hot", "SELECT o_orderkey, (o_orderstatus = 'F')::INT AS \"o_orderstatus_F\", (o_orderstatus = 'O')::INT AS \"o_orderstatus_O\", (o_orderstatus = 'P')::INT AS \"o_orderstatus_P\" FROM orders")
def _(t):
    d = t("orders").select("o_orderkey", "o_orderstatus")
    return E.OneHot(cols=["o_orderstatus"]).fit(d).transform(d)


@R.query("e2_one_hot_drop_first", "SELECT o_orderkey, (o_orderstatus = 'O')::INT AS o_orderstatus_1, (o_orderstatus = 'P')::INT AS o_orderstatus_2 FROM orders")
def _(t):
    d = t("orders").select("o_orderkey", "o_orderstatus")
    return E.OneHot(cols=["o_orderstatus"], drop_first=True).fit(d).transform(d)


@R.query("e3_label_encoder", "SELECT c_custkey, CAST(coalesce(r, (SELECT count(DISTINCT c_mktsegment) FROM customer WHERE c_custkey % 2 = 0)) AS INTEGER) AS c_mktsegment FROM customer LEFT JOIN (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS r FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_custkey % 2 = 0)) USING (c_mktsegment)")
def _(t):
    d = t("customer").select("c_custkey", "c_mktsegment")
    return E.LabelEncoder(cols=["c_mktsegment"]).fit(d.where("c_custkey % 2 = 0")).transform(d)


@R.query("e4_target_encoder", "SELECT c_custkey, round(m, 4) AS c_mktsegment FROM customer JOIN (SELECT c_mktsegment, avg(c_acctbal) m FROM customer GROUP BY 1) USING (c_mktsegment)")
def _(t):
    d = t("customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return E.TargetEncoder(cols=["c_mktsegment"], target="c_acctbal").fit(d).transform(d).select("c_custkey", F.round("c_mktsegment", 4).alias("c_mktsegment"))


@R.query("e4_target_encoder_median", "SELECT o_orderkey, round(coalesce(m, (SELECT avg(m) FROM (SELECT quantile_cont(o_totalprice, 0.5) m FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_orderstatus))), 4) AS o_orderstatus FROM orders LEFT JOIN (SELECT o_orderstatus, quantile_cont(o_totalprice, 0.5) m FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) USING (o_orderstatus)")
def _(t):
    d = t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    model = E.TargetEncoder(cols=["o_orderstatus"], target="o_totalprice", how="median", unknown="mean").fit(d.where("o_orderstatus <> 'P'"))
    return model.transform(d).select("o_orderkey", F.round("o_orderstatus", 4).alias("o_orderstatus"))


@R.query("e5_group_rare", "SELECT p_partkey, CASE WHEN n > 0.04 * (SELECT count(*) FROM part) THEN p_brand ELSE 'grouped' END AS p_brand FROM part JOIN (SELECT p_brand, count(*) n FROM part GROUP BY 1) USING (p_brand)")
def _(t):
    d = t("part").select("p_partkey", "p_brand")
    return E.GroupRare(cols=["p_brand"], threshold=0.04).fit(d).transform(d)


@R.query("x1_text_basics", "SELECT p_partkey, lower(trim(p_name)) AS a, substr(p_type, 1, 3) AS b, split_part(p_type, ' ', 1) AS c FROM part")
def _(t):
    return t("part").select("p_partkey", F.lower(F.trim("p_name")).alias("a"), F.substring("p_type", 1, 3).alias("b"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("c"))


queries, oracle_sql = R.queries, R.oracle_sql
