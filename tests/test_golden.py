"""Golden values of the operators' documented behaviour, and each trap's intended result."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import dates, numeric, text
from millrace.operators import aggregate, encode, joins, metrics, models, monitor, neighbours, project, selection, sets, spans, timeseries, vocabulary
from millrace.sources import io


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_dates(spark):
    start = datetime.datetime(2018, 1, 1)
    df = spark.createDataFrame([(i, start + datetime.timedelta(hours=430 * i)) for i in range(22)], "i int, datetime timestamp_ntz")
    got = dates.with_date_columns(df, "datetime").orderBy("i").collect()
    assert [r.semana_mes for r in got] == [1, 3, 2, 4, 3, 5, 4, 1, 4, 3, 5, 4, 1, 4, 2, 5, 2, 1, 4, 2, 5, 2]
    assert [r.quarto_mes for r in got] == [1, 3, 1, 3, 2, 4, 3, 1, 3, 2, 4, 2, 1, 3, 1, 4, 2, 1, 3, 1, 4, 2]
    assert [r.semana_ano for r in got] == [1, 3, 6, 8, 11, 13, 16, 18, 21, 24, 26, 29, 31, 34, 36, 39, 41, 44, 47, 49, 52, 2]
    assert got[0].periodo_dia == "madrugada" and rows(dates.with_date_columns(spark.sql("select timestamp_ntz'2018-01-01 06:00:00' as d"), "d"), "periodo_dia") == [("madrugada",)]


def test_days_to_events(spark):
    df = spark.sql("select timestamp_ntz'2020-12-24 00:00:00' as d union all select timestamp_ntz'2020-12-25 10:00:00' union all select timestamp_ntz'2020-12-26 00:00:00'")
    got = dates.days_to_events(df, "d", {"natal": ["2020-12-25"]}).orderBy("d").collect()
    assert [(r.dias_para_natal2020, r.dias_prox_evento, r.natal) for r in got] == [(2, 2, False), (0, 0, True), (0, 0, False)]
    with pytest.raises(ValueError):
        dates.days_to_events(df, "d", {"natal": ["2020-12-25", "2020-12-26"]})


def test_sin_cos(spark):
    inf = float("inf")
    fit = spark.createDataFrame([(float(i), 0.0, 1.0, x) for i, x in zip((1, 2, 3, 4), (inf, inf, -inf, 0.0))], "range_4 double, equal_0 double, equal_1 double, inf double")
    new = spark.createDataFrame([(float(i), 0.0, 1.0, x) for i, x in zip((1, 2, 3, 5), (inf, inf, -inf, 0.0))], fit.schema)
    got = numeric.SinCos(cols=fit.columns).fit(fit).transform(new)
    assert got.columns == sorted(got.columns)
    got = got.collect()
    for r, c, s in zip(got, (0, -1, 0, 1), (1, 0, -1, 0)):
        assert abs(r.range_4_cos - c) < 1e-9 and abs(r.range_4_sen - s) < 1e-9
        assert r.equal_0_cos is None and abs(r.equal_1_cos - 1) < 1e-9 and abs(r.equal_1_sen) < 1e-9
    assert [r.inf_cos for r in got] == [None, None, None, 1.0] and got[3].inf_sen == 0.0


def test_type_selector_and_projection(spark):
    df = project.as_category(spark.createDataFrame([(1, 1.0, "a", "b", float("nan"), float("inf"))], "int bigint, float double, categorical string, object string, nan double, inf double"), ["categorical"])
    pick = lambda *k: project.TypeSelector(include=list(k)).fit(df).transform(df).columns
    assert pick("int") == ["int"] and pick("float") == ["float", "nan", "inf"] and pick("category") == ["categorical"] and pick("str") == ["object"]
    with pytest.raises(ValueError):
        pick("datetime")
    model = project.TypeSelector(include=["int"]).fit(df)
    with pytest.raises(ValueError):
        model.transform(df.withColumn("int", F.col("int").cast("string")))
    assert project.ColumnDropper(cols=["absent", "int"]).transform(df).columns == df.columns[1:]


def test_fill_and_impute(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (None, None), (None, None)], "x double, nan double")
    assert rows(project.FillNull(value=-1).transform(df), "x", "nan") == [(1, -1), (2, -1), (-1, -1), (-1, -1)]
    assert rows(project.MeanImputer(cols=["x"], indicator=True).fit(df).transform(df), "x", "x_dropind") == [(1, 0), (2, 0), (1.5, 1), (1.5, 1)]
    assert rows(project.ClipNegative(cols=["x"]).transform(df), "x") == [(1,), (2,), (0,), (0,)]


def test_encoders(spark):
    df = spark.createDataFrame([("a", "a", 1), ("a", "a", 1), ("b", "b", 1), ("b", "b", 1), (None, "c", 1)], "nulos string, cat string, num bigint")
    model = encode.OneHot(cols=["nulos", "cat", "num"]).fit(df)
    got = model.transform(spark.createDataFrame([("c", None, 1)], df.schema))
    assert got.columns == ["nulos_a", "nulos_b", "nulos_nan_ohe", "cat_a", "cat_b", "cat_c", "num_1"] and rows(got, *got.columns) == [(0, 0, 0, 0, 0, 0, 1)]
    two = spark.createDataFrame([("a",), ("b",), ("b",)], "cat1 string")
    label = encode.LabelEncoder(cols=["cat1"]).fit(two)
    assert rows(label.transform(two), "cat1") == [(0,), (1,), (1,)] and rows(label.transform(spark.createDataFrame([("K",), (None,)], two.schema)), "cat1") == [(2,), (2,)]
    rare = spark.createDataFrame([(c,) for c in "aaaaaaaabb"] + [("ab",)] * 10, "c string")
    assert {r.c for r in encode.GroupRare(cols=["c"], threshold=0.1).fit(rare).transform(spark.createDataFrame([("a",), ("b",), ("ab",), ("new",)], "c string")).collect()} == {"a", "grouped", "ab"}
    t = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 10.0)], "k int, y double")
    assert rows(encode.TargetEncoder(cols=["k"], target="y", unknown="mean").fit(t).transform(spark.createDataFrame([(1, 0.0), (2, 0.0), (9, 0.0)], t.schema)), "k") == [(2,), (10,), (6,)]


def test_stages_save_and_load(spark, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel

    df = spark.createDataFrame([("a", 1.0), ("b", None)], "c string, x double")
    model = Pipeline(stages=[encode.OneHot(cols=["c"]), project.FillNull(value=0)]).fit(df)
    model.save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert again.transform(df).collect() == model.transform(df).collect()


def test_words(spark):
    df = spark.createDataFrame(list(enumerate(["aqui tem um texto", "texto nao explicativo", "nada a ver"])), "id long, texto string")
    m = vocabulary.TfIdf(key="id", text="texto", max_features=3).fit(df)
    assert m.values["vocabulary"] == ["aqui", "explicativo", "texto"]
    got = rows(m.transform(df).orderBy("id"), "aqui", "explicativo", "texto")
    for a, b in zip(got, [(0.795960545, 0, 0.605348527), (0, 0.795960545, 0.605348527), (0, 0, 0)]):
        assert all(abs(x - y) < 1e-6 for x, y in zip(a, b))
    assert rows(m.transform(spark.createDataFrame([(1, "texto")], df.schema)), "texto") == [(1.0,)]
    df = spark.createDataFrame(list(enumerate(["aqui aqui tem um texto texto", "texto nao explicativo", "nada a ver"])), "id long, texto string")
    b = vocabulary.BagOfWords(key="id", text="texto", max_features=5).fit(df)
    assert b.values["vocabulary"] == ["aqui", "explicativo", "nada", "nao", "texto"]
    assert rows(b.transform(df).orderBy("id"), *b.values["vocabulary"]) == [(2, 0, 0, 0, 2), (0, 1, 0, 1, 1), (0, 0, 1, 0, 0)]


def test_feature_union(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, c string"), spark.createDataFrame([(1, 5)], "k int, n int")
    assert sorted(joins.feature_union([a, b], ["k"]).collect()) == [(1, "x", 5), (2, "y", None), (3, "z", None)]


def test_rolling(spark):
    day = lambda i: datetime.datetime(2018, 1, 1 + i)
    data = [(day(i), "XXX" if i < 4 else "ZZZ", v) for i, v in enumerate((1, 2, 3, 4, 4, 3, 2, 1))]
    df = spark.createDataFrame(data, "dt timestamp_ntz, sku string, vol bigint")
    want = {
        "mean": (2, 3, 3, 2), "median": (2, 3, 3, 2), "sum": (6, 9, 9, 6), "std": (1, 1, 1, 1), "max": (3, 4, 4, 3), "min": (1, 2, 2, 1), "kurtosis": (None,) * 4, "skewness": (0,) * 4,
        "quant_90": (2.8, 3.8, 3.8, 2.8), "quant_10": (1.2, 2.2, 2.2, 1.2), "trend": (1, 1, -1, -1), "longest_period_above_mean": (1,) * 4, "longest_period_below_mean": (1,) * 4,
        "longest_consecutive_decreases": (0, 0, 2, 2), "longest_consecutive_increases": (2, 2, 0, 0), "last_max": (1, 1, 3, 3), "last_min": (3, 3, 1, 1), "size": (3,) * 4,
    }
    got = timeseries.rolling(df, "vol", ["sku"], "dt", 3, list(want)).orderBy("dt").collect()
    for op, values in want.items():
        found = [r[f"vol_3_sku_{op}"] for r in got]
        assert [found[i] for i in (0, 1, 4, 5)] == [None] * 4, op
        assert all(a == b or abs(a - b) < 1e-9 for a, b in zip([found[i] for i in (2, 3, 6, 7)], values)), (op, found)
    assert timeseries.rolling(df.unionByName(df.limit(1)), "vol", ["sku"], "dt", 3, ["sum"]).count() == 9


def test_resample_fills_bins(spark):
    at = lambda m: datetime.datetime(2020, 1, 1, 0, m)
    df = spark.createDataFrame([(at(0), 1.0, "a"), (at(1), 3.0, None), (at(12), 5.0, "b")], "d timestamp_ntz, x double, id string")
    got = timeseries.resample(df, "d", "5 minutes", ["x"], ["id"]).orderBy("d").collect()
    assert [(r.x_mean, r.id) for r in got] == [(2.0, "a"), (None, None), (5.0, "b")]


def test_spans(spark):
    df = spark.createDataFrame([("ana banana", ["ana", "an", ""])], "text string, e array<string>")
    got = sorted((r.start, r.end) for r in spans.to_spans(df, "text", "e", "L").collect())
    assert got == [(0, 3), (5, 8), (7, 10)]
    s = spark.createDataFrame([("t", a, b, "x") for a, b in ((0, 3), (3, 5), (4, 6), (4, 9), (10, 12))], "text string, start int, end int, label string")
    assert sorted((r.start, r.end) for r in spans.non_overlapping(s, "text").collect()) == [(0, 3), (4, 6), (10, 12)]
    assert rows(spark.createDataFrame([("abcdef",)], "t string").select(spans.span_text(F.col("t"), F.lit(1), F.lit(3)).alias("x")), "x") == [("bc",)]


def test_extraction(spark):
    df = spark.createDataFrame([("Tensão + ação AÇÃO",), ("nada",)], "t string")
    got = df.select(text.extract_rules(F.col("t"), [text.literal("+"), r"aç\w+", r"(ten)s\w+"]).alias("e")).collect()
    assert sorted(got[0].e) == sorted(["+", "ação", "AÇÃO", "Tensão"]) and got[1].e == []
    with pytest.raises(Exception):
        text.extract_rules(F.col("t"), ["+"])


def test_extractors(spark):
    t = "atr 500 / 230 kv itumbiara ligado. se campos novos 2 com tensão 13,8 kv; uhe belo monte ii em operação; V (itaipu) ≤ 525 kV e diferença angular de no máximo 30 graus"
    got = spark.createDataFrame([(t,)], "t string").select(*(f(F.col("t")).alias(k.split(".")[0]) for k, f in text.EXTRACTORS.items())).first()
    assert "atr 500 / 230 kv itumbiara" in got.TR and "se campos novos 2" in got.SUBESTACAO and "uhe belo monte ii" in got.USINA
    assert {"ligado", "em operação"} <= set(got.ESTADO_OPERATIVO) and {"230 kv", "13,8 kv", "30 graus"} <= set(got.VALOR_COM_UNID)
    assert "V (itaipu) ≤ 525 kV" in got.INEQUACAO and "no máximo" in got.OPERADOR_MATEMATICO


def test_sentences(spark):
    t = "Dr. Silva chegou. A v. 3.5 custa. Ok? Não! J. R. Souza saiu (hoje) do site a.com agora. sem fim"
    got = spark.createDataFrame([(t,), ("",)], "t string").select(text.split_sentences(F.col("t")).alias("s")).collect()
    assert got[0].s[0] == "Dr. Silva chegou." and "Não!" in got[0].s and not any("sem fim" in s for s in got[0].s) and "Ok?" not in got[0].s[:0] and got[1].s == []


def test_churn_samples(spark):
    d = lambda m: datetime.date(2020, m, 1)
    data = [(1, d(m), 1.0, 1) for m in (1, 2, 3, 4, 5)] + [(2, d(m), 2.0, 1) for m in (1, 3)] + [(3, d(3), 5.0, 1), (3, d(4), 0.0, 1), (3, d(5), 1.0, 1)]
    panel = spark.createDataFrame(data, "c int, date date, q double, compras_mes long")
    got = {(r.c, r.date.month): (r.agg_l3m_q, r.target) for r in aggregate.churn_samples(panel, "c", ["q"], "2020-01-01", "2020-05-01").collect()}
    assert got == {(1, 3): (3.0, 0), (1, 4): (3.0, 0), (2, 3): (4.0, 1), (3, 3): (5.0, 0), (3, 4): (5.0, 0)}
    got = {(r.c, r.date.month): r.target for r in aggregate.churn_samples(panel, "c", ["q"], "2020-01-01", "2020-05-01", quantity="q").collect()}
    assert got[3, 3] == 1 and got[1, 3] == 0


def test_outliers_and_skew(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 0, 0, 0, 10, -10)], "x double")
    hi = [r.x for r in numeric.Outliers(cols=["x"], band=1.0).fit(df).transform(df).collect()]
    assert hi[4] == -hi[5] and abs(hi[4]) < 10
    up = [r.x for r in numeric.Outliers(cols=["x"], band=1.0, action="max").fit(df).transform(df).collect()]
    assert up[4] == up[5] > 0
    n = F.count("x")
    d = spark.createDataFrame([(float(x),) for x in (1, 2, 4, 8, 3)], "x double").agg(numeric.bias_free_skew(n, F.skewness("x")).alias("s"), numeric.bias_free_kurtosis(n, F.kurtosis("x")).alias("k")).first()
    assert abs(d.s - 1.3385) < 1e-4 and abs(d.k - 2.0210) < 1e-4


def test_joins_with_nulls(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string")
    b = spark.createDataFrame([(1, 5, "new"), (1, None, "none"), (1, 3, "old"), (None, 1, "z")], "k int, o int, w string")
    assert sorted(rows(joins.left_latest(a, b, ["k"], "o"), "v", "w")) == [("x", "new"), ("y", None)]
    assert sorted(rows(project.presence_flag(a, b, ["k"], "has"), "v", "has")) == [("x", 1), ("y", 0)]


def test_statistics(spark):
    df = spark.createDataFrame([(float(i % 7), float(i % 5), float(i % 7 + i % 5), 1.0, None if i == 0 else 1.0) for i in range(70)], "a double, b double, s double, k double, kn double")
    assert selection.constant_columns(df) == ["k"]
    r = selection.correlation_matrix(df, ["a", "b", "s"])
    assert all(math.isinf(x) for x in selection.vif(r))
    assert selection.remove_multicollinearity(r, ["a", "b", "s"]) == ["a", "b"]
    assert selection.duplicate_columns(df.withColumn("a2", F.col("a"))) == [("a", "a2")]


def test_drift_and_schema(spark):
    base = spark.createDataFrame([("x", "mean", 100.0), ("x", "std", 0.0), ("y", "mean", 100.0)], "feature string, property string, value double")
    cur = spark.createDataFrame([("x", "mean", 115.0), ("x", "std", 5.0), ("y", "mean", 116.0)], "feature string, property string, value double")
    assert rows(monitor.numeric_drift(base, cur), "feature", "property") == [("y", "mean")]
    a, b = spark.createDataFrame([(1, "a")], "p int, q string"), spark.createDataFrame([(1.0, "a", 2)], "p double, q string, r int")
    assert sorted(rows(monitor.compare_schema(monitor.schema_table(a), monitor.schema_table(b)), "feature", "type", "status")) == [("p", "float", "new"), ("p", "int", "missing"), ("r", "int", "new")]
    fa = spark.createDataFrame([("c", "u", 0.5), ("c", "v", 0.3), ("c", "w", 0.2)], "feature string, category string, share double")
    fb = spark.createDataFrame([("c", "u", 0.1), ("c", "v", 0.5), ("c", "z", 0.4)], "feature string, category string, share double")
    assert rows(monitor.frequency_drift(fa, fb), "category") == [("u",)] and rows(monitor.category_drift(fa, fb), "missing", "new") == [(["w"], ["z"])]


def test_best_and_gates(spark):
    m = spark.createDataFrame([("a", 0.8, 0.1), ("b", 0.7, 0.05), ("c", 0.9, 0.2)], "id string, f1 double, brier double")
    assert monitor.select_best(m, "id", {"f1": 2.0, "brier": 1.0}) == "c" and monitor.select_best(m, "id", {"brier": 1.0}) == "b"
    assert rows(metrics.quality_gate(spark.createDataFrame([(0.5, 0.85)], "f1 double, roc_auc double")), "passed") == [(True,)]


def test_score_metrics_against_pairs(spark):
    import random

    rng = random.Random(1)
    data = [(rng.randint(0, 1), rng.randint(0, 9) / 10) for _ in range(200)]
    got = metrics.score_metrics(spark.createDataFrame(data, "y int, s double"), "y", "s").first()
    p, q = [s for y, s in data if y], [s for y, s in data if not y]
    assert abs(got.roc_auc - sum((a > b) + 0.5 * (a == b) for a in p for b in q) / len(p) / len(q)) < 1e-12


def test_splits(spark):
    df = spark.range(103).withColumnRenamed("id", "k")
    assert [r.k for r in sets.position(df, ["k"]).orderBy("pos").collect()] == list(range(103))
    f = sets.time_folds(df, ["k"], 4).groupBy("block").count().orderBy("block").collect()
    assert [r["count"] for r in f] == [23, 20, 20, 20, 20]
    assert sets.sample_rows(df, ["k"], 10).count() == 10 and sets.same_rows(df, df.orderBy(F.desc("k")))


def test_models_on_separable_data(spark):
    df = spark.createDataFrame([(i, float(i % 100), float((i * 7) % 100), 1.0 if i % 100 > 50 else 0.0) for i in range(400)], "id int, a double, b double, y double")
    for kind in ("boosting", "forest", "logistic"):
        p = models.pipeline(kind, "classification", ["a", "b"], "y").fit(df).transform(df)
        assert p.where("prediction = y").count() >= 396
    placed, centroids, _ = models.k_prototypes(df.withColumn("a", F.when(F.col("a") > 50, 9.0).otherwise(0.0)).withColumn("c", F.lit("u")), ["a"], ["c"], 2)
    assert sorted(c["a"] for c in centroids) == [0.0, 9.0] and placed.select("cluster").distinct().count() == 2
    odd = df.select("id", "a", "b").unionByName(spark.createDataFrame([(999, 5000.0, -4000.0)], "id int, a double, b double"))
    assert models.isolation_forest(odd, "id", ["a", "b"], trees=25).orderBy(F.desc("anomaly_score")).first().id == 999
    assert abs(models.pca(df, ["a", "b"], 2).agg(F.max("cumulative")).first()[0] - 1) < 1e-9


def test_registry_keeps_history(spark, tmp_path):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    io.append_registry(a, str(tmp_path / "r"), ["k"])
    assert [r.k for r in io.append_registry(b, str(tmp_path / "r"), ["k"]).orderBy("k").collect()] == [1, 2, 3]
    assert io.versions(spark, str(tmp_path / "r")) == ["v00000001", "v00000002"] and io.latest(spark, str(tmp_path / "none")) is None


def test_streams(spark, tmp_path):
    from millrace.streaming import jobs

    at = lambda m: datetime.datetime(2020, 1, 1, 0, m)
    df = spark.createDataFrame([(at(m), float(m)) for m in range(30)], "d timestamp, x double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.probe_stream(stream(), str(tmp_path / "probe"), str(tmp_path / "c1"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "probe")).count() == 30
    base = aggregate.profile(df.withColumn("x", F.col("x") * 3), ["x"])
    jobs.drift_stream(stream(), base, ["x"], str(tmp_path / "drift"), str(tmp_path / "c2")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "drift")).count() > 0
    limits = monitor.control_limits(df.where("x < 20"), ["x"])
    jobs.control_stream(stream(), "d", ["x"], limits, str(tmp_path / "chart"), str(tmp_path / "c4")).awaitTermination(120)
    hi = limits.first().ucl
    assert {r.x for r in spark.read.parquet(str(tmp_path / "chart/points")).collect()} == {float(m) for m in range(30) if m >= hi}
    assert spark.read.parquet(str(tmp_path / "chart/summary")).first().feature == "x"
    q = jobs.resample_stream(stream(), "d", "5 minutes", ["x"], "1 minute").writeStream.format("memory").queryName("bins").outputMode("append").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.d.minute, r.x_mean) for r in spark.table("bins").collect()} <= {(m, m + 2.0) for m in range(0, 30, 5)}


def test_fragments(spark):
    cases = {
        "3.2.1.4 Objetivo5. a) ligar a chave": "ligar a chave", "2.1. texto": "texto", "tensão 13.8 kV": "tensão 13.8 kV", "módulo 5 e submodulo 10.2.": "e", "• um - dois": "um dois",
        "iniciar amanobra": "iniciar a manobra", "faz odesenergização": "faz o desenergização", "a desenergização": "a desenergização", "barra12": "barra 12", "12energização": "12 energização",
        "x&nbsp;y&#xa0;z": "x y z", "nomeOutro": "nome Outro", "passocoordenaçãocontrolecomando fim": "fim", "a | b": "a b", "fim -1abcd-xyz": "fim", "um. . .dois": "um.dois",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.c for r in df.select("t", text.clean_fragment(F.col("t"), apart=False).alias("c")).collect()}
    assert got == cases
    apart = {"tensão 13.8 kV": "tensão 13 . 8 kV", "fim.Abrir (a chave),já": "fim . Abrir ( a chave ), já", "LT-01/C+5 d'água": "LT-01/C+5 d'água", "x >= 5%": "x >= 5 %"}
    df = spark.createDataFrame([(k,) for k in apart], "t string")
    assert {r.t: r.c for r in df.select("t", text.clean_fragment(F.col("t")).alias("c")).collect()} == apart


def test_names_of_places(spark):
    """Every length of a name is found, runs inside runs too, numbers where they follow, and V with bare words in inequalities."""
    cases = [
        ("ligar a SE Norte Sul 2 agora", "SUBESTACAO", ["SE Norte", "SE Norte Sul", "SE Norte Sul 2"]),
        ("se norte, se a se b", "SUBESTACAO", ["se a", "se a se", "se a se b", "se b", "se norte"]),
        ("SE um dois três quatro 55x", "SUBESTACAO", ["SE um", "SE um dois", "SE um dois três", "SE um dois três quatro 55"]),
        ("nada", "SUBESTACAO", []), (None, "SUBESTACAO", None), ("se", "SUBESTACAO", []),
        ("Usina Serra Azul II parte, UHE Foz 3 kv", "USINA", ["UHE Foz", "UHE Foz 3 ", "Usina Serra", "Usina Serra Azul", "Usina Serra Azul II"]),
        ("PCH a b c iv", "USINA", ["PCH a", "PCH a b", "PCH a b c", "PCH a b c iv"]),
        ("usinas eólicas e UTE x 1 e 2", "USINA", ["UTE x", "UTE x 1 ", "UTE x 1 e 2", "usinas e", "usinas eólicas"]),
        ("com 500 kV ≤ V Norte Sul ok", "INEQUACAO", ["500 kV ≤ V Norte Sul ok"]), ("500 kV ≤ Vnorte", "INEQUACAO", ["500 kV ≤ Vnorte"]),
    ]
    for t, label, want in cases:
        got = spark.createDataFrame([(t,)], "t string").select(text.EXTRACTORS[label](F.col("t")).alias("e")).first().e
        assert got == want, (t, got)


def test_phrases_of_a_table(spark):
    docs = spark.createDataFrame([(1, "Abrir a chave, fechar a CHAVE e abrir."), (2, "chaveiro"), (3, None), (4, "a chave fechada")], "id int, t string")
    rules = spark.createDataFrame([("abrir a chave",), ("fechar",), ("chave",), ("a chave",), ("...",), (None,), ("chave",)], "r string")
    assert {r.id: r.entities for r in spans.match_rules(docs, "id", "t", rules, "r").collect()} == {1: ["a chave", "abrir a chave", "chave", "fechar"], 4: ["a chave", "chave"]}


def test_rules_with_two_consequents(spark):
    df = spark.createDataFrame([(["a", "b", "c"],)] * 6 + [(["a"],)] * 2 + [(["b", "c"],)] * 2, "items array<string>")
    got = {(tuple(r.antecedent), tuple(r.consequent)): r for r in spans.association_rules(df, "items", 0.2, 0.5, 0.5).collect()}
    r = got[("a",), ("b", "c")]
    assert abs(r.confidence - 6 / 8) < 1e-9 and abs(r.support - 0.6) < 1e-9 and abs(r.lift - 6 / 8 / 0.8) < 1e-9
    assert (("b", "c"), ("a",)) in got and len(got) == 12


def test_nearest_rows(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.integers(0, 3, (300, 4)).astype(float)  # many ties
    rows = [(i, [float(x) for x in v[i]] if i % 17 else None, None if i % 23 == 5 else i % 3) for i in range(300)]
    base = spark.createDataFrame(rows, "id long, v array<double>, label int").repartition(5)
    got = {(r.query, r["rank"]): r.neighbour for r in neighbours.knn(base.where("id % 50 = 1"), base, 4, "id", "v", "label").collect()}
    for q, qv, ql in rows:
        if q % 50 == 1 and qv is not None and ql is not None:
            near = sorted((float(np.linalg.norm(np.array(qv) - np.array(x))), i) for i, x, label in rows if x is not None and label is not None and label != ql)
            assert [got[q, k + 1] for k in range(4)] == [i for _, i in near[:4]]
    assert neighbours.knn(base.limit(0), base, 4, "id", "v").count() == 0 and neighbours.knn(base.where("id = 3"), base, 2, "id", "v").where("rank = 1").first().distance == 0


def test_encoders_with_many_values(spark, monkeypatch):
    df = spark.createDataFrame([(f"v{i % 300:03d}", float(i % 300)) for i in range(900)] + [(None, 1.0)], "c string, y double")
    coded = encode.LabelEncoder(cols=["c"]).fit(df).transform(df)
    assert coded.columns == ["c", "y"] and {(r.c, r.y) for r in coded.collect()} == {(i, float(i)) for i in range(300)} | {(300, 1.0)}
    assert {(r.c, r.y) for r in encode.TargetEncoder(cols=["c"], target="y").fit(df).transform(df).collect()} == {(float(i), float(i)) for i in range(300)} | {(None, 1.0)}
    monkeypatch.setattr(encode, "MOST_COLUMNS", 100)
    with pytest.raises(ValueError):
        encode.OneHot(cols=["c"]).fit(df)


def test_ragged_lines(spark, tmp_path):
    for name, lines in (("a", ["k;v", "1;x", "2"]), ("b", ["k;v", "3;y;z", "k;v", '4;"q'])):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    got = sorted((r.k, r.v or "") for r in io.read_lines_split(spark, str(tmp_path)).collect())
    assert got == [("1", "x"), ("2", ""), ("3", "y"), ("4", '"q'), ("k", "v")]
