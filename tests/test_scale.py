"""Operators that must not depend on one task, one row or the driver: each against the plain way, with the sizes at which they part work made small."""

import datetime
import random
import time

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import encode, monitor, neighbours, prefix, quantiles, sets, spans, timeseries, vocabulary

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(0)
    rows = [(i, f"k{i % 50}", None if i % 7 == 0 else float(rng.choice([1, 1, 1, 2, 3, i, -i * 0.5, 1e300, -1e-300]))) for i in range(4000)]
    return spark.createDataFrame(rows, "i int, k string, x double").repartition(5).cache()


@pytest.mark.parametrize("few", [10_000, 30])
def test_quantiles(numbers, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    cols = {"x": F.col("x"), "i": F.col("i"), "same": F.col("x") * 0, "none": F.when(F.col("i") < 0, 1)}
    got, extra = quantiles.quantiles(numbers, cols, PROBS, {"n": F.count("x")})
    want = numbers.agg(*(F.percentile(c, F.lit(PROBS)) for c in cols.values())).first()
    for k, w in zip(("x", "i", "same"), want, strict=False):
        assert np.allclose(got[k], w, rtol=1e-12, atol=0), k
    assert got["none"] == [None] * len(PROBS) and extra["n"] == numbers.where("x is not null").count()


def test_quantiles_do_not_trust_the_sketch(numbers, monkeypatch):
    """Shares that lie far from the wanted rank cost rounds, not the result."""
    monkeypatch.setattr(quantiles, "FEW", 50)
    monkeypatch.setattr(quantiles, "_around", lambda a, b: [0.3, 0.4])
    assert quantiles.quantiles(numbers, {"i": F.col("i")}, [0.5, 0.9])[0]["i"] == pytest.approx([1999.5, 3599.1])


def test_quantiles_gather_little(numbers, monkeypatch):
    monkeypatch.setattr(quantiles, "FEW", 40)
    made, real = [], F.collect_list
    monkeypatch.setattr(quantiles.F, "collect_list", lambda c: (made.append(numbers.agg(F.count(c)).first()[0]), real(c))[1])
    quantiles.quantiles(numbers, {"i": F.col("i"), "x": F.col("x")}, [0.5, 0.75])
    assert made and max(made) <= 40


def test_grouped_quantile(numbers, ranges_apart):
    hot = numbers.withColumn("k", F.when(F.col("i") % 3 > 0, "hot").otherwise(F.col("k")))
    for p in (0.5, 0.9):
        got = {r.k: r.q for r in quantiles.grouped_quantile(hot, "k", "x", p, "q").collect()}
        assert got == pytest.approx({r.k: r.q for r in hot.groupBy("k").agg(F.percentile("x", F.lit(p)).alias("q")).collect()}, rel=1e-12)


@pytest.fixture
def ranges_apart(spark):
    """Small ranges stay apart, as large ones do."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def test_running_sums(spark, numbers, monkeypatch, ranges_apart):
    d = numbers.withColumn("x", F.round("x", 1) % 1000).withColumn("g", F.when(F.col("i") < 3000, "hot").when(F.col("i") < 3100, None).otherwise(F.col("k")))
    ranges = []
    monkeypatch.setattr(prefix, "cut", lambda df: (out := df.checkpoint(), ranges.append(out.where("g = 'hot'").select("_p").distinct().count()))[0])
    got = prefix.running(d, ["g"], ["i"], {"a": F.col("x"), "b": F.lit(1)})
    w = Window.partitionBy("g").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    near = lambda df: sorted((r.i, r.b, None if r.a is None else round(r.a, 3)) for r in df.collect())
    assert near(got) == near(d.withColumns({"a": F.sum("x").over(w), "b": F.sum(F.lit(1)).over(w)}))
    assert ranges[0] > 1 and set(got.columns) == {*d.columns, "a", "b"}
    monkeypatch.undo()
    whole = prefix.running(d.select("i", "x"), [], ["i"], {"b": F.lit(2)})
    assert sorted((r.i, r.b) for r in whole.collect()) == [(i, 2 * i + 2) for i in range(4000)]
    assert prefix.running(d.limit(0), ["g"], ["i"], {"a": F.col("x")}).count() == 0


def test_cumulative_ratio(numbers, ranges_apart):
    got = timeseries.cumulative_ratio(numbers.select("i", F.lit(1).alias("g")), F.col("i") % 4 == 0, ["g"], ["i"])
    assert {r.i: round(r.ratio, 9) for r in got.collect()} == {i: round((i // 4 + 1) / (i + 1), 9) for i in range(4000)}


def test_control_stream_runs_on(spark, tmp_path, ranges_apart):
    """Three files, one a batch: the shares are those of the whole series at once, also when a batch is done again."""
    from millrace.streaming import jobs

    at = lambda m: datetime.datetime(2020, 1, 1) + datetime.timedelta(minutes=m)
    rng = random.Random(1)
    df = spark.createDataFrame([(at(m), f"e{m % 2}", float(rng.choice([0, 0, 9])), None if m % 5 == 0 else 1.0) for m in range(60)], "d timestamp, g string, x double, y double")
    for i in range(3):
        df.where(F.minute("d").between(20 * i, 20 * i + 19)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are read in order of their times
    limits = spark.createDataFrame([(g, c, -1.0, 5.0) for g in ("e0", "e1") for c in ("x", "y")], "g string, feature string, lcl double, ucl double")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.control_stream(stream, "d", ["x", "y"], limits, str(tmp_path / "out"), str(tmp_path / "c"), ["g"]).awaitTermination(200)
    whole = monitor.control_chart(df, "d", ["x", "y"], ["g"], limits)
    want = sorted((r.g, r.feature, r.d, round(r.ratio, 9)) for r in whole.where("ooc = 1").collect())
    points = spark.read.parquet(str(tmp_path / "out/points"))
    assert points.select("batch").distinct().count() == 3 and sorted((r.g, r.feature, r.d, round(r.ratio, 9)) for r in points.collect()) == want
    last = spark.read.parquet(str(tmp_path / "out/summary/batch=2"))
    assert {(r.g, r.feature): r.status for r in last.collect()} == {(r.g, r.feature): r.status for r in monitor.ooc_summary(whole, "d", ["g"]).collect()}
    # The last batch fails before it is committed, and is done again.
    (tmp_path / "c/commits/2").unlink()
    (tmp_path / "c/commits/.2.crc").unlink(missing_ok=True)
    jobs.control_stream(stream, "d", ["x", "y"], limits, str(tmp_path / "out"), str(tmp_path / "c"), ["g"]).awaitTermination(200)
    assert sorted((r.g, r.feature, r.d, round(r.ratio, 9)) for r in spark.read.parquet(str(tmp_path / "out/points")).collect()) == want


@pytest.mark.parametrize("few,bits", [(10_000, 14), (20, 3)])
def test_exact_samples(numbers, monkeypatch, few, bits):
    monkeypatch.setattr(sets, "FEW", few)
    monkeypatch.setattr(sets, "_BITS", bits)
    order = [r.i for r in numbers.withColumn("_u", F.xxhash64("i", F.lit(3))).orderBy("_u", "i").collect()]
    for n in (0, 1, 77, 2500, 3999, 4000, 9000):
        assert sorted(r.i for r in sets.sample_rows(numbers, ["i"], n, 3).collect()) == sorted(order[:n])
    # Keys that many rows share: whole groups but for one, of which as many as are missing.
    some = {r.k: r["count"] for r in sets.sample_rows(numbers, ["k"], 1234, 3).groupBy("k").count().collect()}
    assert sum(some.values()) == 1234 and sum(v < 80 for v in some.values()) <= 1
    assert sets.sample_rows(numbers.select(F.lit(1).alias("k")), ["k"], 999).count() == 999
    assert sets.sample_rows(numbers.select(F.lit(None).cast("int").alias("k")), ["k"], 999).count() == 999


def test_samples_are_filters(numbers, capsys):
    sets.sample_rows(numbers, ["i"], 2500, 3).explain()
    plan = capsys.readouterr().out
    assert "TakeOrdered" not in plan and "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan


def test_compare_sets(spark):
    a, b = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "c")], "x int, y string"), spark.createDataFrame([(2, None), (4, "d")], "x int, y string")
    assert {tuple(r) for r in sets.compare_sets(a, b).collect()} == {(1, "a", "first"), (2, None, "both"), (3, "c", "first"), (4, "d", "second")}


@pytest.mark.parametrize("sizes", [(128, 2, 8192, 4096), (7, 1, 40, 3), (400, 3, 64, 16)])
def test_neighbours(spark, monkeypatch, sizes):
    for name, v in zip(("PIVOTS", "PROBES", "ROWS", "QUERIES"), sizes, strict=True):
        monkeypatch.setattr(neighbours, name, v)
    rng = np.random.default_rng(5)
    v = np.concatenate((rng.normal(0, 1, (150, 3)) + 10, rng.integers(0, 3, (150, 3))))
    v[200:260] = v[7]  # copies
    rows = [(i, [float(x) for x in v[i]] if i % 17 else None, None if i % 23 == 5 else f"l{i % 3}") for i in range(300)]
    base = spark.createDataFrame(rows, "id long, v array<double>, label string").repartition(5)
    got = {}
    for r in neighbours.knn(base.where("id % 10 = 1"), base, 4, "id", "v", "label").collect():
        got.setdefault(r.query, []).append((r["rank"], r.neighbour, round(r.distance, 9)))
    for q, qv, ql in rows:
        if q % 10 == 1:
            near = sorted((float(np.sqrt(((np.array(qv) - np.array(x)) ** 2).sum())), i) for i, x, lab in rows if x is not None and lab is not None and lab != ql) if qv is not None and ql is not None else []
            assert sorted(got.get(q, [])) == [(k + 1, i, round(d, 9)) for k, (d, i) in enumerate(near[:4])], q
    assert neighbours.knn(base.where("id = 21"), base.where("id < 3"), 5, "id", "v").count() == 2  # fewer rows than wanted
    assert neighbours.knn(base.limit(0), base, 2, "id", "v").count() == 0 and neighbours.knn(base, base.limit(0), 2, "id", "v").count() == 0


def test_encoders_with_any_number_of_values(spark, monkeypatch, tmp_path):
    n = 120_000
    df = spark.range(2 * n).select((F.col("id") % n).alias("c"), (F.col("id") % n).cast("double").alias("y"), F.when(F.col("id") % 9 > 0, F.concat(F.lit("v"), F.lpad((F.col("id") % 450).cast("string"), 3, "0"))).alias("s"))
    model = Pipeline(stages=[encode.LabelEncoder(cols=["c"]), encode.TargetEncoder(cols=["s"], target="y", how="median", unknown="median")]).fit(df)
    model.save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    texts = sorted(map(str, range(n)))
    for m in (model, again):
        got = m.transform(df.withColumn("k", F.col("c")))
        assert got.where("k in (7, 119999, 40000)").select("k", "c").distinct().count() == 3
        assert {(r.k, r.c) for r in got.where("k in (7, 119999, 40000)").collect()} == {(k, texts.index(str(k))) for k in (7, 119999, 40000)}
        new = m.transform(spark.createDataFrame([(n + 5, 0.0, "unseen"), (None, 0.0, None)], df.schema)).collect()
        assert [r.c for r in new] == [n, n] and new[0].s == new[1].s
    medians = {r.s: r.m for r in df.where("s is not null").groupBy("s").agg(F.percentile("y", F.lit(0.5)).alias("m")).collect()}
    assert len(medians) > encode.MOST_CASES
    coded = encode.TargetEncoder(cols=["s"], target="y", how="median").fit(df).transform(df.where("s is not null").withColumn("k", F.col("s"))).select("k", "s").distinct().collect()
    assert {r.k: r.s for r in coded} == medians


@pytest.mark.parametrize("drop_first", [False, True])
def test_sparse_one_hot(spark, monkeypatch, drop_first):
    df = spark.createDataFrame([(f"v{i % 300:03d}",) for i in range(600)] + [(None,)], "c string")
    model = encode.OneHot(cols=["c"], sparse=True, drop_first=drop_first).fit(df)
    more = df.unionByName(spark.createDataFrame([("new",)], "c string"))
    got = {r.k: r.c_ohe for r in model.transform(more.withColumn("k", F.coalesce("c", F.lit("nan_ohe")))).collect()}
    first = 1 if drop_first else 0
    assert len(got["new"]) == 301 - first and got["new"].numNonzeros() == 0
    assert all(list(got[f"v{i:03d}"].indices) == ([i - first] if i >= first else []) for i in range(300)) and list(got["nan_ohe"].indices) == [300 - first]
    wide = encode.OneHot(cols=["c"]).fit(df).transform(df)
    assert len(wide.columns) == 301 and wide.where("c_v007 = 1").count() == 2 and wide.where("c_nan_ohe = 1").count() == 1


def test_large_vocabulary(spark):
    rng = np.random.default_rng(0)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 60) % 30_000) for _ in range(400)] + ["", None, "W1 w1 x"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    kind = {"key": "id", "text": "text", "max_features": 262_144, "sparse": True}
    bag, tfidf = vocabulary.BagOfWords(**kind).fit(df), vocabulary.TfIdf(**kind).fit(df)
    words = bag.values["vocabulary"]
    assert len(words) > 2000 and words == sorted(words)
    counts, weights = ({r.id: (r.indices, r["values"]) for r in m.transform(df).collect()} for m in (bag, tfidf))
    from collections import Counter

    tokens = {i: Counter(w for w in (t or "").lower().split() if len(w) > 1) for i, t in enumerate(texts)}
    held = Counter(w for c in tokens.values() for w in c)
    for i, c in tokens.items():
        assert {words[a]: b for a, b in zip(*counts[i], strict=True)} == c
        w = {t: (1 + np.log(n)) * (np.log((1 + len(texts)) / (1 + held[t])) + 1) for t, n in c.items()}
        norm = np.sqrt(sum(x * x for x in w.values()))
        assert {words[a]: b for a, b in zip(*weights[i], strict=True)} == pytest.approx({t: x / norm for t, x in w.items()})


def test_spans_of_a_long_text(spark):
    text = "ação total é aa " * 150_000
    df = spark.createDataFrame([(text, [f"e{i}" for i in range(47)] + ["aa", "ação total", "ação"])], "text string, e array<string>")
    began = time.time()
    got = spans.to_spans(df, "text", "e", "L").groupBy("entity").agg(F.count("*").alias("n"), F.min("start").alias("a"), F.max("end").alias("b")).collect()
    assert {(r.entity, r.n, r.a, r.b) for r in got} == {("aa", 150_000, 13, len(text) - 1), ("ação total", 150_000, 0, len(text) - 6)}
    assert time.time() - began < 60


def test_category_changes(spark):
    base = spark.createDataFrame([("f", "a", 0.5), ("f", "b", 0.5), ("g", "x", 1.0), ("h", "z", 1.0)], "feature string, category string, share double")
    now = spark.createDataFrame([("f", "b", 0.5), ("f", "d", 0.2), ("f", "c", 0.3), ("g", "x", 1.0)], "feature string, category string, share double")
    assert {tuple(r) for r in monitor.category_changes(base, now).collect()} == {("f", "a", "missing"), ("f", "c", "new"), ("f", "d", "new"), ("h", "z", "missing")}
    assert {(r.feature, tuple(r.missing), tuple(r.new)) for r in monitor.category_drift(base, now).collect()} == {("f", ("a",), ("c", "d")), ("h", ("z",), ())}


def test_validation_suite_saves(spark, tmp_path):
    df = spark.createDataFrame([(float(i), f"c{i}", i % 2) for i in range(500)], "x double, c string, f int")
    model = monitor.ValidationSuite(numeric=["x"], categories=["c"], flags=["f"]).fit(df)
    model.write().save(str(tmp_path / "v"))
    again = monitor.ValidationModel.load(str(tmp_path / "v"))
    for m in (model, again):
        assert all(r.success for r in m.transform(df).collect())
        odd = m.transform(df.withColumn("c", F.when(F.col("x") < 3, "new").otherwise(F.col("c"))))
        assert {(r.check, r.observed) for r in odd.where("not success").collect()} == {("in_set", 3.0)}


def test_search_runs_side_by_side(spark):
    """The report is the sequential one's, trials overlap, and threads see the caller's properties."""
    import threading

    from pyspark.ml.evaluation import RegressionEvaluator

    from millrace.operators import models

    df = spark.createDataFrame([(float(i % 7), float(i % 5), float(i % 7 + 0.1 * (i % 5)), i % 2 == 0) for i in range(200)], "a double, b double, y double, v boolean").cache()
    folds = [(df.where("v"), df.where("not v")), (df.where("not v"), df.where("v"))]
    make = lambda **o: models.pipeline("forest", "regression", ["a", "b"], "y", seed=1, **o)
    trials, judge = [{"numTrees": n, "maxDepth": m} for n in (1, 3) for m in (1, 3)], RegressionEvaluator(labelCol="y")
    one, four = (models.search(df, make, trials, folds, judge, False, parallel=p).collect() for p in (1, 4))
    assert one == four and len(one) == 4
    together, seen = threading.Barrier(3, timeout=60), []
    spark.sparkContext.setLocalProperty("millrace.mark", "kept")

    def job():
        together.wait()  # passes only if three run at once
        seen.append((spark.sparkContext.getLocalProperty("millrace.mark"), spark.sparkContext.getLocalProperty("spark.scheduler.pool")))
        return spark.range(5).count()

    assert models.side_by_side(spark, [job] * 6, 3) == [5] * 6
    assert {m for m, _ in seen} == {"kept"} and {p for _, p in seen} == {"trial-0", "trial-1", "trial-2"}
    with pytest.raises(ZeroDivisionError):
        models.side_by_side(spark, [lambda: 1, lambda: 1 // 0], 2)


def test_permutation_importance(spark, monkeypatch):
    from millrace.operators import selection

    rng = np.random.default_rng(2)
    rows = [(i, float(rng.random()), float(rng.random()), float(rng.random())) for i in range(400)]
    df = spark.createDataFrame([(i, a, b, c, int(a > 0.5)) for i, a, b, c in rows], "id int, a double, b double, c double, y int")
    sorts, real = [], selection.position
    monkeypatch.setattr(selection, "position", lambda *x: (sorts.append(1), real(*x))[1])
    got = {r.feature: r for r in selection.importance(df, ["a", "b", "c"], "y", trees=10, repeats=2).collect()}
    assert len(sorts) == 1 and got["a"].permutation > 0.3 and all(abs(got[c].permutation) < 0.15 for c in ("b", "c", "_probe"))
    assert got["a"].importance > max(got[c].importance for c in ("b", "c", "_probe"))
    for n in (2, 3, 400, 10**10):
        a, b = selection._shift(n, 5)
        assert np.gcd(a, n) == 1 and a * (n - 1) + b < 1 << 63
