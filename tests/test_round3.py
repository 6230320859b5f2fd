"""Steps that must keep to bounds as tables grow, each with a case that its earlier form failed."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import aggregate as A
from millrace.operators import models as M
from millrace.operators import prefix
from millrace.operators import spans as S
from millrace.operators import vocabulary as V
from millrace.plans import pipelines as P
from millrace.plans.text import _instructions
from millrace.sources import io as IO


def test_sentences_are_dealt_to_all_cores(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("o_orderkey")).coalesce(1).write.parquet(str(tmp_path / "orders"))
    made = _instructions(lambda name: spark.read.parquet(str(tmp_path / name)))
    assert made.select(F.spark_partition_id().alias("p")).distinct().count() >= 4


def test_screened_rules_find_what_plain_ones_do(spark):
    texts = ["deſligado, İnferior ou igual a 3 Kv", "DESLIGADAS e em Operação", "ınferior a 5 kV", "nada", "", None, "Fluxo nulo no transformador SE Serra 138", "usina eólica; UHE/PCH"]
    d = spark.createDataFrame([(x,) for x in texts], "text string")
    for rules in (T.STATE_RULES, T.MATH_RULES, T.VALUE_RULES, T.LINE_RULES, T.PLANT_RULES):
        plain = F.array_sort(F.array_distinct(F.filter(F.flatten(F.array(*(F.regexp_extract_all("text", F.lit("(?iU)" + r), 0) for r in rules))), lambda m: m != "")))
        assert d.where(~F.equal_null(T.extract_rules(F.col("text"), rules), plain)).count() == 0


def test_what_a_rule_needs_stands_in_its_matches():
    assert T.needed(r"\bligad[oa]s?\b") == ("ligad",)
    assert T.needed("[0-9]+") == () and T.needed(r"\p{L}abc") == ()
    for rule, match in ((r"em opera[cç][aã]o", "em operação"), (T.VALUE_RULES[0], "13 kv"), (T.PLANT_RULES[1], "uhes x 2 e 3")):
        assert re.fullmatch(rule, match) and any(x in match for x in T.needed(rule))


def test_labels_found_are_those_of_extract_all(spark):
    d = spark.createDataFrame([("UHE Serra Azul em operação",), ("LT 500 kV Norte / Sul",), ("nada",)], "text string")
    found = {r.text: set(r.labels) for r in S.labels_found(d, "text").collect()}
    rows = S.extract_all(d, "text").groupBy("text").agg(F.collect_set("label").alias("labels")).collect()
    assert found == {"nada": set()} | {r.text: set(r.labels) for r in rows}


def test_annotation_documents_lie_in_few_files(spark, tmp_path):
    d = spark.range(2500).selectExpr("concat('t', id) as source", "array(named_struct('answerContent', named_struct('x', named_struct('entities', array(named_struct('startOffset', 0, 'endOffset', 2, 'label', 'N')))))) as answers")
    IO.write_documents(d, str(tmp_path / "a"), "source")
    assert len(list((tmp_path / "a").glob("part-*"))) == 3
    got = IO.read_annotations(spark, str(tmp_path / "a"))
    assert got.count() == 2500 and {tuple(r) for r in got.select("start", "end", "label").distinct().collect()} == {(0, 2, "N")}


def test_terms_are_cut_by_bytes(monkeypatch):
    monkeypatch.setattr(V, "_CHUNK_BYTES", 100)
    b = pa.RecordBatch.from_arrays([pa.array(["ab cd " * 5, None, "x" * 500, "ab"] * 50)], ["text"])
    got = list(V._counted(iter([b])))
    assert len(got) > 50 and sum(dict(zip(r.column(0).to_pylist(), r.column(1).to_pylist())).get("ab", 0) for r in got) == 300


def test_models_fit_parts_of_bounded_size(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(M, "parts", lambda d: 9)
    monkeypatch.setattr(M.Pipeline, "_fit", lambda self, d: seen.append(d.rdd.getNumPartitions()))
    d = spark.range(100).selectExpr("cast(id as double) as x", "cast(id % 2 as double) as y").coalesce(1)
    M.pipeline("boosting", "classification", ["x"], "y").fit(d)
    M.one_vs_rest(["x"], "y").fit(d)
    assert seen == [9, 9]


def test_recency_without_rows_outside_the_masks(spark):
    d = spark.createDataFrame([(1, 5), (1, 1), (2, 1)], "k int, v int")
    got = A.recency_features(d, "k", {"n": ("count", F.col("v") > 3, F.col("v"))}, every=False)
    assert [tuple(r) for r in got.collect()] == [(1, 1)]


def test_monitoring_cycle_sums_the_panel_up_once(spark, monkeypatch):
    cuts, cut = [], P.cut
    monkeypatch.setattr(P, "cut", lambda d: cuts.append(d.columns) or cut(d))
    P.queries()["pl13_monitoring_cycle"](spark, "/root/testdata/sf0.001")
    assert ["qtd", "val"] in cuts


def test_running_sums_deal_ranges_by_rows(spark, monkeypatch):
    seen, cut = [], prefix.cut
    monkeypatch.setattr(prefix, "parts", lambda d: 7)
    monkeypatch.setattr(prefix, "cut", lambda d: seen.append(d.select("_p").distinct().count()) or cut(d))
    d = prefix.running(spark.range(1000).withColumn("s", F.lit(1)), ["s"], ["id"], {"n": F.lit(1)})
    assert seen == [7] and d.agg(F.max("n")).first()[0] == 1000
