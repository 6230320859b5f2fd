"""Each stage of the pipeline against its own rule, on the smallest table with planted rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from millrace.llm.near_dedup import near_dedup
from test_groups import brute as near_brute
from test_suffix_dedup import brute as span_brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def test_stages_keep_columns(spark, docs):
    at = docs
    for name, stage in P.STAGES[:-1]:
        before, at = at, P.C.written(stage(spark, at, SF), "test-stage")
        assert at.columns == docs.columns, name
        assert 0.5 * before.count() <= at.count() <= before.count()
    last = P.STAGES[-1][1](spark, at, SF)
    assert last.count() == at.count() and "ids_sha256" in last.columns


def test_near_duplicates(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {i for i, (_, c) in near_brute(rows, 5).items() if i == c}
    assert {r.doc_id for r in P.near_duplicates(spark, docs, SF).collect()} == want
    assert near_dedup(docs).where("kept").count() == len(want)


def test_repeated_passages(spark, docs):
    rows = docs.orderBy("doc_id").collect()
    want = {r.doc_id: b for r, b in zip(rows, span_brute([r.text for r in rows]))}
    got = {r.doc_id: r for r in P.repeated_passages(spark, docs, SF).collect()}
    for i, (n, removed, spans, _) in want.items():
        if n > removed + 1:
            assert 0 <= len(got[i].text.encode()) - (n - removed) <= 2 * spans * 3
            assert got[i].n_chars == len(got[i].text)


def test_emptied_documents_go_and_blank_ones_stay(spark):
    passage = " ".join(f"w{i * i}" for i in range(90))
    texts = [("a", passage, 1), ("b", passage, 1), ("c", passage + "\n \t", 1), ("d", passage + " and something else", 1), ("e", "   ", 3), ("f", "", None), ("g", "", 0), ("h", None, None), ("i", "\n", 1)]
    docs = spark.createDataFrame([(i, t, "en", s, n) for i, (s, t, n) in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.source: r for r in P.repeated_passages(spark, docs, SF).collect()}
    assert set("efghi") <= set(got) and [got[k].text for k in "efghi"] == ["   ", "", "", None, "\n"]
    cut = [got[k].text for k in "abcd" if k in got]
    assert all(t.strip() for t in cut) and len(cut) < 4 and sum(passage in t for t in cut) <= 1


def test_odd_rows_pass_every_stage(spark, docs):
    """Repeated rows become one, null ids, null and empty texts pass, a clashing column is carried along, an empty table gives an empty result."""
    text = " ".join(f"solo{i} w{i * 7 % 13}" for i in range(60))
    odd = [(10**9, text, 0), (10**9, text, 1), (10**9 + 1, None, 2), (10**9 + 2, "", 3), (None, None, 4), (None, "", 5)]
    extra = spark.createDataFrame([(i, t, "en", str(k), None) for i, t, k in odd], "doc_id long, text string, lang string, source string, n_chars long")
    at = docs.unionByName(extra).withColumn("kept", F.lit("clash"))
    for name, stage in P.STAGES[1:-1]:
        at = P.C.written(stage(spark, at, SF), "test-stage")
        assert at.columns == [*docs.columns, "kept"] and at.where("kept <> 'clash'").isEmpty(), name
    rows = at.where("doc_id >= 1000000000 or doc_id is null").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in rows) == [(0, ""), (0, ""), (10**9, text), (10**9 + 1, ""), (10**9 + 2, "")]
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), SF).isEmpty()


def test_leaks(spark, docs):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    planted = docs.limit(3).withColumns({"doc_id": F.col("doc_id") + 10**9, "text": F.concat("text", F.lit(" " + item + " "), "text")})
    kept = {r.doc_id for r in P.leaks(spark, docs.unionByName(planted), SF).collect()}
    assert not any(i >= 10**9 for i in kept) and len(kept) > 0.9 * docs.count()


def test_quality_drops_rejected(spark, docs):
    kept = {r.doc_id for r in P.quality(spark, docs, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean, bad = [i in kept for i, q in labels.items() if q == 1], [i in kept for i, q in labels.items() if q == 0]
    assert sum(clean) >= 0.95 * len(clean) and sum(bad) <= 0.5 * len(bad)
