"""A text of some megabytes, between short ones, through every operator."""

import random

import pytest

from millrace.llm import queries as Q
from millrace.llm.bpe import bpe
from millrace.llm.decontamination import decontaminate
from millrace.llm.language_id import language_id
from millrace.llm.near_dedup import near_dedup
from millrace.llm.quality_classifier import quality_classifier
from millrace.llm.quality_rules import quality_rules
from millrace.llm.sharding import shard
from millrace.llm.suffix_dedup import suffix_dedup
from millrace.llm.token_counts import token_counts
from millrace.llm.toxicity import toxicity

ITEM = "Anna buys 12 kg of apples for 3 euros each while Peter sells 12 boxes to Anna who then pays him 40 euros before Peter leaves the market"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "te", "ru", "é"]) for _ in range(rng.randint(1, 5)))
    half = " ".join(word() for _ in range(200_000))
    passage = " ".join(word() for _ in range(80))
    long = half + " " + ITEM + "\n" + passage + " " + " ".join(word() for _ in range(200_000)) + " " + passage
    assert len(long.encode()) > 2_500_000
    rows = [(0, long, "aa"), (1, "short one", "bb"), (2, "x" * 1_500_000, "aa"), (3, half, "aa"), (4, "ruka mite lo " * 30, "bb")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").cache()


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_counts(docs):
    text = {r.doc_id: r.text for r in docs.collect()}
    rules, sizes, near = by_id(quality_rules(docs)), by_id(shard(docs, 3)), by_id(near_dedup(docs))
    for i, t in text.items():
        w = t.split()
        assert rules[i].n_words == len(w) and sizes[i].size == len(t.encode()) + 16
        assert near[i].n_shingles == max(1, len({tuple(w[k : k + 5]) for k in range(len(w) - 4)}))
    assert near[0].component_id == 0 and near[3].component_id == 3


def test_repeats(docs):
    got = by_id(suffix_dedup(docs))
    half = len(docs.where("doc_id = 3").first().text.encode())
    assert got[3].n_removed == half and got[0].n_removed >= half and got[2].n_removed == 1_500_000 and got[1].n_removed == 0


def test_tokens(docs):
    from tokenizers import Tokenizer

    path = Q.tokenizer_file("word_bpe_49k.json")
    lib, got, pieces = Tokenizer.from_file(path), by_id(bpe(docs, path)), by_id(token_counts(docs, Q.tokenizer_file("piece_bpe_32k.model")))
    for r in docs.where("doc_id <> 2").collect():
        assert got[r.doc_id].n_tokens == len(lib.encode(r.text, add_special_tokens=False).ids) and pieces[r.doc_id].n_words == len(r.text.split())
    assert got[2].n_tokens > 0


def test_passage_in_the_middle(spark, docs):
    bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate(docs, bench).collect()] == [(0, 7)]


def test_scores(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(5)], "doc_id long, quality int, toxic int")
    for df in (quality_classifier(docs, labels), toxicity(docs, labels), language_id(docs, steps=20)):
        rows = df.collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
