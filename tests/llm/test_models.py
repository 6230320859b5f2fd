"""Learned operators: held-out accuracy on the given tables, and odd rows."""

import zlib

import numpy as np
import pytest

from millrace.llm import language_id as LI
from millrace.llm import queries as Q
from millrace.llm.language_id import language_id
from millrace.llm.quality_classifier import quality_classifier
from millrace.llm.toxicity import toxicity

SF = "/root/testdata/sf0.01"
ODD = [(1, None, "en"), (2, "", "en"), (3, "12 34 !!", "de"), (3, "12 34 !!", "de"), (None, "some words here", None), (5, "x" * 3000, "fr")]
SCHEMA = "doc_id long, text string, lang string, score string"


def held(i, folds, fold):
    return zlib.crc32(str(i).encode()) % folds == fold


def accuracy(spark, rows, label):
    want = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    hits = [r.predicted == want[r.doc_id] for r in rows if r.held_out and r.doc_id in want]
    return np.mean(hits)


def test_quality_classifier(spark):
    rows = Q.op3_quality_classifier(spark, SF).collect()
    assert all(r.held_out == held(r.doc_id, 5, 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert accuracy(spark, rows, "quality") > 0.95


def test_toxicity(spark):
    """Held-out figures over all labelled toxic texts; calling nothing toxic would have AUC 0.5 and recall 0."""
    sf = "/root/testdata/sf0.1"
    rows = Q.op8_toxicity(spark, sf).collect()
    assert all(r.held_out == held(r.doc_id, 4, 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    want = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null").collect()}
    known = [(r.score, r.predicted, want[r.doc_id]) for r in rows if r.held_out and r.doc_id in want]
    bad, good = ([x[0] for x in known if x[2] == k] for k in (1, 0))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in bad for b in good])
    recall = np.mean([x[1] for x in known if x[2] == 1])
    precision = np.mean([x[2] for x in known if x[1]])
    print(f"toxicity at sf0.1, held out: AUC {auc:.3f}, recall {recall:.3f} of {len(bad)}, precision {precision:.3f}")
    assert auc > 0.9 and recall > 0.7 and precision > 0.7


def test_toxicity_by_trained_dictionaries(spark):
    """Words that recur in toxic texts only are found by the bytes that the trained dictionary saves; the same text without them saves nothing like it."""
    from millrace.llm import toxicity as T

    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(["an", "er", "the", "ing", "tio", "en", "re", "st"], 3))
    plain = [" ".join(word() for _ in range(60)) for _ in range(300)]
    rows = [(t if i % 10 else t.replace(t.split(" ")[30], "blockheaded"), int(i % 10 == 0)) for i, t in enumerate(plain)]
    toxic, ordinary = map(T.compressor, T.dictionaries(spark.createDataFrame(rows, "text string, label int")))
    clean, dirty = (T.measure(toxic, ordinary, [t]) for t in (plain[1], plain[1].replace(plain[1].split(" ")[10], "blockheaded")))
    assert dirty[0, 0] >= clean[0, 0] + 4
    assert not T.measure(toxic, ordinary, [None, ""]).any()


def test_language_id(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = Q.op6_language_id(spark, SF).collect()
    assert all(r.held_out == held(r.doc_id, 4, 2) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([lang[r.doc_id] == r.lang_pred for r in rows if r.held_out]) > 0.98


def test_unequal_languages(spark):
    """Twelve languages, of which the smallest has 12 documents and the largest 600: none is lost to the others' more frequent words."""
    rng = np.random.default_rng(4)
    rows, i = [], 0
    for k in range(12):
        letters = list("abcdefghijklmnopqrstuvwxyzäöüßéèñçœøåłžš")
        rng.shuffle(letters)
        syllables = ["".join(letters[j : j + 2 + (j % 2)]) for j in range(0, 24, 2)]
        for _ in range(12 + 53 * k):
            rows.append((i, " ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(15)), f"l{k:02d}"))
            i += 1
    got = language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), steps=600).collect()
    lang = {r[0]: r[2] for r in rows}
    hits = {}
    for r in got:
        if r.held_out:
            hits.setdefault(lang[r.doc_id], []).append(r.lang_pred == lang[r.doc_id])
    assert len(hits) == 12 and np.mean([np.mean(h) for h in hits.values()]) > 0.9 and min(np.mean(h) for h in hits.values()) > 0.5, {k: np.mean(h) for k, h in hits.items()}


def test_draws(spark):
    """Languages are drawn alike often, pieces by the root of their counts, and rare pieces now and then."""
    rows = [("a", f"p{i}".encode(), 1 + i % 9) for i in range(3000)] + [("b", b"x", 4), ("b", b"y", 1)]
    got = LI.drawn(spark.createDataFrame(rows, "lang string, piece binary, n long"), 2000).collect()
    n = {k: sum(r.n for r in got if r.lang == k) for k in "ab"}
    assert n["b"] in (999, 1000, 1001) and abs(n["a"] - 1000) < 120 and len(got) < 1300
    assert abs(sum(r.n for r in got if bytes(r.piece) == b"x") - 2 * sum(r.n for r in got if bytes(r.piece) == b"y")) <= 3


def test_odd_rows(spark):
    odd = spark.createDataFrame([(*r, "clash") for r in ODD], SCHEMA)
    labels = spark.createDataFrame([(2, 1, 0), (3, 0, 1), (None, 1, 1), (5, None, None), (6, 1, 0)], "doc_id long, quality int, toxic int")
    for df in (quality_classifier(odd, labels), toxicity(odd, labels)):
        rows = df.collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    got = language_id(odd, sample=10, steps=3).collect()
    assert sorted((r.doc_id or -1, r.lang_pred == "und") for r in got)[1:5] == [(1, True), (2, True), (3, True), (3, True)]
    empty = spark.createDataFrame([], SCHEMA)
    assert quality_classifier(empty, labels).count() == toxicity(empty, labels.limit(0)).count() == language_id(empty).count() == 0


def test_network_learns_words():
    """Words of two languages that share bytes are told apart at every length."""
    words, y = [b"ab", b"abcde", b"zz"], np.array([0, 1, 1])
    net = LI.train(words, y, np.ones(3), ["p", "q"], steps=400, batch=64, rate=0.02)
    raw = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    p = LI.read_words(net, raw, end - [len(w) for w in words], end)
    assert (p.argmax(1) == y).all() and np.allclose(p.sum(1), [2, 5, 2], atol=1e-3)


def test_pieces_of_long_words():
    """Pieces cover each word, are short and never cut a character."""
    import pyarrow as pa

    from millrace.llm import common as C

    texts = ["kurz " + "ß" * 100 + " ein", "日本語" * 40, "a" * 24 + " " + "b" * 25, "", None, "🙂" * 30 + "x"]
    raw, off = C.flat(pa.array(texts, pa.string()))
    start, end, row = LI.spans_of(raw, off)
    data = raw.tobytes()
    for i, t in enumerate(texts):
        own = [data[a:b] for a, b, r in zip(start, end, row) if r == i]
        assert "".join(p.decode() for p in own) == "".join((t or "").split()) and all(0 < len(p) <= LI.SPAN for p in own)


@pytest.mark.parametrize("t", [1, 3])
def test_words_are_read_alike_in_any_company(t):
    net = LI.train([b"abc", b"xyz"], np.array([0, 1]), np.ones(2), ["p", "q"], steps=t)
    raw = np.frombuffer(b"abcxyzabc", np.uint8)
    a = LI.read_words(net, raw, np.array([0, 3, 6]), np.array([3, 6, 9]))
    assert np.allclose(a[0], a[2]) and np.allclose(a[1], LI.read_words(net, raw, np.array([3]), np.array([6]))[0], atol=1e-6)
