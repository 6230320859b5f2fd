"""Operators that need one pass over the text, against plain Python and the tokenizers library."""

import hashlib
import random
import re

import pytest

from millrace.llm import bpe as B
from millrace.llm import queries as Q
from millrace.llm.bpe import bpe
from millrace.llm.quality_rules import quality_rules
from millrace.llm.token_counts import build, token_counts

ODD = [None, "", " ", "\n\n\t", "one", "a b a b a b a b", "x y z\nx y z\n\nx y z\nq", "Ünï çødé words   ok", "#$%&|<>* !!", "lone\x85nel \x1c tab\x0bvt", "ΣΑΣ İstanbul ǅ", "é ́x", "<|endoftext|>a<|startoftext|> it's 12345 they'll", "日本語 テキスト 한국어", "aaaaaaaaaaaaa aaa aaaa", " ogham 🙂🙃 👩‍👩‍👧", "z" * 5000, "a b c d\n" * 40]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    some = ["".join(rng.choice("abcde'ß é\n\t 1.,<|>ΣİX中́ ") for _ in range(rng.randint(0, 200))) for _ in range(60)]
    texts = ODD + some + ODD[:6]
    return spark.createDataFrame([(i if i != 3 else None, t, "clash", 0) for i, t in enumerate(texts)], "doc_id long, text string, n_words string, kept int")


def test_quality_rules_counts(docs):
    got = {r.doc_id: r for r in quality_rules(docs).collect()}
    assert len(got) == docs.count()
    for row in docs.collect():
        text = row.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        at = {}
        for i in range(len(words) - 2):
            at.setdefault(tuple(words[i : i + 3]), []).append(i)
        marked = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
        r = got[row.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text))), text
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(marked)), text
        assert (r.n_lines, r.n_distinct_words) == (len(lines), len(set(words)))
        assert (r.n_alpha_words, r.n_plain_words) == (sum(bool(re.search(r"[A-Za-z]|[^\0-\x7f]", w)) for w in words), sum(bool(re.search(r"([A-Za-z0-9.?!:;,\"')]|[^\0-\x7f])\Z", w)) for w in words)), text
        assert r.base_failed == (len(words) < 50 or 100 * len(marked) > 50 * len(words))
        assert not (r.base_failed and r.kept) and 0 <= r.quality <= 1


def test_quality_rules_keep_clean(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    y = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").withColumnRenamed("quality", "label")
    rows = quality_rules(d).join(y, "doc_id").where("not base_failed").collect()
    good, bad = [r.kept for r in rows if r.label == 1], [r.kept for r in rows if r.label == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) < 0.5 * len(bad)
    assert quality_rules(d.limit(0)).count() == 0


def test_quality_rules_fit_by_single_documents(spark):
    """The model fitted on the table of patterns is that of an expectation-maximisation over single documents in plain Python, and so are the posteriors."""
    rows = quality_rules(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()
    names = [k for k in rows[0].asDict() if k.startswith("vote_")]
    votes = [[r[k] for k in names] for r in rows]
    share, right = 0.8, {k: [0.9, 0.5] for k in range(len(names))}

    def chance(v):
        good, bad = share, 1 - share
        for k, x in enumerate(v):
            if x >= 0:
                good *= right[k][0] if x else 1 - right[k][0]
                bad *= 1 - right[k][1] if x else right[k][1]
        return good / (good + bad)

    for _ in range(100):
        p = [chance(v) for v in votes]
        share = (sum(p) + 0.8) / (len(p) + 1)
        for k in right:
            on = [[(q, v[k]) for q, v in zip(p, votes) if v[k] >= 0], [(1 - q, v[k]) for q, v in zip(p, votes) if v[k] >= 0]]
            right[k] = [(sum(q for q, x in on[0] if x == 1) + 0.9) / (sum(q for q, _ in on[0]) + 1), (sum(q for q, x in on[1] if x == 0) + 0.5) / (sum(q for q, _ in on[1]) + 1)]
    assert all(abs(r.quality - chance(v)) < 1e-6 for r, v in zip(rows, votes))
    assert any(not r.kept and not r.base_failed for r in rows)


def test_bpe_matches_library(docs):
    from tokenizers import Tokenizer

    path = Q.tokenizer_file("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in bpe(docs, path, with_ids=True, with_text=True).collect()}
    assert len(got) == docs.count()
    for row in docs.collect():
        ids = lib.encode(row.text or "", add_special_tokens=False).ids
        r = got[row.doc_id]
        assert r.ids == ids, repr(row.text)
        assert r.decoded == lib.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


def test_bpe_whole_table(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(Q.tokenizer_file("word_bpe_49k.json"))
    text = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in Q.op7_bpe(spark, "/root/testdata/sf0.001").collect():
        ids = lib.encode(text[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_bpe_forgets_within_bounds(monkeypatch):
    t = B.load(Q.tokenizer_file("word_bpe_49k.json"))
    words = [f"word{i}".encode() for i in range(50)]
    want = B.Encoder(t)(words)
    monkeypatch.setattr(B, "REMEMBERED", 7)
    e = B.Encoder(t)
    assert [e([w])[0] for w in words] == want


def brute_pieces(word, first, rest):
    n, at, pool = 0, 0, first
    while at < len(word):
        for to in range(len(word), at, -1):
            if word[at:to] in pool:
                break
        else:
            return None
        n, at, pool = n + 1, to, rest
    return n


def test_token_counts(spark, docs):
    vocabulary = ([x.encode() for x in "a ab abc on one x é z zz zzzz # w wor <|".split()], [x.encode() for x in "a b c bab d de e ne zz z zzzzz é ß ords s |endof".split()])
    got = {r.doc_id: r for r in token_counts(docs, vocabulary).collect()}
    assert len(got) == docs.count()
    for row in docs.collect():
        words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", row.text or "")]
        n = [brute_pieces(w, *map(set, vocabulary)) for w in words]
        r = got[row.doc_id]
        assert (r.n_words, r.n_unknown) == (len(words), n.count(None))
        assert r.n_tokens == sum(x or 1 for x in n) and r.longest == max([x or 1 for x in n], default=0)
    assert token_counts(docs.limit(0), vocabulary).count() == 0


def test_token_counts_match_library(spark):
    from tokenizers.models import WordPiece

    from millrace.llm.token_counts import read_vocabulary

    first, rest = read_vocabulary(Q.tokenizer_file("piece_bpe_32k.model"))
    vocab = {x: i for i, x in enumerate(dict.fromkeys(["[UNK]", *(p.decode() for p in first), *("##" + p.decode() for p in rest)]))}
    model = WordPiece(vocab, unk_token="[UNK]", continuing_subword_prefix="##", max_input_chars_per_word=10**6)
    got = {r.doc_id: r.n_tokens for r in Q.op9_token_counts(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        assert got[r.doc_id] == sum(len(model.tokenize(w)) for w in re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))


def test_token_counts_in_full(spark):
    import sentencepiece

    path = Q.tokenizer_file("piece_bpe_32k.model")
    p = sentencepiece.SentencePieceProcessor(model_file=path)
    pool = {p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_byte(i) or p.is_unknown(i) or p.is_unused(i))}

    def greedy(word):
        n, at, word = 0, 0, "▁" + word
        while at < len(word):
            to = next((to for to in range(min(len(word), at + 64), at, -1) if word[at:to] in pool), None)
            n, at = (n + 1, to) if to else (n + len(word[at].encode()), at + 1)
        return n

    assert max(map(len, pool)) <= 64 and greedy("2023") == 5
    texts = ["2023", "12:30 on 1.5.2024", "ñandú ça ßen", "日本語テキスト 中文段落沒有空格", "one🙂🙃two ሀለሐ 🙂", "7" * 3000, "plain words", "", None]
    rows = list(enumerate(texts)) + [(r.doc_id + 100, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    got = {r.doc_id: r for r in token_counts(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()}
    for i, text in rows:
        n = [greedy(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        assert (got[i].n_pieces, got[i].longest_pieces) == (sum(n), max(n, default=0)), repr(text)[:80]


def test_automaton_is_linear_on_long_words():
    a = build([b"a"], [b"a" * 50, b"a"])
    assert (a.popped >= 0).all() and a.link[0] == -1
