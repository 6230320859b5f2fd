"""Repeated strings against a brute-force count of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from millrace.llm import suffix_dedup as S


def brute(texts, length=200):
    seen = Counter()
    raws = [(t or "").encode() for t in texts]
    for r in raws:
        seen.update(r[i : i + length] for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        mask = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                mask[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(int), [0]))) == 1)
        out.append((len(r), int(mask.sum()), len(edges), hashlib.sha256(bytes(b for b, m in zip(r, mask) if not m)).hexdigest()))
    return out


def make(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(n) for n in (60, 80, 120, 200)]
    texts = [None, "", "short", "a" * 700, "a" * 199, "a" * 200, "ab" * 300]
    for i in range(40):
        base = [prose(rng.randint(5, 80)) for _ in range(rng.randint(1, 3))]
        if i % 2:
            base.insert(rng.randrange(len(base) + 1), rng.choice(shared))
        if i % 3 == 0:
            s = rng.choice(shared)
            cut = rng.randrange(len(s))
            base.append(s[:cut] + "Z" + s[cut:])
        texts.append(" ".join(base))
    for i in range(10):
        t = rng.choice(texts[10:])
        k = rng.randrange(len(t))
        texts.append(t if i < 3 else t[:k] + "q" + t[k + 1 :])
    texts.append(texts[20] + texts[21] + texts[20])
    return texts


@pytest.mark.parametrize("seed,most", [(1, 4096), (2, 2), (3, 7)])
def test_against_all_windows(spark, monkeypatch, seed, most):
    monkeypatch.setattr(S, "MOST", most)
    texts = make(seed)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    got = {r.doc_id: r for r in S.suffix_dedup(docs, with_text=True).collect()}
    for i, want in enumerate(brute(texts)):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want, (i, texts[i])
        assert len(r.kept.encode()) - (r.n_bytes - r.n_removed) in range(0, 2 * r.n_spans + 1)


def test_interval_expansion_alone():
    rng = np.random.default_rng(4)
    for length in (8, 20, 50):
        parts = [rng.integers(97, 99, rng.integers(1, 90)).astype(np.uint8) for _ in range(30)]
        parts += [np.concatenate((parts[3], parts[5])), parts[7][5:], parts[7], np.full(80, 97, np.uint8)]
        off = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        seen = Counter(bytes(p[i : i + length]) for p in parts for i in range(len(p) - length + 1))
        want = [i + length <= len(p) and seen[bytes(p[i : i + length])] > 1 for p in parts for i in range(len(p))]
        assert S.shared_suffixes(np.concatenate(parts), off, length).tolist() == want


def test_odd_rows(spark):
    rows = [(None, "x" * 300), (1, "y" * 10), (1, "z " * 200), (1, "z " * 200), (None, None)]
    got = S.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.n_bytes, r.n_removed) for r in got.collect()) == [(0, 0), (10, 0), (300, 300), (400, 400), (400, 400)]
    assert S.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
