"""Operators on groups of documents, against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from millrace.llm import graph, near_dedup as near
from millrace.llm.graph import components
from millrace.llm.near_dedup import near_dedup
from millrace.llm.sharding import shard


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute(rows, k):
    sets = {i: shingles(t, k) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_texts(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop")
    texts = [None, "", "  \n", "one", "One", "one two", "ONE  two", "one two three"]
    for _ in range(25):
        base = [word() for _ in range(rng.randint(3, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            new = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 15))):
                new[rng.randrange(len(new))] = word()
            texts.append((" " if rng.random() < 0.5 else "\n").join(new))
            base = new if rng.random() < 0.5 else base
    return texts


@pytest.mark.parametrize("seed,k", [(1, 2), (2, 2), (3, 5)])
def test_near_dedup(spark, seed, k):
    rows = list(enumerate(near_texts(seed)))
    random.Random(seed).shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    got = {r.doc_id: r for r in near_dedup(docs, shingle=k).collect()}
    for i, (n, c) in brute(rows, k).items():
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, c, c == i)


@pytest.mark.parametrize("members,shingles_,words", [(3, 1 << 20, 60), (256, 200, 60), (256, 60_000, 25_000)])
def test_blocks_of_a_family(spark, monkeypatch, members, shingles_, words):
    """An open bucket of chained texts that no star has settled, over many blocks: by count, by size of the sets, and with long texts."""
    monkeypatch.setattr(near, "BLOCK", members)
    monkeypatch.setattr(near, "BLOCK_SHINGLES", shingles_)
    rng = random.Random(words)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(4))
    base, texts = [word() for _ in range(words)], []
    for _ in range(4 if words > 1000 else 14):
        for _ in range(2):
            text = list(base)
            for _ in range(max(1, words // 30)):
                text[rng.randrange(words)] = word()
            texts.append(" ".join(text))
        if rng.random() < 0.6:
            base = text
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").cache()
    signed = docs.mapInArrow(near._sign(2), "rep long, n_shingles long, print binary, bands array<long>, signed binary").select("rep", "n_shingles", "signed")
    ids = docs.selectExpr("doc_id AS rep")
    member = ids.selectExpr("rep", "7L AS bucket", f"{len(texts)}L AS size")
    want = {i: c for i, (_, c) in brute(list(enumerate(texts)), 2).items()}
    # The first half has been linked already.
    home = {i: want[i] if i < len(texts) // 2 else i for i in want}
    found = near.rest(docs, signed, member, spark.createDataFrame(list(home.items()), "rep long, component long"), 2, 80)
    got = {r.id: r.component for r in components(found).collect()}
    assert {i: got.get(c, c) for i, c in home.items()} == want and len(set(want.values())) < len(set(home.values()))


def test_near_dedup_odd_rows(spark):
    rows = [(None, "a b c"), (None, None), (5, "a b c"), (5, "a b c"), (2, "A b\tc")]
    got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (-1, -1, True), (2, 2, True), (5, 2, False), (5, 2, False)]
    assert near_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("few", [0, 500_000])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    assert set(got) == set(near)
    for a in near:
        seen, todo = {a}, [a]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert got[a] == min(seen)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("n,shards,hot", [(0, 4, 0), (3, 5, 0), (397, 7, 0), (400, 8, 130), (300, 4, 300)])
def test_sharding(spark, n, shards, hot):
    rng = random.Random(n)
    texts = [("hot" if i < hot else rng.choice([None, "", "é" * 3, f"t{rng.randrange(60)}", f"u{i}"])) for i in range(n)]
    docs = spark.createDataFrame([(i if i != 2 else None, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, shard int")
    got = shard(docs, shards).collect()
    assert len(got) == n
    counts = Counter(r.shard for r in got)
    assert all(0 <= s < shards for s in counts)
    assert max(counts.values(), default=0) - min((counts.get(s, 0) for s in range(shards)), default=0) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    groups = defaultdict(Counter)
    for r in got:
        t = texts[2 if r.doc_id is None else r.doc_id] or ""
        assert (r.size, r.text_crc32) == (len(t.encode()) + 16, zlib.crc32(t.encode()))
        assert (r.law, r.grown_shard) == ("rows", None)
        groups[t][r.shard] += 1
    quota = n // shards
    split = sum(sum(c.values()) - max(c.values()) for t, c in groups.items() if sum(c.values()) <= quota // 2)
    assert split <= 0.05 * n
    for c in groups.values():
        if sum(c.values()) > 2 * quota > 0:
            assert max(c.values()) >= 0.6 * quota
