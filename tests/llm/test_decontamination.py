"""Benchmark passages as they are, with other values, and inconsistently changed."""

import random

from pyspark.sql import functions as F

from millrace.llm import decontamination as D
from millrace.llm.decontamination import decontaminate

WORDS = "river stone under carry yellow seldom copper window gather follow narrow garden silver listen market pencil thunder basket candle".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(n))


ITEM = "Anna buys 12 kg of apples for 3 euros each while Peter sells 12 boxes to Anna who then pays him 40 euros before Peter leaves the market"


def test_template_matches(spark):
    rng = random.Random(3)
    other = prose(rng, 30)
    changed = ITEM.replace("Anna", "Maria").replace("Peter", "Hans").replace("12", "75").replace("kg", "lb").replace("40", "9.5")
    mixed = ITEM.replace("Anna", "Maria", 1).replace("Peter", "Hans", 1).replace("12", "75", 1)
    texts = [ITEM, prose(rng, 40) + " " + changed + "! " + prose(rng, 40), prose(rng, 10) + "\n" + ITEM.upper().lower() + ".", mixed, prose(rng, 80), None, "", "one two", prose(rng, 500) + " " + other + " " + prose(rng, 900), "Anna buys 12 kg of apples"]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(1, texts[1], 5), (None, ITEM, 1)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(7, ITEM, 1), (8, other, 2), (8, other, 2), (9, None, 3), (10, "", 3), (11, "too few words", 1), (None, ITEM, 1)], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): r for r in decontaminate(docs, bench).collect()}
    assert {(0, 7), (1, 7), (8, 8)} <= set(got) and {d for d, _ in got} <= {0, 1, 2, 8}
    assert got[0, 7].verbatim and not got[1, 7].verbatim and got[1, 7].consistency == 1.0
    assert got[8, 8].n_windows == got[8, 8].item_windows


def test_empty(spark):
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    assert decontaminate(docs, bench.limit(0)).count() == 0
    assert decontaminate(docs.limit(0), bench).count() == 0
    assert decontaminate(docs, bench).count() == 1


def found(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontaminate(docs, bench).collect()}


def test_template_that_stands_twice(spark):
    rng = random.Random(4)
    item = "Anna has 3 red apples and Peter has 5 red apples in the same basket today"
    twice = item.replace("3", "8").replace("Peter has 5", "Anna has 8")
    got = found(spark, [item, prose(rng, 30) + " " + item + " " + prose(rng, 30), item.replace("Anna", "Maria").replace("5", "9"), twice + " " + item, item + " " + twice], [item])
    assert {d for d, _ in got} == {0, 1, 2, 3, 4}
    assert all(r.consistency == 1.0 and r.verbatim == (d != 2) for (d, _), r in got.items())


def test_second_stretch_is_tried(spark):
    rng = random.Random(5)
    mixed = ITEM.replace("Anna", "Maria", 1).replace("Peter", "Hans", 1).replace("12", "75", 1)
    part = " ".join(ITEM.split()[:20])
    assert set(found(spark, [mixed, mixed + " " + prose(rng, 200) + " " + part], [ITEM])) == {(1, 0)}


def test_other_letter_case(spark):
    got = found(spark, [ITEM.lower(), ITEM.upper(), ITEM.title(), ITEM.lower().replace("12", "75")], [ITEM])
    assert {d for d, _ in got} == {0, 1, 2, 3} and [got[d, 0].verbatim for d in range(4)] == [True, True, True, False]
    names = "Then Anna Met Peter Near Old Town Hall while Maria And Hans Left London For Rome"
    assert set(found(spark, [names.lower(), names.upper()], [names])) == {(0, 0), (1, 0)}


def test_items_without_literal_windows(spark):
    rng = random.Random(6)
    items = ["Compute 12 + 35 * 4 - 7", "Anna Peter Maria Hans Paris London", "1 2 3 4 5 6 7 8", "Photosynthesis", "Seven 8 kg", "+ = ?", "Anna 1 Peter 2 3 4 5"]
    texts = [prose(rng, 9) + " " + x + ". " + prose(rng, 9) for x in items] + [items[3].lower(), "seven 8 KG", "compute 12 + 36 * 4 - 7", "2 3 4 5 6 7 8 9", "anna 1 peter 2 3 4 6", "seven 8 lb", prose(rng, 5000) + " " + items[2]]
    assert set(found(spark, texts, items)) == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (6, 6), (7, 3), (8, 4), (13, 2)}


def test_id_with_several_texts(spark):
    """Places found in one text of an id are judged on that text, and any of its texts may hold the passage."""
    rng = random.Random(8)
    texts = [prose(rng, 60), prose(rng, 20) + " " + ITEM, "a short one"]
    docs = spark.createDataFrame([(1, t) for t in texts] + [(2, texts[0]), (3, texts[1]), (3, texts[1])], "doc_id long, text string")
    bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    rows = decontaminate(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.verbatim) for r in rows) == [(1, 7, True), (3, 7, True)]


def test_without_adaptive_execution(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        docs = spark.createDataFrame([(1, ITEM), (2, "nothing of the kind is in here")], "doc_id long, text string")
        bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
        docs.write.parquet(str(tmp_path / "docs"))
        for d in (docs, spark.read.parquet(str(tmp_path / "docs"))):
            assert [(r.doc_id, r.item_id) for r in decontaminate(d, bench).collect()] == [(1, 7)]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def brute(texts, item, coverage=0.4, enough=25):
    """Documents with enough of the item's literal windows, in lower case, along one stretch; for items without capitals, numbers or units."""
    import re

    words = lambda t: re.findall(r"\w+", t.lower())
    want, hits = [tuple(words(item)[i : i + 5]) for i in range(len(words(item)) - 4)], set()
    for d, t in enumerate(texts):
        at: dict[int, set[int]] = {}
        own = words(t)
        for pos in range(len(own) - 4):
            for ipos, w in enumerate(want):
                if tuple(own[pos : pos + 5]) == w:
                    for k in (0, 1):
                        at.setdefault((pos - ipos + k * 32) // 64 * 2 + k, set()).add(ipos)
        if any(len(x) >= min(coverage * len(want), enough) for x in at.values()):
            hits.add(d)
    return hits


def test_against_brute_force(spark):
    rng = random.Random(9)
    item = prose(rng, 40)
    words = item.split()
    texts = []
    for _ in range(60):
        lo, n = rng.randrange(30), rng.randrange(5, 40)
        part = [w if rng.random() > 0.04 else "changed" for w in words[lo : lo + n]]
        texts.append(" ".join([prose(rng, rng.randrange(60)), *part, prose(rng, rng.randrange(60))]))
    assert {d for d, _ in found(spark, texts, [item])} == brute(texts, item)


UNITS = {"kg", "lb", "m", "euros"}


def words_of(text):
    """Words of a text without punctuation, each with its kind: a number, a unit after a number, a capitalised word, or another."""
    import re

    out = []
    for w in re.findall(r"[0-9]+(?:[.,][0-9]+)*|[^\W\d_]+", text):
        if w[0].isdigit():
            out.append(("number", w))
        elif out and out[-1][0] == "number" and w.lower() in UNITS:
            out.append(("unit", w.lower()))
        else:
            out.append(("name" if len(w) > 1 and w[0].isupper() and w[1:].islower() else "word", w.lower()))
    return out


def brute_slots(texts, item, coverage=0.4, enough=25, consistency=0.8):
    """Best consistency of each document that holds the item, by trying every offset of every stretch on windows compared word by word."""

    def windows(words, names):
        of = [w if k == "word" or (k == "name" and not names) else k.upper() for k, w in words]
        return [tuple(of[i : i + 5]) for i in range(len(of) - 4)]

    literal = lambda w: sum(x not in ("NUMBER", "UNIT", "NAME") for x in w) >= 3
    theirs, best = words_of(item), {}
    kinds = [{i: w for i, w in enumerate(windows(theirs, names)) if literal(w)} for names in (True, False)]
    for d, text in enumerate(texts):
        own = words_of(text)
        hits = {(pos, ipos, k) for k, names in enumerate((True, False)) for pos, w in enumerate(windows(own, names)) for ipos, v in kinds[k].items() if v == w}
        for half in (0, 1):
            stretches = {}
            for h in hits:
                stretches.setdefault((h[0] - h[1] + half * 32) // 64, set()).add(h)
            for some in stretches.values():
                for a in {pos - ipos for pos, ipos, _ in some}:
                    for width in (0, 64):
                        for kind in (0, 1):
                            near = sorted((ipos, abs(pos - ipos - a), pos, k) for pos, ipos, k in some if abs(pos - ipos - a) <= width and k <= kind)
                            if not any(n and n >= min(coverage * len(of), enough) for n, of in ((len({x[0] for x in near if x[3] == k}), kinds[k]) for k in (0, 1))):
                                continue
                            at = {}
                            for ipos, _, pos, _ in near:
                                at.setdefault(ipos, pos)
                            pairs = {(theirs[i + j][1], own[p + j][1]) for i, p in at.items() for j in range(5) if theirs[i + j][0] != "word"}
                            share = min(len({x for x, _ in pairs}), len({y for _, y in pairs})) / len(pairs) if pairs else 1.0
                            if share >= consistency:
                                best[d] = max(best.get(d, 0), share)
    return best


def test_slots_against_brute_force(spark):
    """Names, numbers and units changed throughout, in places only, or mixed up, in whole items and parts, with words put in and left out."""
    rng = random.Random(11)
    names, units = ["Anna", "Peter", "Maria", "Hans", "Olga", "Ivan"], sorted(UNITS)
    slots = [rng.choice([rng.choice(names[:3]), f"{rng.randrange(2, 6)} {rng.choice(units[:2])}", str(rng.randrange(2, 6))]) for _ in range(14)]
    item = " ".join(f"{prose(rng, 3).lower()} {s}" for s in slots)
    texts = []
    for n in range(80):
        new = item.split()
        renamed = {w: rng.choice(names) if w in names else str(rng.randrange(2, 99)) if w[0].isdigit() else w for w in set(new)}
        chance = rng.choice([0, 1, 1, 0.5])
        new = [renamed[w] if rng.random() < chance else w for w in new]
        if n % 4 == 3:
            new = [rng.choice(names) if w in names and rng.random() < 0.4 else w for w in new]
        if n % 5 == 4:
            del new[rng.randrange(len(new))]
        lo = rng.choice([0, 0, rng.randrange(30)])
        part = new[lo : lo + rng.choice([100, 100, rng.randrange(8, 40)])]
        texts.append(" ".join([prose(rng, rng.randrange(40)), *part, prose(rng, rng.randrange(40))]))
    got = {d: r.consistency for (d, _), r in found(spark, texts, [item]).items()}
    want = brute_slots(texts, item)
    assert set(got) == set(want) and 10 < len(got) < 75


def test_texts_are_coded_once(spark):
    """No filter repeats what makes words and codes of a text; a plain explode or a filter on empty texts moved one below them."""
    docs = spark.createDataFrame([(1, ITEM)], "key long, text string").where("text is not null")
    for codes in (["t", "p"], ["t", "p", "r"]):
        places = D._windows(D._coded(docs, "key", D.template_words(F.col("text")), "r" in codes).drop("words"), "key", "pos", codes)
        plan = places._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_replace(") == 2 and plan.count("xxhash64(lower(") == len(codes) - 1


def test_words_and_codes_of_odd_texts(spark):
    """Words against the separators said in full, codes against their rules, also of points, commas, marks and letters of other scripts."""
    rng = random.Random(12)
    parts = ["5", "12", "٣", "²", "Ⅷ", "kg", "Kg", "MB", "k", "Anna", "ANNA", "aNNa", "É", "Élan", "élan", "ß", "Żółw", "ǅabc", "𝐀𝐛", "𐐀𐐨", "中文", "a", "z", "A", "{", "~", ".", ",", "..", ",.", " ", " ", "\n", "\t", "\u0001", "\u0002", "\0", ":", "-", "'", " ", "é", "😀"]
    texts = ["", " ", ".", "5.", ".5", "5,5", "5..5", "5., kg", "5 kg", "5\u0001kg", "1.5.2,3", "٣.٣", "5.kg", "5 kgs", "5 kg.", "a.5", "5.a"] + ["".join(rng.choices(parts, k=rng.randrange(1, 40))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "key long, text string")
    plain = F.regexp_replace("text", r"(?:[^\p{L}\p{N}.,]|[.,](?![0-9])|(?<![0-9])[.,])+", " ")
    marked = F.regexp_replace(plain, r"(?<=[0-9]) (?=(?i:" + "|".join(D.UNITS) + r")(?: |$))", " \u0001")
    want = {r.key: [w for w in r.m.split(" ") if w] for r in df.select("key", marked.alias("m")).collect()}
    hashes = {}
    got = D._coded(df, "key", D.template_words(F.col("text")), True).collect()
    lower = spark.createDataFrame([(w, w.replace("\u0001", "")) for w in {w for ws in want.values() for w in ws}], "w string, own string")
    for r in lower.select("w", F.xxhash64(F.lower("own")).alias("h"), (F.substring("w", 1, 1) != F.lower(F.substring("w", 1, 1))).alias("first"), (F.substring("w", 2, 1 << 30) == F.lower(F.substring("w", 2, 1 << 30))).alias("rest")).collect():
        hashes[r.w] = (r.h, r.first and r.rest and len(r.w) > 1)
    assert len(got) == len(texts)
    for r in got:
        words = want[r.key]
        value = [D.UNIT if w[0] == "\u0001" else D.NUMBER if w[0] in "0123456789" else None for w in words]
        assert r.words == words
        assert r.r == [hashes[w][0] for w in words]
        assert r.p == [v or hashes[w][0] for w, v in zip(words, value, strict=True)]
        assert r.t == [v or (D.NAME if hashes[w][1] else hashes[w][0]) for w, v in zip(words, value, strict=True)]


def test_windows_of_long_and_empty_texts(spark):
    """Every place once, at and beyond the edge of a block too."""
    sizes = [0, 1, 4, 5, D.BLOCK - 1, D.BLOCK, D.BLOCK + 1, D.BLOCK + 4, 2 * D.BLOCK + 3]
    df = spark.createDataFrame([(n, list(range(n)), list(range(7, n + 7))) for n in sizes] + [(-1, None, None)], "key long, t array<long>, p array<long>")
    got = sorted(map(tuple, D._windows(df, "key", "pos", ["t", "p"]).collect()), key=lambda r: r[:2])
    at = lambda i, n, d: i + d if i < n else None
    assert got == [(n, i, *(at(i + k, n, 0) for k in range(5)), *(at(i + k, n, 7) for k in range(5))) for n in sizes for i in range(n)]
