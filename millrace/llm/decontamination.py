"""Operator 2: benchmark passages in documents, also with other numbers, names or units, by template windows. DataFrame functions only.

A text becomes words without punctuation; a number, a unit after a number and a capitalised word each become a typed placeholder, other words are lower-cased.
Hashes of five-word windows, of the template and of the words in lower case, are joined with those of the benchmark. Where enough of an item's windows lie along
one stretch of a document, the values behind the placeholders decide: one value of the item must stand for one value of the document throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import common as C

WINDOW = 5
#: Words of a window that must not be placeholders.
LITERALS = 3
NUMBER, NAME, UNIT = 1, 2, 3
#: Kinds of an item's windows: templates; words in lower case with placeholders for numbers and units; words in lower case.
TEMPLATE, PLAIN, RAW = 0, 1, 2
UNITS = "mm cm m km in ft yd mi mg g kg t oz lb ml cl l s sec min h hr hours minutes seconds days years percent usd eur dollars euros cents mph kmh hz khz mhz kb mb gb w kw v a k c f".split()
#: Windows of the benchmark are broadcast up to so many rows; beyond, the join is shuffled.
BROADCAST_WINDOWS = 1_000_000
#: Positions of an item's windows may drift so far against the document's, by words put in or left out.
DRIFT = 64
#: Windows of a text that are laid out at a time; it bounds memory, not the work.
BLOCK = 4096


def template_words(text: Column) -> Column:
    """Words of letters and digits; points and commas inside a number stay. A unit after a number carries the mark U+0001."""
    # What lies between two words holds no letter or digit; it is a point or comma inside a number only if it is that one character.
    plain = F.regexp_replace(text, r"[^\p{L}\p{N}]++(?<![0-9][.,](?=[0-9]))", " ")
    marked = F.regexp_replace(plain, r"(?<=[0-9]) (?=(?i:" + "|".join(UNITS) + r")(?: |$))", " \u0001")
    return F.array_remove(F.split(marked, " "), "")


def _value(word: Column) -> Column:
    """Whether a word is a number or a marked unit: it begins with a digit or U+0001, and these come before any letter."""
    return word < ":"


def plain(words: Column) -> Column:
    """For each word a number: NUMBER, UNIT, or the hash of the word in lower case."""
    return F.transform(words, lambda w: F.when(_value(w), F.when(w < "\u0002", F.lit(UNIT).cast("long")).otherwise(F.lit(NUMBER).cast("long"))).otherwise(F.xxhash64(F.lower(w))))


def template(words: Column, plain_codes: Column) -> Column:
    """The plain codes with NAME for capitalised words."""

    def code(w: Column, c: Column) -> Column:
        first, rest = F.substring(w, 1, 1), F.substring(w, 2, 1 << 30)
        # Most words begin with a small ASCII letter, which is told first.
        name = ((w < "a") | (w >= "{")) & ~_value(w) & (first != F.lower(first)) & (rest == F.lower(rest)) & (rest != "")
        return F.when(name, F.lit(NAME).cast("long")).otherwise(c)

    return F.zip_with(words, plain_codes, code)


def raw(words: Column, plain_codes: Column) -> Column:
    """For each word the hash of its lower case, which is its plain code but for numbers and units."""
    return F.zip_with(words, plain_codes, lambda w, c: F.when(_value(w), F.xxhash64(F.lower(F.translate(w, "\u0001", "")))).otherwise(c))


def _coded(df: DataFrame, key: str, rows: Column, with_raw: bool) -> DataFrame:
    """Key, words and their codes: as a template t, plain p and, if wanted, raw r."""
    df = df.select(key, rows.alias("words")).withColumn("p", plain(F.col("words")))
    df = df.withColumn("t", template(F.col("words"), F.col("p")))
    return df.withColumn("r", raw(F.col("words"), F.col("p"))) if with_raw else df


def _windows(coded: DataFrame, key: str, at: str, codes: list[str]) -> DataFrame:
    """A row for each place of a text and, by code, the WINDOW words from there as c_0, c_1 and so on, null beyond the end. Long texts are laid out in blocks."""
    # Outer, as a filter on empty texts (also the one that Spark adds to a plain explode) would be moved below the codes and make them a second time.
    size = F.coalesce(F.size(codes[0]), F.lit(0))
    block = F.explode_outer(F.transform(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(BLOCK)), lambda i: F.struct(i.alias("i"), F.least(size - i, F.lit(BLOCK)).alias("n"), *(F.slice(c, i + 1, BLOCK + WINDOW - 1).alias(c) for c in codes))))
    blocks = coded.select(key, block.alias("b")).select(key, "b.*").where("n > 0")
    each = blocks.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return each.select(key, (F.col("i") + F.col("k")).alias(at), *(F.get(c, F.col("k") + k).alias(f"{c}_{k}") for c in codes for k in range(WINDOW)))


def _hash(code: str, size: int = WINDOW) -> Column:
    """Of the first `size` words; null ones beyond the text's end do not count."""
    return F.xxhash64(*(F.col(f"{code}_{k}") for k in range(size)))


def _literal(code: str) -> Column:
    """Whether enough of a window's words are no placeholders."""
    return sum(((~F.col(f"{code}_{k}").isin(NUMBER, NAME, UNIT)).cast("int") for k in range(WINDOW)), F.lit(0)) >= LITERALS


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.4, enough: int = 25, consistency: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """A row for each document and benchmark item whose passage it holds.

    A passage counts when `coverage` of the item's windows of one kind, or `enough` of them, lie along one stretch of the document, and the share of slot pairs
    that are one-to-one is at least `consistency` in some alignment of the stretch. Windows are of two kinds: templates, and words in lower case with
    placeholders for numbers and units only, which find copies in other letter case. An item that has neither, as its windows are mostly placeholders
    or it has fewer than five words, is found by its own words in lower case, all in a row (or `enough` windows of them).
    Returns the ids, windows found and to be found in the kind that found most, slots, their consistency, and whether
    all slot values are the item's own (verbatim). Null texts and texts and items without a word match
    nothing; repeated items count once (the least text of an item), repeated rows of a document once, and of an id with several texts each is searched; a null
    id of either side is left out. Further columns are not read. Equal texts, told by 128 bits of hashes, are judged once. Documents are read whole, their texts are
    never shuffled unless more than C.BROADCAST_ROWS of them match; windows of the benchmark are broadcast only if a count shows them to be few.
    """
    d = C.id_text(docs, id_col, text_col).where("doc_id is not null and text is not null").withColumn("key", F.struct(F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2")))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    items = C.cut(_coded(items, "item_id", template_words(F.col("text")), True))
    places = C.cut(_windows(items, "item_id", "ipos", ["t", "p", "r"]))
    kinds = [places.where(f"{c}_{WINDOW - 1} is not null").where(_literal(c)).select("item_id", F.lit(kind).alias("kind"), "ipos", _hash(c).alias("window")) for kind, c in ((TEMPLATE, "t"), (PLAIN, "p"))]
    loose = C.cut(kinds[0].unionByName(kinds[1]))
    # An item shorter than a window is one window.
    short = items.where(F.size("words") < WINDOW).select("item_id", F.size("words").alias("n"))
    bare = places.join(loose.select("item_id").distinct(), "item_id", "left_anti").join(short, "item_id", "left")
    bare = C.cut(bare.where(f"r_{WINDOW - 1} is not null or (n is not null and ipos = 0)").select("item_id", F.lit(RAW).alias("kind"), "ipos", _hash("r").alias("window"), F.coalesce("n", F.lit(WINDOW)).alias("n")))
    sizes = sorted(r.n for r in bare.select("n").distinct().collect())
    wanted = C.cut(loose.unionByName(bare.drop("n")))
    total = wanted.groupBy("item_id").agg(*(F.count(F.when(F.col("kind") == k, 1)).alias(f"of_{k}") for k in (TEMPLATE, PLAIN, RAW)))
    few = wanted.count() <= BROADCAST_WINDOWS
    coded = _coded(d, "key", template_words(F.col("text")), bool(sizes)).drop("words")
    places = _windows(coded, "key", "pos", ["t", "p", "r"] if sizes else ["t", "p"])
    full, t, p = F.col(f"t_{WINDOW - 1}").isNotNull(), F.col("t"), F.col("p")
    if not sizes:
        places = places.where(full)
    places = places.withColumns({"t": _hash("t"), "p": _hash("p")})
    if sizes:
        own = F.array_distinct(F.array_compact(F.array(F.when(full, t), F.when(full, p), *(F.when(F.col(f"r_{n - 1}").isNotNull(), _hash("r", n)) for n in sizes))))
    else:
        own = F.when(t == p, F.array(t)).otherwise(F.array(t, p))
    hits = places.select("key", "pos", F.explode(own).alias("window")).join(F.broadcast(wanted) if few else wanted, "window").select("key", "item_id", "kind", "pos", "ipos")
    # Two shifted divisions of the offsets, so that a stretch is whole in one of them.
    stretch = F.explode(F.array(*(F.floor((F.col("pos") - F.col("ipos") + k * DRIFT // 2) / DRIFT) * 2 + k for k in (0, 1)))).alias("stretch")
    found = hits.select("key", "item_id", "kind", "pos", "ipos", stretch).groupBy("key", "item_id", "stretch").agg(F.collect_set(F.struct("pos", "ipos", "kind")).alias("hits"))
    found = found.join(F.broadcast(total) if few else total, "item_id")

    def most(hits: str) -> Column:
        """The kind of which the largest share of windows is among the hits, null if none has enough: share, windows and windows to be found."""
        each = []
        for kind, share in ((TEMPLATE, coverage), (PLAIN, coverage), (RAW, 1.0)):
            n, of = F.size(F.array_distinct(F.transform(F.filter(hits, lambda h: h["kind"] == kind), lambda h: h["ipos"]))), F.col(f"of_{kind}")  # noqa: B023
            each.append(F.when((n > 0) & ((n >= share * of) | (n >= enough)), F.struct((n / of).alias("share"), n.alias("n_windows"), of.alias("item_windows"))))
        return F.array_max(F.array(*each))

    found = found.where(most("hits").isNotNull())
    # A window that stands twice has several places: every offset of the stretch is tried, alone and with the places nearest to it, by templates alone and by all kinds.
    offsets = F.array_distinct(F.transform("hits", lambda h: h["pos"] - h["ipos"]))
    tried = found.withColumn("a", F.explode(offsets)).withColumn("by", F.explode(F.when(F.col(f"of_{RAW}") > 0, F.array(F.struct(F.lit(0).alias("width"), F.lit(RAW).alias("kind")))).otherwise(F.array(*(F.struct(F.lit(width).alias("width"), F.lit(kind).alias("kind")) for width in (0, DRIFT) for kind in (TEMPLATE, PLAIN))))))
    near = F.array_sort(F.transform("hits", lambda h: F.struct(h["ipos"].alias("ipos"), F.abs(h["pos"] - h["ipos"] - F.col("a")).alias("off"), h["pos"].alias("pos"), h["kind"].alias("kind"))))
    lines = tried.withColumn("near", F.filter(near, lambda x: (x["off"] <= F.col("by.width")) & (x["kind"] <= F.col("by.kind"))))
    lines = lines.withColumn("most", most("near")).where("most is not null").withColumn("at", F.filter("near", lambda x, i: (i == 0) | (F.get(F.col("near"), i - 1)["ipos"] != x["ipos"])))
    lines = C.cut(lines.select("key", "item_id", "most", F.transform("at", lambda x: F.struct(x["pos"].alias("pos"), x["ipos"].alias("ipos"))).alias("at")).distinct())
    keys = C.cut(lines.select("key").distinct())
    texts = C.only(d.select("key", "text"), keys, on="key").groupBy("key").agg(F.min("text").alias("text")).select("key", template_words(F.col("text")).alias("own"))
    both = lines.join(texts, "key").join(items.select("item_id", "words", "t"), "item_id")
    word = lambda words, i: F.lower(F.translate(F.get(words, i), "\u0001", ""))
    pairs = F.flatten(F.transform("at", lambda h: F.array(*(F.when(F.get(F.col("t"), h["ipos"] + k).isin(NUMBER, NAME, UNIT), F.struct(word(F.col("words"), h["ipos"] + k).alias("b"), word(F.col("own"), h["pos"] + k).alias("d"))) for k in range(WINDOW)))))
    both = both.select("key", "item_id", "most", F.array_distinct(F.filter(pairs, lambda p: p.isNotNull())).alias("pairs"))
    values = lambda side: F.size(F.array_distinct(F.transform("pairs", lambda p: p[side])))
    slots = F.size("pairs")
    out = both.select("key", "item_id", "most", slots.alias("slots"), F.when(slots == 0, 1.0).otherwise(F.least(values("b"), values("d")) / slots).alias("consistency"), F.forall("pairs", lambda p: p["b"] == p["d"]).alias("verbatim"))
    best = F.max(F.struct("most", "consistency", "verbatim", "slots")).alias("x")
    out = out.where(F.col("consistency") >= consistency).groupBy("key", "item_id").agg(best)
    named = C.only(d.select("doc_id", "key"), keys, on="key").distinct().join(out, "key").groupBy("doc_id", "item_id").agg(F.max("x").alias("x"))
    return named.select("doc_id", "item_id", "x.most.n_windows", "x.most.item_windows", "x.slots", "x.consistency", "x.verbatim")
