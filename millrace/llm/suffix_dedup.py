"""Operator 5: bytes in strings of a minimum length that stand more than once, by suffix sorting in tasks.

Every window of LENGTH bytes is assigned to its anchor, the least hashed ANCHOR-byte string in it, leftmost of equals. Equal windows have equal anchors, so
windows need only be compared with those of the same anchor. Neighbouring windows with the anchor in common form a run, and a run's context
is the text they cover. Three steps settle the runs, each passing on only what it leaves open:

1. a run whose anchor stands nowhere else has no repeat; a run whose whole context stands elsewhere is repeated throughout;
2. of the others, a run none of whose strings of CORE bytes around the anchor stands in another context of the anchor has no repeat;
3. contexts of an anchor that are left go to one task, are suffix-sorted, and threshold-bounded interval expansion on their Burrows-Wheeler
   transform finds which neighbouring suffixes share LENGTH bytes or more. An anchor with more than MOST contexts is dealt into parts; what a
   part leaves open, and one of each window it has settled, is counted by hash over all parts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common as C

LENGTH, ANCHOR, STEP = 200, 40, 20
CORE = LENGTH - STEP
#: Contexts of an anchor that one task sorts at most.
MOST = 1024
#: Bytes of contexts that are suffix-sorted together, more only for one anchor.
SORT_BYTES = 200_000
CHUNK = 600_000
#: Bytes of a table of spans that is broadcast at most.
BROADCAST_BYTES = 24 << 20


def runs_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, first window, number of windows, anchor hash and anchor place of every run; places count from the start of raw."""
    m, w = len(raw) - ANCHOR + 1, LENGTH - ANCHOR + 1
    none = np.zeros(0, np.int64)
    if m < w:
        return none, none, none, none.astype(np.uint64), none
    at = np.arange(m)
    h = C.span_hash(C.prefix_sums(raw), at, at + ANCHOR)
    bits = np.uint64(32)  # of a place; the same in every chunk, so that equal windows have equal anchors
    key = (h >> bits << bits) | at.astype(np.uint64)
    blocks = -(-m // w)
    grid = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    grid[:m] = key
    grid = grid.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    n = m - w + 1
    place = (np.minimum(back[:n], ahead[w - 1 : w - 1 + n]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    whole = np.zeros(n, bool)
    for a, z in zip(off[:-1].tolist(), off[1:].tolist()):
        if z - a >= LENGTH:
            whole[a : z - LENGTH + 1] = True
    same = whole[1:] & whole[:-1] & (place[1:] == place[:-1])
    first = np.flatnonzero(whole & ~np.append(False, same))
    last = np.flatnonzero(whole & ~np.append(same, False))
    return np.searchsorted(off, first, "right") - 1, first, last - first + 1, h[place[first]], place[first]


def _runs(batches):
    for b in C.chunks(batches, CHUNK):
        raw, off = C.flat(b.column("text"))
        row, first, n, anchor, place = runs_of(raw, off)
        data = memoryview(raw.tobytes())
        context = [xxhash.xxh3_64_intdigest(data[s:e], p) for s, e, p in zip(first.tolist(), (first + n - 1 + LENGTH).tolist(), (place - first).tolist())]
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [b.column("t1").take(take), b.column("t2").take(take), pa.array((first - off[row]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(np.array(context, np.uint64).view(np.int64)), pa.array((place - first).astype(np.int32))],
            ["t1", "t2", "first", "n", "anchor", "context", "lead"],
        )


def core_places(lead: int, n: int) -> list[int]:
    """How far before the anchor the CORE strings of a run's windows begin."""
    return sorted({(lead - k) // STEP * STEP for k in range(n)})


def _contexts(batches):
    """The bytes of the contexts asked for, and hashes of the strings of CORE bytes around the anchor that a window of the run holds."""
    for b in batches:
        for i in range(b.num_rows):
            text = (b.column("text")[i].as_py() or "").encode()
            asked = b.column("asked")[i].as_py()
            out = {k: [r[k] for r in asked] for k in ("anchor", "first", "n", "lead", "open", "parts")}
            parts, cores = [], []
            for r in asked:
                s, n, lead = r["first"], r["n"], r["lead"]
                part = text[s : s + n - 1 + LENGTH]
                parts.append(part)
                # A window that starts `left` before the anchor holds the string that starts at `left` rounded down to a step.
                lefts = core_places(lead, n)
                cores.append([xxhash.xxh3_64_intdigest(part[lead - x : lead - x + CORE], x) - (1 << 63) for x in lefts])
            k = len(asked)
            yield pa.RecordBatch.from_arrays(
                [pa.array([b.column("t1")[i].as_py()] * k, pa.int64()), pa.array([b.column("t2")[i].as_py()] * k, pa.int64()), pa.array(out["anchor"], pa.int64()), pa.array(out["first"], pa.int32()), pa.array(out["n"], pa.int32()), pa.array(out["lead"], pa.int32()), pa.array(out["open"], pa.bool_()), pa.array(out["parts"], pa.int32()), pa.array(parts, pa.binary()), pa.array(cores, pa.list_(pa.int64()))],
                ["t1", "t2", "anchor", "first", "n", "lead", "open", "parts", "bytes", "cores"],
            )


def sort_suffixes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of the contexts in the order of their first LENGTH bytes at least, and the text they index: bytes + 1, each context ended by a 0 of its own."""
    k = len(off) - 1
    text = np.zeros(len(raw) + k, np.int64)
    ends = off[1:] + np.arange(k)
    mask = np.ones(len(text), bool)
    mask[ends] = False
    text[mask] = raw.astype(np.int64) + 1
    n, pack = len(text), 7
    owner = np.searchsorted(ends, np.arange(n))
    left = ends[owner] - np.arange(n)
    key = np.zeros(n, np.int64)
    for i in range(pack):
        key = key * 257 + np.where(left > i, text[np.minimum(np.arange(n) + i, n - 1)], 0)
    # A suffix that ends within the pack is unlike any other: its end is its own.
    order = np.lexsort((np.where(left < pack, owner + 1, 0), key))
    new = np.append(True, (np.diff(key[order]) != 0) | (left[order][1:] < pack) | (left[order][:-1] < pack))
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new) - 1
    step = pack
    while step < LENGTH and rank.max() < n - 1:
        key = rank * n + rank[np.minimum(np.arange(n) + step, n - 1)] * (left >= step)
        order = np.argsort(key)
        rank[order] = np.cumsum(np.append(True, np.diff(key[order]) != 0)) - 1
        step *= 2
    return order, text


def shared_suffixes(raw: np.ndarray, off: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Marks the places of raw where a string of `length` bytes starts that also starts at another place, strings not crossing contexts.

    Interval expansion: the interval of suffixes that begin with a string w of l bytes gives, for each byte c before them, the interval of cw; where the common
    prefix after the latter's end is not yet known, it is l, and cw is expanded at the next level. After `length` levels, what is not known is
    longer. Levels are whole arrays of intervals.
    """
    order, text = sort_suffixes(raw, off)
    n = len(order)
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    before = order - 1
    previous = np.where(before >= 0, text[before], 0)
    back = inverse[before]
    head = text[order]
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    # Level 0: the intervals of single bytes, and each context's end, which is a symbol of its own.
    lo = np.flatnonzero(np.append(True, head[1:] != head[:-1]) | (head == 0))
    hi = np.append(lo[1:], n) - 1
    known[hi + 1] = True
    for _ in range(1, length):
        size = hi - lo + 1
        which = np.repeat(np.arange(len(lo)), size)
        at = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + lo[which]
        some = previous[at] > 0
        key = np.sort(which[some] * (n + 1) + back[at[some]])
        if not len(key):
            break
        owner, to = key // (n + 1), key % (n + 1)
        new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (head[to[1:]] != head[to[:-1]])))
        lo, hi = to[new], to[np.append(new[1:], len(to)) - 1]
        unknown = ~known[hi + 1]
        lo, hi = lo[unknown], hi[unknown]
        known[hi + 1] = True
        if not len(lo):
            break
    long = ~known
    hit = order[np.flatnonzero(long[:-1] | long[1:])]
    out = np.zeros(len(text), bool)
    out[hit] = True
    return out[text > 0]


def _settle(batches):
    """Repeated windows of contexts that come sorted by anchor and part, in groups of whole parts: as spans, without a window hash.

    Of an anchor in several parts also window hashes, for windows whose CORE string stands twice: one row for each that the part has settled, and a row, with
    its place, for each it has not, which another part may settle."""
    rows: list[dict] = []
    held = 0
    names = ("anchor", "part", "t1", "t2", "first", "n", "lead", "open", "parts", "near", "bytes")

    def settled():
        raw = np.frombuffer(b"".join(r["bytes"] for r in rows), np.uint8)
        off = np.concatenate(([0], np.cumsum([len(r["bytes"]) for r in rows])))
        hit = shared_suffixes(raw, off)
        out: list[tuple] = []
        known: set[tuple] = set()
        for r, a, z in zip(rows, off[:-1], off[1:]):
            t1, t2, first, own = r["t1"], r["t2"], r["first"], np.flatnonzero(hit[a:z])
            if r["open"] and len(own):
                cut = np.flatnonzero(np.append(True, np.diff(own) != 1))
                out += [(t1, t2, first + int(i), first + int(j) + LENGTH, None, None, True) for i, j in zip(own[cut], own[np.append(cut[1:], len(own)) - 1])]
            if r["parts"] > 1:
                data, places = memoryview(r["bytes"]), core_places(r["lead"], r["n"])
                near = {places[i] for i in r["near"]}
                for k in range(r["n"]):
                    if (r["lead"] - k) // STEP * STEP in near:
                        w = xxhash.xxh3_64_intdigest(data[k : k + LENGTH]) - (1 << 63)
                        if not hit[a + k]:
                            out.append((t1, t2, first + k, first + k + LENGTH, r["anchor"], w, r["open"]))
                        elif (r["anchor"], w) not in known:
                            known.add((r["anchor"], w))
                            out.append((t1, t2, first + k, first + k + LENGTH, r["anchor"], w, False))
        columns = list(zip(*out)) or [()] * 7
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["t1", "t2", "lo", "hi", "anchor", "window", "open"])

    for b in batches:
        for r in zip(*(b.column(k).to_pylist() for k in names)):
            if held >= SORT_BYTES and r[:2] != (rows[-1]["anchor"], rows[-1]["part"]):
                yield settled()
                rows, held = [], 0
            rows.append(dict(zip(names, r)))
            held += len(r[-1])
    if rows:
        yield settled()


def _merge(batches):
    """Spans of each text, united and in order, as one flat list lo, hi, lo, hi, ..."""
    for b in batches:
        out = []
        for spans in b.column("spans").to_pylist():
            flat: list[int] = []
            for lo, hi in sorted((s["lo"], s["hi"]) for s in spans):
                if flat and lo <= flat[-1]:
                    flat[-1] = max(flat[-1], hi)
                else:
                    flat += [lo, hi]
            out.append(flat)
        yield pa.RecordBatch.from_arrays([b.column("t1"), b.column("t2"), pa.array(out, pa.list_(pa.int32()))], ["t1", "t2", "spans"])


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Ids and texts with 128 bits that stand for a text, in two columns."""
    d = C.id_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    return d.select("doc_id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2"))


def repeated_spans(d: DataFrame) -> DataFrame:
    """(t1, t2, spans): of every text with a repeated string, the spans of bytes that such strings cover."""
    runs = C.written(d.select("t1", "t2", "text").mapInArrow(C.lean(_runs), "t1 long, t2 long, first int, n int, anchor long, context long, lead int"), "runs")
    anchors = runs.groupBy("anchor").agg(F.count("*").alias("total"), F.min("context").alias("lo"), F.max("context").alias("hi")).where("total > 1").select("anchor", (F.col("lo") != F.col("hi")).alias("mixed"))
    anchors = C.cut(anchors)  # both sides of a join on an anchor are plain tables, so that Spark can split a hot anchor's rows
    runs = C.written(runs.join(anchors, "anchor"), "runs-with-anchor")
    classes = runs.where("mixed").groupBy("anchor", "context").agg(F.count("*").alias("copies"), F.min(F.struct("t1", "t2", "first", "n", "lead")).alias("x"))
    classes = C.written(classes, "context-classes")
    # Step 1: runs of contexts that stand twice.
    alone = classes.where("copies = 1").select("anchor", "context")
    settled = runs.join(alone, ["anchor", "context"], "left_anti")
    spans = settled.select("t1", "t2", F.col("first").alias("lo"), (F.col("first") + F.col("n") - 1 + LENGTH).alias("hi"))
    per_anchor = classes.groupBy("anchor").agg(F.count("*").alias("m"), F.sum(F.when(F.col("copies") == 1, 1).otherwise(0)).alias("left")).where("left > 0").select("anchor", F.ceil(F.col("m") / MOST).cast("int").alias("parts"))
    asked = classes.join(C.cut(per_anchor), "anchor").select("x.t1", "x.t2", F.struct("anchor", "x.first", "x.n", "x.lead", (F.col("copies") == 1).alias("open"), "parts").alias("r"))
    asked = C.written(asked.groupBy("t1", "t2").agg(F.collect_list("r").alias("asked")), "contexts-asked")
    keys = asked.select("t1", "t2")
    texts = d.join(F.broadcast(keys) if keys.count() <= C.BROADCAST_ROWS else keys, ["t1", "t2"], "left_semi").groupBy("t1", "t2").agg(F.min("text").alias("text"))
    found = texts.join(asked, ["t1", "t2"]).mapInArrow(C.lean(_contexts), "t1 long, t2 long, anchor long, first int, n int, lead int, open boolean, parts int, bytes binary, cores array<long>")
    found = C.written(found, "contexts")
    # Step 2: strings of CORE bytes that stand in two contexts of the anchor.
    core = found.select("t1", "t2", "anchor", "first", F.posexplode("cores").alias("nth", "core"))
    twice = core.groupBy("anchor", "core").count().where("count > 1").select("anchor", "core")
    close = core.join(C.cut(twice), ["anchor", "core"]).groupBy("t1", "t2", "first").agg(F.collect_set("nth").alias("near"))
    found = found.drop("cores").join(close, ["t1", "t2", "first"]).withColumn("part", F.pmod(F.xxhash64("t1", "t2", "first"), F.col("parts")))
    # Step 3.
    dealt = found.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    got = C.written(dealt.mapInArrow(C.lean(_settle), "t1 long, t2 long, lo int, hi int, anchor long, window long, open boolean"), "settled")
    spans = spans.unionByName(got.where("window is null").select("t1", "t2", "lo", "hi"))
    again = got.where("window is not null").groupBy("anchor", "window").count().where("count > 1").select("anchor", "window")
    spans = spans.unionByName(got.where("open and window is not null").join(C.cut(again), ["anchor", "window"]).select("t1", "t2", "lo", "hi"))
    spans = spans.distinct().groupBy("t1", "t2").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return C.written(spans.mapInArrow(C.lean(_merge), "t1 long, t2 long, spans array<int>"), "repeated-spans")


def _small(spans: DataFrame, col: str = "spans") -> DataFrame:
    """The table of spans, to be broadcast if its size shows it to be small."""
    rows, places = spans.agg(F.count("*"), F.coalesce(F.sum(F.size(col)), F.lit(0))).first()
    return F.broadcast(spans) if 64 * rows + 4 * places <= BROADCAST_BYTES else spans


def inside_characters(raw: bytes, lo: int, hi: int) -> tuple[int, int]:
    """The span without the parts of characters at its ends."""
    while lo < hi and raw[lo] & 0xC0 == 0x80:
        lo += 1
    while hi > lo and hi < len(raw) and raw[hi] & 0xC0 == 0x80:
        hi -= 1
    return lo, hi


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """For every row the bytes of its text, how many of them repeated strings cover, the maximal spans of these, and the SHA-256 of the bytes that stay.

    A string of LENGTH bytes is repeated when it starts at two places of the table, in one text or in two; judged on the input. Matches never cross texts.
    A null text counts as empty; shorter texts have no repeats; a repeated row's text stands twice, so all of it goes if it is long enough;
    null ids are carried along; further columns are not read. with_text adds `kept`, the text without the spans, which there are
    narrowed to whole characters. Texts are shuffled only where they have open contexts; the table of spans is broadcast if its bytes are few.
    """
    d = keyed(docs, id_col, text_col)
    spans = _small(repeated_spans(d))

    def run(batches):
        for b in C.chunks(batches):
            out: list[list] = [[], [], [], [], []]
            for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
                raw, at, parts, letters, gone = (text or "").encode(), 0, [], [], 0
                spans = spans or []
                for lo, hi in zip(spans[::2], spans[1::2]):
                    parts.append(raw[at:lo])
                    gone, at = gone + hi - lo, hi
                parts.append(raw[at:])
                out[0].append(len(raw))
                out[1].append(gone)
                out[2].append(len(spans) // 2)
                out[3].append(hashlib.sha256(b"".join(parts)).hexdigest())
                if with_text:
                    at = 0
                    for lo, hi in zip(spans[::2], spans[1::2]):
                        lo, hi = inside_characters(raw, lo, hi)
                        letters.append(raw[at:lo])
                        at = hi
                    out[4].append(b"".join([*letters, raw[at:]]).decode())
            arrays = [b.column("doc_id"), *(pa.array(out[k], pa.int64()) for k in range(3)), pa.array(out[3], pa.string())] + [pa.array(out[4], pa.string())] * with_text
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text)

    return d.join(spans, ["t1", "t2"], "left").select("doc_id", "text", "spans").mapInArrow(C.lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text)


def without_spans(docs: DataFrame, spans: DataFrame, text_col: str = "text", count_col: str = "n_chars", blank: bool = True) -> DataFrame:
    """docs, all columns, with the spans cut out of the texts, narrowed to whole characters, and their characters recounted. Other rows stay as they are.

    Without `blank`, a text goes that was cut and of which only white space is left.
    """
    columns = docs.columns
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.withColumns({"_t1": F.xxhash64(text), "_t2": F.xxhash64(F.lit(7), text)})
    s = spans.select(F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), F.col("spans").alias("_spans"))
    d = d.join(_small(s, "_spans"), ["_t1", "_t2"], "left")

    def cut(batches):
        for b in C.chunks(batches, col=text_col):
            texts = []
            for t, own in zip(b.column(text_col), b.column("_spans").to_pylist()):
                raw, at, parts = t.as_py().encode(), 0, []
                for lo, hi in zip(own[::2], own[1::2]):
                    lo, hi = inside_characters(raw, lo, hi)
                    parts.append(raw[at:lo])
                    at = hi
                texts.append(b"".join([*parts, raw[at:]]).decode())
            new = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([new if c == text_col else pc.utf8_length(new).cast(b.schema.field(c).type) if c == count_col else b.column(c) for c in columns], columns)

    same = d.where("_spans is null").select(columns)
    changed = d.where("_spans is not null").select(*columns, "_spans").mapInArrow(C.lean(cut), docs.schema)
    if not blank:
        changed = changed.where(F.col(text_col).rlike(r"\S"))
    return same.unionByName(changed)
