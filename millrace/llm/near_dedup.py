"""Operator 4: near-duplicate documents by MinHash.

Many universal hash minima are banded; documents that share a band's bucket are candidates. A candidate pair is checked first by its signatures, then on
the full shingle sets, and components of the links are found by alternating large-star and small-star.

Documents with equal shingle sets form a class and are handled as one. Within a bucket candidates are not paired all with all: each class is held
against the bucket's pivot, the class that shares most with others, and what that links is one component. Where a bucket still holds several
components, blocks of its members are compared within tasks, which return only links that join components. So no link between
components is lost to a cap, and a large group of copies costs a star and what is outside it, not a square of rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common as C
from millrace.llm.graph import components

#: Chance that a pair at the similarity 0.8 shares no band: (1 - 0.8 ** ROWS) ** BANDS, under 1e-5.
BANDS, ROWS = 64, 8
#: Bytes of a signature kept for checking pairs, one of each of as many minima.
SIGNED = 256
#: Bytes of text whose shingles a task holds at a time.
CHUNK = 1 << 20
#: Members of a block, and shingles of its members together: what a family's blocks hold on average at most. A larger set is all but alone in its block.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20


def shingle_sets(raw: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted, back to back, and their offsets. Rows with fewer words than `size` have one, of all their words."""
    raw = C.lower_ascii(raw)
    start, end, row = C.words(raw, off)
    h = C.span_hash(C.prefix_sums(raw), start, end)
    n = len(off) - 1
    count = np.bincount(row, minlength=n)
    first = np.cumsum(count) - count
    shingle = np.zeros(len(h), np.uint64)
    for k in range(size):
        some = max(0, len(h) - k)
        shingle[:some] = C.mix(shingle[:some] + h[k:])
    whole = np.arange(len(h)) - first[row] <= count[row] - size
    for i in np.flatnonzero((count > 0) & (count < size)):
        x = np.uint64(count[i])
        for w in h[first[i] : first[i] + count[i]]:
            x = C.mix(np.array([x + w]))[0]
        shingle[first[i]], whole[first[i]] = x, True
    shingle, row = shingle[whole], row[whole]
    bounds = np.searchsorted(row, np.arange(n + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > 1:
            shingle[a:b].sort()
    new = np.append(True, (shingle[1:] != shingle[:-1]) | (row[1:] != row[:-1]))[: len(shingle)]
    return shingle[new], np.searchsorted(row[new], np.arange(n + 1))


_RNG = np.random.default_rng(17)
_A = _RNG.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def minima(x: np.ndarray, off: np.ndarray, part: int = 1 << 15) -> np.ndarray:
    """For each row with a set the minima of all hash functions a * x + b modulo 2 ** 32. Rows are taken in parts that fit a cache."""
    full = np.flatnonzero(np.diff(off) > 0)
    out = np.zeros((len(full), len(_A)), np.uint32)
    at = 0
    while at < len(full):
        to = max(at + 1, int(np.searchsorted(off[full + 1], off[full[at]] + part, "right")))
        lo, hi = off[full[at]], off[full[to - 1] + 1]
        own, heads = x[lo:hi], off[full[at:to]] - lo
        for k in range(len(_A)):
            out[at:to, k] = np.minimum.reduceat(own * _A[k] + _B[k], heads)
        at = to
    return out


def _sign(size: int):
    def run(batches):
        for b in C.chunks(batches, CHUNK):
            sets, off = shingle_sets(*C.flat(b.column("text")), size)
            n, full = b.num_rows, np.flatnonzero(np.diff(off) > 0)
            low = minima((sets >> np.uint64(32)).astype(np.uint32), off)
            bands = np.zeros((len(full), BANDS), np.uint64)
            for r in range(ROWS):
                bands = C.mix(bands + low[:, r::ROWS].astype(np.uint64) + np.uint64(1))
            bands = C.mix(bands + np.arange(BANDS, dtype=np.uint64)).astype(np.int64)
            place = np.full(n, -1)
            place[full] = np.arange(len(full))
            signed = low[:, :SIGNED].astype(np.uint8)
            ends = off.tolist()
            print_ = [hashlib.blake2b(sets[ends[i] : ends[i + 1]].tobytes(), digest_size=16).digest() if ends[i + 1] > ends[i] else None for i in range(n)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum((place >= 0) * BANDS))), pa.int32()), pa.array(bands.ravel()))
            sigs = pa.array([signed[k].tobytes() if k >= 0 else None for k in place], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(off).astype(np.int64)), pa.array(print_, pa.binary()), lists, sigs], ["doc_id", "n_shingles", "print", "bands", "signed"])

    return run


def _sets(size: int):
    def run(batches):
        for b in C.chunks(batches, CHUNK):
            sets, off = shingle_sets(*C.flat(b.column("text")), size)
            lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(sets.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists], ["doc_id", "shingles"])

    return run


def links(docs: DataFrame, signed: DataFrame, pairs: DataFrame, size: int, threshold: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar enough. Signatures sift out what is six standard errors below; full sets decide."""
    share = threshold / 100
    least = share - 6 * (share * (1 - share) / SIGNED) ** 0.5
    one = signed.select(F.col("rep").alias("a"), F.col("n_shingles").alias("na"), F.col("signed").alias("sa"))
    two = signed.select(F.col("rep").alias("b"), F.col("n_shingles").alias("nb"), F.col("signed").alias("sb"))

    def agree(batches):
        for x in batches:
            if x.num_rows:
                s, t = (np.frombuffer(b"".join(x.column(k).to_pylist()), np.uint8).reshape(-1, SIGNED) for k in ("sa", "sb"))
                yield x.filter(pa.array((s == t).mean(1) >= least)).select(["a", "b", "na", "nb"])

    near = pairs.join(one, "a").join(two, "b").where(100 * F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
    near = C.cut(near.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(C.lean(agree), "a long, b long, na long, nb long"))
    ids = C.cut(near.select(F.col("a").alias("doc_id")).unionByName(near.select(F.col("b").alias("doc_id"))).distinct())
    sets = C.written(C.only(docs, ids).mapInArrow(C.lean(_sets(size)), "doc_id long, shingles array<long>").dropDuplicates(["doc_id"]), "shingle-sets")
    both = near.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("xa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("xb")), "b")
    shared = F.size(F.array_intersect("xa", "xb"))
    return C.cut(both.withColumn("shared", shared).where(100 * F.col("shared") >= threshold * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b"))


def _near(left: dict, right: dict, k: int, threshold: int) -> np.ndarray:
    """Members of the right block, most alike first, whose signatures do not rule out that the k-th of the left one is linked with them, of other components than its own."""
    share = threshold / 100
    least = share - 6 * (share * (1 - share) / SIGNED) ** 0.5
    n = right["n_shingles"]
    at = np.flatnonzero((right["component"] != left["component"][k]) & (100 * np.minimum(n, left["n_shingles"][k]) >= threshold * np.maximum(n, left["n_shingles"][k])))
    alike = (right["signs"][at] == left["signs"][k]).mean(1)
    return at[np.argsort(-alike)][: (alike >= least).sum()]


def _block(members: pa.StructArray) -> dict:
    got = {k: members.field(k).to_numpy(zero_copy_only=False) for k in ("rep", "component", "n_shingles")}
    return got | {"signs": np.frombuffer(b"".join(members.field("signed").to_pylist()), np.uint8).reshape(-1, SIGNED)}


def _promising(threshold: int):
    """Pairs of blocks with a pair of members that may be linked, and for these blocks the members that have such a partner."""

    def run(batches):
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                left, right = (_block(batch.column(k)[i].values) for k in ("left", "right"))
                mine, theirs = [], np.zeros(len(right["rep"]), bool)
                for k in range(len(left["rep"])):
                    at = _near(left, right, k, threshold)
                    if len(at):
                        mine.append(int(left["rep"][k]))
                        theirs[at] = True
                if mine:
                    rows.append({c: batch.column(c)[i].as_py() for c in ("family", "k", "apart", "block")} | {"some": mine + right["rep"][theirs].tolist()})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("family", pa.int64()), ("k", pa.int64()), ("apart", pa.bool_()), ("block", pa.int64()), ("some", pa.list_(pa.int64()))]))

    return run


def _between(threshold: int):
    """Links between components among the members of two blocks; of several that join the same components, one."""

    def run(batches):
        for batch in batches:
            found: list[tuple[int, int]] = []
            for i in range(batch.num_rows):
                members = [batch.column(k)[i].values for k in ("left", "right")]
                left, right = (_block(x) for x in members)
                sets = [x.field("shingles") for x in members]
                up: dict[int, int] = {}

                def root(c, up=up):
                    while up.get(c, c) != c:
                        c = up[c]
                    return c

                for k in range(len(left["rep"])):
                    own = None
                    for j in _near(left, right, k, threshold):
                        p, q = root(left["component"][k]), root(right["component"][j])
                        if p == q:
                            continue
                        own = sets[0][k].values.to_numpy() if own is None else own
                        both = len(np.intersect1d(own, sets[1][int(j)].values.to_numpy(), assume_unique=True))
                        if 100 * both >= threshold * (left["n_shingles"][k] + right["n_shingles"][j] - both):
                            up[max(p, q)] = min(p, q)
                            found.append((int(left["component"][k]), int(right["component"][j])))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def rest(docs: DataFrame, signed: DataFrame, member: DataFrame, home: DataFrame, size: int, threshold: int) -> DataFrame:
    """Links (a, b) between components that share a bucket of three members or more, which the star of its pivot does not settle.

    Buckets that still hold several components are joined to families by the members they share. A family is dealt into blocks by count and by size of the sets,
    those of its largest component apart from the others; every block is held against every other but two of the largest component. Signatures are compared
    first: sets are built and shuffled only for members that have a possible partner, between blocks that hold such a pair. Rows are keyed by pairs of
    blocks, so a large family is spread over as many keys, and no task sees more than two blocks at a time."""
    placed = member.where("size > 2").join(home, "rep")
    open_ = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("rep").alias("first")).where("lo < hi").select("bucket", "first")
    family = components(placed.join(open_, "bucket").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct()).toDF("rep", "family")
    family = family.join(home, "rep").join(signed, "rep")
    by_part = C.cut(family.groupBy("family", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles")))
    main = by_part.groupBy("family").agg(F.max(F.struct("n", "component")).getField("component").alias("main"), F.greatest(F.ceil(F.sum("n") / BLOCK), F.ceil(F.sum("shingles") / BLOCK_SHINGLES)).alias("n_blocks"))
    own = family.join(main, "family").withColumn("apart", F.col("component") != F.col("main")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("n_blocks")))
    own = C.written(own.select("rep", "family", "component", "n_shingles", "signed", "apart", "block", "n_blocks"), "family-members")
    key, at = ["family", "apart", "block"], lambda name: F.collect_list(F.struct("rep", "component", "n_shingles", "signed", *name)).alias("x")
    blocks = C.written(own.groupBy(*key, "n_blocks").agg(at([])), "signed-blocks")
    left = lambda table: table.where("apart").select("family", F.col("block").alias("k"), F.col("x").alias("left"), *(["n_blocks"] if "n_blocks" in table.columns else []))
    others = left(blocks).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1))).withColumn("apart", F.explode(F.array(F.lit(True), F.lit(False)))).where("not apart or k <= block")
    pairs = others.join(blocks.select(*key, F.col("x").alias("right")), key)
    pairs = C.cut(pairs.select("family", "k", "apart", "block", "left", "right").mapInArrow(C.lean(_promising(threshold)), "family long, k long, apart boolean, block long, some array<long>"))
    some = C.cut(pairs.select(F.explode("some").alias("rep")).distinct())
    sets = C.only(docs, some.select(F.col("rep").alias("doc_id"))).mapInArrow(C.lean(_sets(size)), "doc_id long, shingles array<long>").dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "rep")
    blocks = C.written(own.drop("n_blocks").join(sets, "rep").groupBy(*key).agg(at(["shingles"])), "blocks")
    pairs = pairs.drop("some").join(left(blocks), ["family", "k"]).join(blocks.withColumnRenamed("x", "right"), key)
    return C.cut(pairs.select("left", "right").mapInArrow(C.lean(_between(threshold)), "a long, b long"))


def near_dedup(docs: DataFrame, shingle: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every document the size of its shingle set, its component (the smallest id that links reach) and whether it is the one to keep.

    shingle: words of a shingle, A-Z lower-cased, words being runs without ASCII white space; threshold: Jaccard similarity in per cent, met exactly counts.
    A null or empty text, or one of white space, has an empty set, links to nothing and is kept. A row with a null id is its own component (null)
    and kept, and links nothing. Repeated rows of one id share their component; all rows of the id are kept or none. Ids should name one text;
    where an id has several, one of them stands for it in comparisons. Further columns are not read. An empty table gives an empty result.
    """
    d = C.id_text(docs, id_col, text_col)
    signed = C.written(d.mapInArrow(C.lean(_sign(shingle)), "doc_id long, n_shingles long, print binary, bands array<long>, signed binary"), "signatures")
    classes = C.cut(signed.where("print is not null and doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("rep")))
    reps = signed.join(classes, "print").where("doc_id = rep")
    member = reps.select("rep", F.explode("bands").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count("*").alias("size"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("bucket", "size")
    member = C.written(member.join(shared, "bucket"), "bucket-members")
    central = C.cut(member.groupBy("rep").agg(F.sum("size").alias("weight")))
    signature = C.written(reps.join(central, "rep", "left_semi").dropDuplicates(["rep"]).select("rep", "n_shingles", "signed"), "candidates")
    weighed = member.join(central, "rep")
    pivot = weighed.groupBy("bucket").agg(F.max(F.struct("weight", "rep")).getField("rep").alias("other"))
    pairs = member.join(pivot, "bucket").where("rep <> other").select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()
    starred = components(links(d, signature, C.cut(pairs), shingle, threshold)).toDF("rep", "least")
    home = C.cut(central.join(starred, "rep", "left").select("rep", F.coalesce("least", "rep").alias("component")))
    joined = components(rest(d, signature, member, home, shingle, threshold)).toDF("component", "least")
    home = C.cut(home.join(joined, "component", "left").select("rep", F.coalesce("least", "component").alias("component")))
    named = C.cut(classes.join(home, "rep", "left").select("print", F.coalesce("component", "rep").alias("component")))
    out = signed.select("doc_id", "n_shingles", "print").join(named, "print", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
