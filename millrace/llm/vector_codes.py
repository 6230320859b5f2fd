"""Vector code compression: product quantisation whose Lloyd rounds assign whole subtrees of partition-local cover trees."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common as C
from millrace.llm import vectors as V

#: Rows that share a set of trees; it bounds a worker's memory, not the work.
CHUNK = 4096
#: Points up to which a node has no children.
LEAF = 8
#: Labels up to which their sums are broadcast; beyond, the join is shuffled.
BROADCAST_LABELS = 100_000


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [first, last), one range after the other."""
    size = last - first
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


def _net(points: np.ndarray, size: np.ndarray, far: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Children of several nodes at once, whose points stand node by node: for each point its child (counted over all nodes), for each node how many there
    are, and for each child the place of its centre in points, -1 for the node's own centre.

    far: squared distances from the node's centre, reach: their maximum in each node. The farthest point becomes a child until all are within half the
    power of two that is at least the radius; so children are further apart than that, and a point belongs to the nearest of them.
    """
    cover = 4.0 ** (np.ceil(np.log2(reach) / 2) - 1)
    cover = np.where(cover >= reach, cover / 4, cover)
    far, child, kids, chosen = far.copy(), np.zeros(len(points), np.int64), np.ones(len(size), np.int64), []
    node = np.repeat(np.arange(len(size)), size)
    here, nodes = np.arange(len(points)), np.arange(len(size))  # points and nodes that are not covered yet
    while len(nodes):
        start = np.cumsum(size) - size
        most = np.maximum.reduceat(far[here], start)
        going = most > cover[nodes]
        here, nodes, size, most = here[np.repeat(going, size)], nodes[going], size[going], most[going]
        if not len(nodes):
            break
        d = far[here]
        at = np.where(d == np.repeat(most, size), np.arange(len(here)), len(here))
        new = here[np.minimum.reduceat(at, np.cumsum(size) - size)]
        other = ((points[here] - np.repeat(points[new], size, 0)) ** 2).sum(1)
        closer = other < d
        far[here[closer]] = other[closer]
        child[here[closer]] = np.repeat(kids[nodes], size)[closer]
        chosen.append((nodes, kids[nodes], new))
        kids[nodes] += 1
    begin = np.cumsum(kids) - kids
    centre = np.full(kids.sum(), -1)
    for some, number, new in chosen:
        centre[begin[some] + number] = new
    return begin[node] + child, kids, centre


class CoverTree:
    """The distinct points of one chunk and part, in an order in which every node's points lie together, with how many rows have each.

    A node has its points' range, its centre, the largest squared distance of one of its points from that, and its children's range, which is empty for a
    leaf. The node's centre is that of its first child (a cover tree whose siblings are separated, without the levels at which nothing parts).
    """

    FIELDS = ("points", "weights", "row", "first", "last", "centre", "reach", "child", "end")

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)

    @classmethod
    def of(cls, v: np.ndarray) -> CoverTree:
        points, row, weights = np.unique(v, axis=0, return_inverse=True, return_counts=True)
        at, levels, made = np.arange(len(points)), [], 1  # at: the points in the tree's order; made: nodes so far, with those of this level
        first, last, centre = np.zeros(1, np.int64), np.array([len(points)]), np.zeros(1, np.int64)
        while len(first):
            inside, size = _ranges(first, last), last - first
            far = ((points[at[inside]] - np.repeat(points[centre], size, 0)) ** 2).sum(1)
            reach = np.maximum.reduceat(far, np.cumsum(size) - size)
            split = (size > LEAF) & (reach > 0)
            kids, level = np.zeros(len(first), np.int64), [first, last, centre, reach]
            if split.any():
                inside, far = inside[np.repeat(split, size)], far[np.repeat(split, size)]
                child, kids[split], net = _net(points[at[inside]], size[split], far, reach[split])
                own = np.repeat(centre[split], kids[split])
                centre = np.where(net < 0, own, at[inside[net]])
                at[inside] = at[inside[np.argsort(child, kind="stable")]]
                size = np.bincount(child)
                first = inside[np.cumsum(size) - size]
                last = first + size
            else:
                first = first[:0]
            end = made + np.cumsum(kids)
            levels.append((*level, np.where(kids > 0, end - kids, 0), np.where(kids > 0, end, 0)))
            made += kids.sum()
        first, last, centre, reach, child, end = (np.concatenate(x) for x in zip(*levels, strict=True))
        place = np.empty(len(at), np.int64)
        place[at] = np.arange(len(at))
        return cls(points=points[at], weights=weights[at], row=place[row.reshape(-1)], first=first, last=last, centre=place[centre], reach=reach, child=child, end=end)

    def packed(self) -> bytes:
        out = io.BytesIO()
        for name in self.FIELDS:
            x = getattr(self, name)
            np.save(out, x.astype(np.int32) if name != "reach" else x, allow_pickle=False)
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> CoverTree:
        source = io.BytesIO(data)
        return cls(**{name: np.load(source, allow_pickle=False).astype(np.int64) for name in cls.FIELDS})

    def assign(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ranges [first, last) of points and the entry of the codebook nearest to all of them (ties: the lower), which together cover all points.

        If a node's second nearest entry is further from its centre than the nearest by more than twice its radius, no point of it can prefer another: the
        subtree is assigned as a whole. Otherwise its children are asked, and a leaf's points compared exactly."""
        out, now = [], np.zeros(min(1, len(self.first)), np.int64)
        while len(now):
            d = ((self.points[self.centre[now], None] - book) ** 2).sum(2)
            entry, reach = d.argmin(1), np.sqrt(self.reach[now])
            two = np.sqrt(np.partition(d, 1, 1)[:, :2]) if len(book) > 1 else None
            # The margin is above what square roots of integers can be wrong by.
            sure = (self.reach[now] == 0) | (True if two is None else two[:, 1] - two[:, 0] > 2 * reach + 1e-9 * (two[:, 1] + reach) + 1e-9)
            out.append((self.first[now[sure]], self.last[now[sure]], entry[sure]))
            open_ = now[~sure]
            leaf = self.end[open_] == 0
            p = _ranges(self.first[open_[leaf]], self.last[open_[leaf]])
            out.append((p, p + 1, ((self.points[p, None] - book) ** 2).sum(2).argmin(1)))
            now = _ranges(self.child[open_[~leaf]], self.end[open_[~leaf]])
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def sums(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of each entry and the sums of their components; a range's come from two cumulative sums."""
        first, last, entry = self.assign(book)
        n, s = np.zeros(len(book), np.int64), np.zeros(book.shape, np.int64)
        rows = np.concatenate(([0], np.cumsum(self.weights)))
        total = np.concatenate((np.zeros((1, book.shape[1]), np.int64), np.cumsum(self.points * self.weights[:, None], 0)))
        np.add.at(n, entry, rows[last] - rows[first])
        np.add.at(s, entry, total[last] - total[first])
        return n, s

    def codes(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's entry and squared distance."""
        first, last, entry = self.assign(book)
        code = np.empty(len(self.points), np.int64)
        code[_ranges(first, last)] = np.repeat(entry, last - first)
        return code[self.row], ((self.points - book[code]) ** 2).sum(1)[self.row]


def _planted(parts: int):
    """One row for each chunk: its rows' ids and labels, and a tree for each part."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                c = b.slice(at, CHUNK)
                v = V.matrix(c.column("v"))
                trees = [CoverTree.of(x).packed() for x in np.split(v, parts, 1)]
                lists = [pa.ListArray.from_arrays([0, c.num_rows], c.column(k)) for k in ("vec_id", "label")]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([trees], pa.list_(pa.binary()))], ["vec_id", "label", "trees"])

    return C.lean(run)


def _sums(books: list[np.ndarray]):
    """Per task one row for each part and entry that rows were assigned to."""

    def run(batches: Iterator[pa.RecordBatch]):
        n = [np.zeros(len(b), np.int64) for b in books]
        s = [np.zeros(b.shape, np.int64) for b in books]
        for b in batches:
            for trees in b.column("trees"):
                for i, tree in enumerate(trees):
                    one = CoverTree.unpacked(tree.as_py()).sums(books[i])
                    n[i] += one[0]
                    s[i] += one[1]
        for i in range(len(books)):
            used = np.flatnonzero(n[i])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), i, np.int32)), pa.array(used.astype(np.int32)), pa.array(n[i][used]), pa.array(list(s[i][used]), pa.list_(pa.int64()))], ["part", "entry", "n", "s"])

    return C.lean(run)


def _coded(books: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for j in range(b.num_rows):
                got = [CoverTree.unpacked(t.as_py()).codes(books[i]) for i, t in enumerate(b.column("trees")[j])]
                code = np.stack([c for c, _ in got], 1)
                two = len(f"{max(255, max(map(len, books)) - 1):x}")  # two hex digits, more only if the codebook needs them
                text = ["".join(f"{x:0{two}x}" for x in row) for row in code.tolist()]
                yield pa.RecordBatch.from_arrays([b.column("vec_id")[j].values, b.column("label")[j].values, pa.array(text), pa.array(sum(e for _, e in got))], ["vec_id", "label", "code", "error"])

    return C.lean(run)


def vector_codes(df: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of the vectors: each taken as floor(scale * x), cut into equal parts, each part coded by its codebook.

    The codebooks start as the parts of the rows with the `entries` least vec_ids. A round assigns every part to its codebook's nearest entry (ties: the
    lower) and moves each entry that has any to their exact floor(sum / count); after the rounds all are assigned once more. code holds the entries' numbers,
    two hex digits each; error is the sum of squared distances, label_error its sum over the rows of the label, nulls together.

    Trees are planted once, in chunks of a task's rows, and written; rounds only walk them. Tasks send one row of sums for each part and entry, and
    parts * entries of them meet. Equal vectors are one point of a tree.

    Defined results: rows with a null vector, or a null or non-finite component, are left out, and so are those whose length is not that of the row with the
    least vec_id of all whose length is a positive multiple of `parts`; a null vec_id comes last among the starts and keeps its row; repeated rows are rows of
    their own; rows with one vec_id are ordered by vector; with fewer rows than entries there are as many entries as rows; an empty table gives an empty
    result; further columns are not read. A component of 2^27 and more after scaling (at 64 components) is an error.
    """
    kind = df.schema[label_col].dataType.simpleString()
    kept = V.integers(df, scale, id_col, vec_col, {"label": label_col}).where((F.size("v") > 0) & (F.size("v") % parts == 0))
    by = [F.col("vec_id").asc_nulls_last(), "v"]
    lead = kept.select("vec_id", "v").orderBy(*by).limit(1).collect()
    dims = len(lead[0].v) if lead else parts
    kept = kept.where(F.size("v") == dims)
    first = np.array([r.v for r in kept.select("vec_id", "v").orderBy(*by).limit(entries).collect()], np.int64)
    if not len(first):
        return kept.select("vec_id", F.lit("").alias("code"), *(F.lit(0).cast("long").alias(c) for c in ("error", "label_error")), F.lit("").alias("codebooks_sha256")).limit(0)
    books, width = np.split(first, parts, 1), dims // parts
    trees = C.written(kept.mapInArrow(_planted(parts), f"vec_id array<long>, label array<{kind}>, trees array<binary>"), "cover-trees")
    for _ in range(rounds):
        got = V.summed(trees.select("trees").mapInArrow(_sums(books), "part int, entry int, n long, s array<long>"), ["part", "entry"], width)
        books = [b.copy() for b in books]
        for (part, entry), (n, s) in got.items():
            books[part][entry] = [x // n for x in s]
    done = C.written(trees.mapInArrow(_coded(books), f"vec_id long, label {kind}, code string, error long"), "codes")
    sums = C.written(done.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    few = sums.count() <= BROADCAST_LABELS
    joined = done.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(V.digest(x for b in books for x in b.reshape(-1))).alias("codebooks_sha256"))
