"""Vector codes and centroid clusters against plain loops over all pairs, and their odd rows."""

import hashlib

import numpy as np
import pytest

from millrace.llm import centroids, vector_codes
from millrace.llm.centroids import centroid_clusters, nearest
from millrace.llm.vector_codes import CoverTree

KIND = "vec_id long, embedding array<float>, label int, v int, trees string, _label int, cluster int"


def table(spark, rows):
    return spark.createDataFrame([(i, e, lab, 1, "x", 2, 3) for i, e, lab in rows], KIND)


def odd_rows(dims, n=150, seed=0):
    """Vectors on a coarse grid, so that ties abound, with copies, repeated ids and rows, and rows that are left out."""
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, dims) / 8], [None, 1, 2][i % 3]) for i in range(n)]
    rows += [(n + i, rows[0][1], 1) for i in range(40)] + [rows[5]] * 3 + [(7, rows[9][1], 2), (None, rows[3][1], None), (None, rows[4][1], None)]
    bad = [(5000, None, 1), (5001, [None] * dims, 1), (5002, [float("nan")] * dims, None), (5003, [float("inf"), *[0.0] * (dims - 1)], 1), (5004, [1.0] * (dims - 1), 1), (5005, [], 1)]
    return rows, bad


def brute_lloyd(v, books, rounds):
    """v: (rows, width); the last codebook, each row's entry and distance."""
    book = [list(map(int, b)) for b in books]
    for step in range(rounds + 1):
        pairs = [min((sum((int(a) - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(book)) for x in v]
        if step < rounds:
            for j in range(len(book)):
                own = [x for x, (_, c) in zip(v, pairs, strict=True) if c == j]
                if own:
                    book[j] = [int(sum(int(x[i]) for x in own)) // len(own) for i in range(len(book[j]))]
    return book, [c for _, c in pairs], [d for d, _ in pairs]


def floors(rows, scale):
    return [[int(np.floor(np.float64(np.float32(x)) * scale)) for x in e] for _, e, _ in rows]


@pytest.mark.parametrize("parts,dims,entries", [(4, 16, 8), (2, 4, 300)])
def test_codes(spark, monkeypatch, parts, dims, entries):
    rows, bad = odd_rows(dims)
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 0 if parts == 2 else 10)
    got = vector_codes.vector_codes(table(spark, rows + bad).repartition(3), parts=parts, entries=entries, rounds=2, scale=16).collect()
    v, w = floors(rows, 16), dims // parts
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0], v[i]))
    books, codes, errors = [], [], []
    for p in range(parts):
        part = [x[p * w : p * w + w] for x in v]
        b, c, d = brute_lloyd(part, [part[i] for i in order[:entries]], 2)
        books.append(b), codes.append(c), errors.append(d)
    error = [sum(e[i] for e in errors) for i in range(len(rows))]
    by = {lab: sum(e for e, r in zip(error, rows, strict=True) if r[2] == lab) for lab in (None, 1, 2)}
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    want = [(str(r[0]), "".join(f"{c[i]:02x}" for c in codes), error[i], by[r[2]], sha) for i, r in enumerate(rows)]
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == sorted(want)


@pytest.mark.parametrize("k", [5, 400])
def test_clusters(spark, k):
    rows, bad = odd_rows(6, seed=1)
    got = centroid_clusters(table(spark, rows + bad).repartition(3), k=k, rounds=3, scale=8, dims=6).collect()
    v = floors(rows, 8)
    sha = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest())
    order = sorted(range(len(rows)), key=lambda i: (sha(rows[i][0]) if rows[i][0] is not None else (True, ""), v[i]))
    book, c, d = brute_lloyd(v, [v[i] for i in order[:k]], 3)
    own = {j: sum(x for x, y in zip(d, c, strict=True) if y == j) for j in set(c)}
    want = [(str(r[0]), c[i], d[i], own[c[i]], sum(d), hashlib.sha256(",".join(map(str, book[c[i]])).encode()).hexdigest()) for i, r in enumerate(rows)]
    assert sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == sorted(want)


def test_empty(spark):
    none = table(spark, odd_rows(4)[1])
    for e in (none, none.limit(0)):
        codes, clusters = vector_codes.vector_codes(e, parts=8), centroid_clusters(e, dims=8)
        assert codes.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and codes.count() == 0
        assert clusters.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and clusters.count() == 0


def test_too_large_is_an_error(spark):
    far = table(spark, [(1, [1e30] * 4, 1), (2, [0.0] * 4, 1)])
    with pytest.raises(Exception, match="would not fit a long"):
        vector_codes.vector_codes(far, parts=2).count()
    with pytest.raises(Exception, match="would not fit a long"):
        centroid_clusters(far, dims=4).count()


@pytest.mark.parametrize("n,width,spread", [(1, 4, 9), (2000, 4, 30), (2000, 4, 2), (600, 1, 50), (900, 2, 1000)])
def test_tree(n, width, spread):
    """Nodes cover their points, siblings are separated, and what is assigned as a whole is what single comparisons give."""
    v = np.floor(np.random.default_rng(n).normal(0, spread, (n, width))).astype(np.int64)
    t = CoverTree.unpacked(CoverTree.of(v).packed())
    assert (t.points[t.row] == v).all() and t.weights.sum() == n
    for i in range(len(t.first)):
        inside = t.points[t.first[i] : t.last[i]]
        assert ((inside - t.points[t.centre[i]]) ** 2).sum(1).max() == t.reach[i]
        if t.end[i]:
            kids = np.arange(t.child[i], t.end[i])
            assert t.first[kids[0]] == t.first[i] and t.last[kids[-1]] == t.last[i] and (t.last[kids[:-1]] == t.first[kids[1:]]).all() and t.centre[kids[0]] == t.centre[i]
            c = t.points[t.centre[kids]]
            apart = ((c[:, None] - c) ** 2).sum(2)[~np.eye(len(kids), dtype=bool)]
            assert apart.min(initial=1 << 60) > t.reach[kids].max()
        else:
            assert t.last[i] - t.first[i] <= vector_codes.LEAF or t.reach[i] == 0
    book = np.concatenate((v[:40], v[:3]))
    d = ((v[:, None] - book) ** 2).sum(2)
    code, error = t.codes(book)
    assert (code == d.argmin(1)).all() and (error == d.min(1)).all()
    rows, sums = t.sums(book)
    assert (rows == np.bincount(code, minlength=len(book))).all() and all((sums[j] == v[code == j].sum(0)).all() for j in range(len(book)))


def test_subtrees_go_whole():
    """Two far groups and two entries: the tree is not walked down to its points."""
    v = np.concatenate([np.random.default_rng(i).integers(0, 40, (500, 4)) + 1000 * i for i in range(2)])
    assert len(CoverTree.of(v).assign(np.array([[0] * 4, [1000] * 4]))[0]) < 20


@pytest.mark.parametrize("k,d", [(1, 3), (16, 64), (9, 2)])
def test_threshold_algorithm(k, d):
    v = np.random.default_rng(k).integers(-6, 7, (3000, d))
    c = v[:k].copy()
    c[-1] = c[0]
    cluster, distance = nearest(v, c)
    every = ((v[:, None] - c) ** 2).sum(2)
    assert (cluster == every.argmin(1)).all() and (distance == every.min(1)).all()


def test_walk_ends_early(monkeypatch):
    """With groups far apart the lists are not walked to their ends: most centroids are never compared."""
    made = []
    real = np.nonzero
    monkeypatch.setattr(centroids.np, "nonzero", lambda x: (made.append(int(x.sum())), real(x))[1])
    v = np.repeat(np.arange(50), 20)[:, None] * 1000 + np.random.default_rng(0).integers(0, 5, (1000, 2))
    cluster, _ = nearest(v, np.stack([np.arange(50) * 1000] * 2, 1))
    assert (cluster == np.repeat(np.arange(50), 20)).all() and sum(made) < 3 * len(v)
