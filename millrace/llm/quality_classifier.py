"""Operator 3: quality of a document by random-indexing word vectors and a small network.

A term is a word's hash bucket or the bucket of its shape (runs of upper case, other letters and digits folded, other characters kept). Each term has a
sparse random index vector; the sum of the index vectors of the terms next to it, over all documents, is its context vector. A document
is the mean and the spread of its terms' unit context vectors. A two-layer network scores it, its logits divided by a temperature
fitted on labelled documents that did not train it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common as C
from millrace.llm import folds

WORDS, SHAPES, WIDTH = 1 << 14, 1 << 11, 32
#: Bytes of text whose terms a task counts, and whose vectors it holds, at a time.
CHUNK, SCORED = 1 << 20, 1 << 19
TERMS = WORDS + SHAPES
_BLOCKS = 256
_PER_BLOCK = TERMS // _BLOCKS
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = 1, 2, 2, 3


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Two places with a sign each for every term: its sparse ternary index vector."""
    rng = np.random.default_rng(11)
    return rng.integers(0, WIDTH, (2, TERMS)), rng.integers(0, 2, (2, TERMS)) * 2 - 1


def terms(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bucket, shape bucket (from WORDS on) and row of every word."""
    start, end, row = C.words(raw, off)
    word = (C.span_hash(C.prefix_sums(raw), start, end) % np.uint64(WORDS)).astype(np.int64)
    kind = _CLASS[raw]
    lead = np.append(True, kind[1:] != kind[:-1]) if len(raw) else np.zeros(0, bool)
    lead[start] = True
    place = np.concatenate(([0], np.cumsum(lead)))
    folded = kind[lead]
    shape = (C.span_hash(C.prefix_sums(folded), place[start], place[end]) % np.uint64(SHAPES)).astype(np.int64) + WORDS
    return word, shape, row


def _contexts(batches):
    """A task's sums of neighbours' index vectors, a row for each block of terms."""
    place, sign = _index_vectors()
    total = np.zeros(TERMS * WIDTH)
    for b in C.chunks(batches, CHUNK):
        word, shape, row = terms(*C.flat(b.column("text")))
        if len(row) < 2:
            continue
        pair = row[1:] == row[:-1]
        for left in (word, shape):
            a, z = left[:-1][pair], left[1:][pair]
            for me, other in ((a, z), (z, a)):
                for nth in (0, 1):
                    total += np.bincount(me * WIDTH + place[nth][other], sign[nth][other], TERMS * WIDTH)
        same = np.concatenate((word * WIDTH, shape * WIDTH)), np.concatenate((shape, word))
        for nth in (0, 1):
            total += np.bincount(same[0] + place[nth][same[1]], sign[nth][same[1]], TERMS * WIDTH)
    yield _rows(total.astype(np.int64))


def _rows(total: np.ndarray) -> pa.RecordBatch:
    blocks = total.reshape(_BLOCKS, -1)
    some = np.flatnonzero(blocks.any(1))
    salt = np.full(len(some), TaskContext.get().partitionId() & 0xFFFFF)  # the same when a task runs again
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([blocks[i].tobytes() for i in some], pa.binary()), pa.array(salt, pa.int32())], ["block", "sums", "salt"])


def _add(batches):
    """Sums rows of the same block as they stream by; a task holds each of its blocks once."""
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for block, sums in zip(b.column("block").to_pylist(), b.column("sums")):
            x = np.frombuffer(sums.as_buffer(), np.int64)
            held[block] = held[block] + x if block in held else x.copy()
    total = np.zeros((_BLOCKS, _PER_BLOCK * WIDTH), np.int64)
    for block, x in held.items():
        total[block] = x
    yield _rows(total.ravel())


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit context vectors of all terms from all documents, less their mean. A table of fixed size reaches the driver: TERMS x WIDTH numbers.

    Tasks' tables are added up in two rounds, first split by the number of the task, so no task sees the rows of all others.
    """
    schema = "block int, sums binary, salt int"
    partial = docs.select("doc_id", "text").mapInArrow(C.lean(_contexts), schema)
    once = partial.repartition("block", F.col("salt") % 8).mapInArrow(C.lean(_add), schema)
    total = np.zeros((_BLOCKS, _PER_BLOCK * WIDTH), np.int64)
    for r in once.repartition("block").mapInArrow(C.lean(_add), schema).toLocalIterator():
        total[r.block] += np.frombuffer(bytes(r.sums), np.int64)
    v = total.reshape(TERMS, WIDTH).astype(float)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    for part in (slice(0, WORDS), slice(WORDS, TERMS)):
        some = np.abs(v[part]).sum(1) > 0
        if some.any():
            v[part][some] -= v[part][some].mean(0)
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(vectors: np.ndarray, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Mean and spread of the vectors of each row's words and shapes, and the log of its words; zeros for a row without words."""
    word, shape, row = terms(raw, off)
    n = len(off) - 1
    count = np.bincount(row, minlength=n)
    out = np.zeros((n, 4 * WIDTH + 1), np.float32)
    full = np.flatnonzero(count)
    if len(full):
        heads = (np.cumsum(count) - count)[full]
        for k, ids in enumerate((word, shape)):
            x = vectors[ids]
            mean = np.add.reduceat(x, heads, 0) / count[full, None]
            square = np.add.reduceat(x * x, heads, 0) / count[full, None]
            out[full, 2 * k * WIDTH : (2 * k + 1) * WIDTH] = mean
            out[full, (2 * k + 1) * WIDTH : (2 * k + 2) * WIDTH] = np.sqrt(np.maximum(square - mean * mean, 0))
    out[:, -1] = np.log1p(count)
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.first + self.first_bias) @ self.second + self.second_bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, batch: int = 128, rate: float = 0.003, seed: int = 5) -> Network:
    """Adam on the log loss with weight decay; a fifth of the rows is kept back to choose the temperature."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    back, own = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[own].mean(0), x[own].std(0) + 1e-3
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    z = (x - mean) / scale
    for epoch in range(epochs):
        mixed = rng.permutation(own)
        for at in range(0, len(mixed), batch):
            i, t = mixed[at : at + batch], t + 1
            h = np.tanh(z[i] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[i]) / len(i)
            dh = d[:, None] * p[2] * (1 - h * h)
            for k, g in enumerate((z[i].T @ dh + 2e-4 * p[0], dh.sum(0), h.T @ d + 2e-4 * p[2], d.sum(keepdims=True))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    if len(back):
        logit, best = net.logits(x[back]), np.inf
        for temperature in np.geomspace(0.25, 8, 41):
            loss = np.mean(np.logaddexp(0, logit / temperature) - y[back] * logit / temperature)
            if loss < best:
                best, net.temperature = loss, float(temperature)
    return net


def quality_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds_of: tuple[int, int] = (5, 0), sample: int = 12000, threshold: float = 0.3) -> DataFrame:
    """Quality score of every document, whether it is in the held-out fold, and the prediction at the threshold.

    The network learns from at most `sample` labelled documents outside the held-out fold (spread evenly by a hash of the id); vectors of words come
    from all documents. Of an id with several rows one is learned from, and an id that has both labels counts as 1. Without two classes to learn from, every score is the share of label 1 (0.5 without labels). A null or empty text
    is scored as a text without words; repeated rows and null ids are carried along; further columns are not read.
    """
    d = C.id_text(docs, id_col, text_col)
    vectors = word_vectors(d)
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~folds.held_out("doc_id", *folds_of))
    some = folds.sample_ids(known.groupBy("doc_id").agg(F.max("label").alias("label")), sample)

    def gather(batches):
        for b in C.chunks(batches, SCORED):
            x = pooled(vectors, *C.flat(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "x"])

    rows = d.join(F.broadcast(some), "doc_id").select("doc_id", "label", "text").mapInArrow(C.lean(gather), "doc_id long, label int, x binary")
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("x").alias("x")).select("label", "x").toArrow()
    y = rows.column("label").to_numpy().astype(float)
    x = np.stack([np.frombuffer(r.as_buffer(), np.float32) for r in rows.column("x")]).astype(float) if len(y) else np.zeros((0, 1))
    order = np.lexsort((*x.T[:3], y))  # the same rows in the same order, however they came
    net = train(x[order], y[order]) if 0 < y.sum() < len(y) else None
    alike = float(y.mean()) if len(y) else 0.5

    def run(batches):
        for b in C.chunks(batches, SCORED):
            x = pooled(vectors, *C.flat(b.column("text")))
            p = net.score(x) if net else np.full(b.num_rows, alike)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p.astype(float))], ["doc_id", "score"])

    got = d.mapInArrow(C.lean(run), "doc_id long, score double")
    return got.select("doc_id", folds.held_out("doc_id", *folds_of).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
