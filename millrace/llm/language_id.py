"""Operator 6: language of a document by a bidirectional gated recurrent network over bytes.

A sequence is the bytes of a word (longer ones in pieces of at most SPAN bytes, cut between characters), so a network state never depends on where a chunk of
documents was cut, and each distinct word of a chunk is read once. Every byte gets a probability for each language from both directions' states; a document's
are the mean over all its bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import common as C
from millrace.llm import folds

SPAN = 24
HIDDEN = 16
#: Spans of a training step.
BATCH = 512


@dataclass
class Network:
    """For each direction d: table[d] byte -> gate inputs, back[d] state -> gates (reset, update, candidate); out: both states -> language scores."""

    table: np.ndarray  # 2, 257, 3 * hidden
    back: np.ndarray  # 2, hidden, 3 * hidden
    out: np.ndarray  # 2 * hidden, languages
    bias: np.ndarray
    langs: list[str]


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _step(x, h, u):
    """One step of a gated unit: x the byte's gate inputs, h the state before, u the recurrent weights."""
    n = h.shape[1]
    rz = _sigmoid(x[:, : 2 * n] + h @ u[:, : 2 * n])
    r, z = rz[:, :n], rz[:, n:]
    c = np.tanh(x[:, 2 * n :] + (r * h) @ u[:, 2 * n :])
    return h + z * (c - h), r, z, c


def _softmax(s):
    e = np.exp(s - s.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def read_words(net: Network, raw: np.ndarray, start: np.ndarray, end: np.ndarray, rows: int = 8192) -> np.ndarray:
    """Sums over each span's bytes of the languages' probabilities. Spans of one length go together, so nothing is padded."""
    size, n = end - start, net.back.shape[1]
    out = np.zeros((len(start), len(net.langs)), np.float32)
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.diff(size[order])) + 1
    for group in np.split(order, cuts):
        for at in range(0, len(group), rows):
            own = group[at : at + rows]
            t = int(size[own[0]]) if len(own) else 0
            if not t:
                continue
            b = raw[start[own][:, None] + np.arange(t)]
            states = np.empty((t, len(own), 2 * n), np.float32)
            for d, times in enumerate((range(t), range(t - 1, -1, -1))):
                h = np.zeros((len(own), n), np.float32)
                for i in times:
                    h = _step(net.table[d][b[:, i]], h, net.back[d])[0]
                    states[i, :, d * n : (d + 1) * n] = h
            out[own] = _softmax(states @ net.out + net.bias).sum(0)
    return out


def train(spans: list[bytes], label: np.ndarray, weight: np.ndarray, langs: list[str], steps: int = 500, batch: int = BATCH, rate: float = 0.01, seed: int = 3) -> Network:
    """Backpropagation through time with Adam. Spans are drawn by weight, languages alike often, and each byte's label is its span's."""
    rng = np.random.default_rng(seed)
    n, k = HIDDEN, len(langs)
    p = {"table": rng.normal(0, 0.3, (2, 257, 3 * n)), "back": rng.normal(0, 0.3, (2, n, 3 * n)), "out": rng.normal(0, 0.3, (2 * n, k)), "bias": np.zeros(k)}
    p = {a: v.astype(np.float32) for a, v in p.items()}
    m, v = ({a: np.zeros_like(x) for a, x in p.items()} for _ in range(2))
    size = np.fromiter(map(len, spans), np.int64, len(spans))
    data = np.full((len(spans), SPAN), 256, np.int64)
    for i, s in enumerate(spans):
        data[i, : len(s)] = list(s)
    odds = weight / np.maximum(np.bincount(label, weight, k), 1e-9)[label]
    draw = np.searchsorted(np.cumsum(odds) / odds.sum(), rng.random((steps, batch)))
    for step in range(steps):
        own = np.minimum(draw[step], len(spans) - 1)
        t = int(size[own].max())
        b, y = data[own, :t], label[own]
        real = (b < 256).astype(np.float32)
        trace, states = [], np.zeros((t, batch, 2 * n), np.float32)
        for d, times in enumerate((range(t), range(t - 1, -1, -1))):
            h, kept = np.zeros((batch, n), np.float32), []
            for i in times:
                after, r, z, c = _step(p["table"][d][b[:, i]], h, p["back"][d])
                mask = real[:, i : i + 1]
                kept.append((i, h, r, z, c, mask))
                h = h + mask * (after - h)
                states[i, :, d * n : (d + 1) * n] = h
            trace.append(kept)
        g = _softmax(states @ p["out"] + p["bias"])
        g[:, np.arange(batch), y] -= 1
        g *= (real.T / max(1.0, real.sum()))[:, :, None]
        grad = {"out": np.tensordot(states, g, ((0, 1), (0, 1))), "bias": g.sum((0, 1)), "table": np.zeros_like(p["table"]), "back": np.zeros_like(p["back"])}
        into = g @ p["out"].T
        for d in (0, 1):
            u, dh = p["back"][d], np.zeros((batch, n), np.float32)
            for i, h, r, z, c, mask in reversed(trace[d]):
                dh = dh + into[i, :, d * n : (d + 1) * n]
                own_dh = dh * mask
                dc = own_dh * z * (1 - c * c)
                dz = own_dh * (c - h) * z * (1 - z)
                drh = dc @ u[:, 2 * n :].T
                dr = drh * h * r * (1 - r)
                gates = np.concatenate((dr, dz, dc), 1)
                grad["back"][d][:, : 2 * n] += h.T @ gates[:, : 2 * n]
                grad["back"][d][:, 2 * n :] += (r * h).T @ dc
                hot = np.zeros((257, batch), np.float32)
                hot[b[:, i], np.arange(batch)] = 1
                grad["table"][d] += hot @ gates
                dh = dh * (1 - mask) + own_dh * (1 - z) + drh * r + gates[:, : 2 * n] @ u[:, : 2 * n].T
        lr = rate * min(1.0, 3 * (1 - step / steps))
        for a in p:
            m[a] = 0.9 * m[a] + 0.1 * grad[a]
            v[a] = 0.99 * v[a] + 0.01 * grad[a] ** 2
            p[a] -= (lr * (m[a] / (1 - 0.9 ** (step + 1))) / (np.sqrt(v[a] / (1 - 0.99 ** (step + 1))) + 1e-8)).astype(np.float32)
    return Network(p["table"], p["back"], p["out"], p["bias"], langs)


def spans_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, longer ones in pieces of at most SPAN bytes that do not cut characters, with their rows."""
    start, end, row = C.words(raw, off)
    step = SPAN - 3  # so much is sure to fit when a cut moves back to the start of a character
    parts = -(-(end - start) // step)
    if len(parts) and (end - start).max() > SPAN:
        parts = np.where(end - start > SPAN, parts, 1)
        which = np.repeat(np.arange(len(start)), parts)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
        cut = start[which] + step * nth
        for _ in range(3):
            cut = cut - ((nth > 0) & ((raw[cut] & 0xC0) == 0x80))
        last = np.append(which[1:] != which[:-1], True)
        start, end, row = cut, np.where(last, end[which], np.append(cut[1:], 0)), row[which]
    return start, end, row


def _count(batches):
    """(lang, piece, n): how often a chunk's rows of each language hold each piece."""
    for b in C.chunks(batches):
        raw, off = C.flat(b.column("text"))
        start, end, row = spans_of(raw, off)
        langs = b.column("lang").to_pylist()
        counts: dict[tuple[str, bytes], int] = {}
        data = raw.tobytes()
        for s, e, r in zip(start.tolist(), end.tolist(), row.tolist()):
            key = langs[r], data[s:e]
            counts[key] = counts.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.binary()), pa.array(list(counts.values()), pa.int64())], ["lang", "piece", "n"])


def fit(counts: list[tuple[str, bytes, int]], steps: int = 500) -> Network | None:
    """A network from (language, piece, how often it was drawn). None without any."""
    langs = sorted({lang for lang, _, _ in counts})
    if not counts:
        return None
    return train([p for _, p, _ in counts], np.array([langs.index(lang) for lang, _, _ in counts]), np.array([n for _, _, n in counts], float), langs, steps)


def drawn(pieces: DataFrame, draws: int) -> DataFrame:
    """(lang, piece, n) of `draws` draws with replacement from (lang, piece, n) counts, languages alike often and within one by the root of the count.

    Each piece is drawn as often as is expected of it, the rest of that decided by its hash; so every piece of every language can be drawn, however many there
    are, and about `draws` rows at most are left."""
    w = pieces.withColumn("w", F.sqrt(F.col("n").cast("double")))
    share = w.groupBy("lang").agg(F.sum("w").alias("_of"))
    odds = w.join(C.small(share), "lang").crossJoin(F.broadcast(share.agg(F.count("*").alias("_langs"))))
    mean = F.col("w") / F.col("_of") * (F.lit(float(draws)) / F.col("_langs"))
    unit = F.pmod(F.xxhash64("lang", "piece"), F.lit(1 << 30)) / float(1 << 30)
    return odds.select("lang", "piece", (F.floor(mean) + F.when(unit < mean - F.floor(mean), 1).otherwise(0)).alias("n")).where("n > 0")


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds_of: tuple[int, int] = (4, 2), sample: int = 1000, steps: int = 500) -> DataFrame:
    """Predicted language and its probability for every document.

    Learns from the text and non-null language of at most `sample` documents of each language outside the held-out fold, those with the least hashes of the id;
    of an id with several rows one of each language counts. All their words count; the driver gets those that training draws, as many as it takes steps of BATCH.
    `und` with score 0 is returned for a null text, one without a letter, and where nothing could be learned; of languages that score alike the first by name.
    Whole texts are read; repeated rows and null ids are carried along; further columns are not read. One pass without a shuffle.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    learn = d.where(~folds.held_out("doc_id", *folds_of) & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    # Twice the sample's share of the hashes is sure to hold the least ones, so no task ranks all ids of a language.
    ids = learn.select("doc_id", "lang").distinct()
    sizes = C.small(ids.groupBy("lang").agg(F.count("*").alias("_n")))
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    near = ids.join(sizes, "lang").withColumn("_u", unit).where(F.col("_u") * F.col("_n") <= 2 * sample + 50)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_u", "doc_id"))
    some = C.small(near.withColumn("rank", rank).where(F.col("rank") <= sample).select("doc_id", "lang"))
    texts = learn.join(some, ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    pieces = texts.select("lang", "text").mapInArrow(C.lean(_count), "lang string, piece binary, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    top = drawn(C.cut(pieces), steps * BATCH).collect()
    net = fit(sorted((r.lang, bytes(r.piece), r.n) for r in top), steps)

    def run(batches):
        for b in C.chunks(batches):
            raw, off = C.flat(b.column("text"))
            start, end, row = spans_of(raw, off)
            n = b.num_rows
            letters = C.per_row(row, n, np.add.reduceat(_LETTER[raw].astype(np.int64), start) if len(start) else np.zeros(0)) if len(start) else np.zeros(n)
            texts = b.column("text")
            has = [bool(x) or any(map(str.isalpha, texts[i].as_py() or "")) for i, x in enumerate(letters)]
            lang, score = ["und"] * n, np.zeros(n)
            if net and len(start):
                _, one, back = np.unique(C.span_hash(C.prefix_sums(raw), start, end), return_index=True, return_inverse=True)
                got = read_words(net, raw, start[one], end[one])[back]
                total = np.maximum(C.per_row(row, n, (end - start)), 1)
                p = np.stack([np.bincount(row, got[:, k], n) / total for k in range(len(net.langs))], 1)
                for i in np.flatnonzero(has):
                    k = int(p[i].argmax())
                    lang[i], score[i] = net.langs[k], min(1.0, float(p[i, k]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    got = d.select("doc_id", "text").mapInArrow(C.lean(run), "doc_id long, lang_pred string, score double")
    return got.select("doc_id", folds.held_out("doc_id", *folds_of).alias("held_out"), "lang_pred", "score")


_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
