"""Operator 8: toxicity of a document by compression distance.

Two dictionaries are trained by zstandard: one on windows of ordinary text, one on windows of toxic text. Only few windows of a toxic document are toxic, so the
second learns from those that hold a word which recurs in toxic documents and is rare in ordinary ones; without that choice the trainer picks the syllables
that all text has. Windows of a text are compressed with the ordinary dictionary alone and with the toxic one laid over it; how many bytes
that saves, at most, on the average and how often, is calibrated on labelled documents that trained neither.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common as C
from millrace.llm import folds

#: Words of a window that is compressed, of a window that trains the toxic dictionary, and a window's gain that counts as a find.
WINDOW, SPAN, FIND = 12, 2, 3
#: Bytes of the two dictionaries.
TOXIC, ORDINARY = 2048, 32_768
FEATURES = 7


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    """Matches of five bytes and more; no header fields, so that lengths differ by content alone."""
    level = zstandard.ZstdCompressionParameters(window_log=17, hash_log=16, chain_log=16, search_log=4, min_match=5, target_length=32, strategy=zstandard.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0)
    words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(compression_params=level)
    return zstandard.ZstdCompressor(dict_data=words, compression_params=level)


def measure(toxic: zstandard.ZstdCompressor, ordinary: zstandard.ZstdCompressor, texts: list[str | None]) -> np.ndarray:
    """What the toxic dictionary saves on each text's windows: most, mean of the two and the four largest, mean, share and number of finds, and length."""
    raw, off = C.flat(pa.array([(t or "").lower() for t in texts], pa.string()))
    start, end, row = C.words(raw, off)
    bounds = np.searchsorted(row, np.arange(len(texts) + 1))
    data, out = raw.tobytes(), np.zeros((len(texts), FEATURES))
    a, b = toxic.compress, ordinary.compress
    for i, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        if lo == hi:
            continue
        first = np.arange(lo, hi, WINDOW)
        windows = [b" " + data[s:e] + b" " for s, e in zip(start[first].tolist(), end[np.minimum(first + WINDOW, hi) - 1].tolist())]
        gain = np.sort([len(b(w)) - len(a(w)) for w in windows])[::-1]
        finds = (gain >= FIND).sum()
        out[i] = gain[0], gain[:2].mean(), gain[:4].mean(), gain.mean(), finds / len(gain), np.log1p(finds), np.log(len(gain))
    return out


@dataclass
class Calibration:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(np.column_stack((np.ones(len(z)), z, np.square(z[:, :5]))) @ self.weight, -30, 30)))


def calibrate(x: np.ndarray, y: np.ndarray, rounds: int = 30, penalty: float = 0.3) -> Calibration:
    """Penalised logistic regression on the measures and squares of five of them, by Newton steps."""
    c = Calibration(x.mean(0), x.std(0) + 1e-6, np.zeros(FEATURES + 6))
    z = (x - c.mean) / c.scale
    z = np.column_stack((np.ones(len(z)), z, np.square(z[:, :5])))
    for _ in range(rounds):
        p = c.score(x)
        h = (z * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ z + penalty * np.eye(z.shape[1])
        step = np.linalg.solve(h, z.T @ (p - y) + penalty * c.weight)
        c.weight = c.weight - step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
    return c


def trained(windows: list[str], size: int) -> bytes:
    """A dictionary by zstandard's trainer; the windows themselves where they are too few to train on."""
    samples = [f" {w} ".encode() for w in windows]
    try:
        return zstandard.train_dictionary(size, samples, k=24, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _windows(texts: DataFrame, size: int) -> DataFrame:
    """(k, i, words): the words of each text in windows of `size`."""
    words = F.filter(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    at = F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(size)), lambda i: F.slice("w", i + 1, size))).alias("i", "words")
    return texts.withColumn("w", words).where(F.size("w") > 0).select("k", at)


def _all(windows: DataFrame) -> list[str]:
    """The windows in a fixed order, mixed by hash. They are those of a sample of rows, as the trainer works on one machine."""
    return [r.x for r in windows.select("k", "i", F.concat_ws(" ", "words").alias("x")).orderBy(F.xxhash64("k", "i"), "k", "i").collect()]


def dictionaries(learn: DataFrame) -> tuple[bytes, bytes] | None:
    """The toxic dictionary over the ordinary one, and the ordinary one, from (text, label) rows, a sample of bounded size, whose windows reach the driver."""
    texts = C.cut(learn.groupBy(F.md5(F.col("text").cast("binary")).alias("k")).agg(F.min("text").alias("text"), F.max("label").alias("label")))
    n = {r.label: r.n for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return None
    words = texts.select("label", F.explode(F.array_distinct(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"))).alias("w")).where("w <> ''")
    counts = C.cut(words.groupBy("w").agg(F.sum("label").alias("t"), F.count("*").alias("n")))
    # A likelihood ratio that no word would reach by chance, however many there are.
    share, n_words = n[1] / (n[0] + n[1]), counts.count()
    part = lambda x, p: F.when(x > 0, x * F.log(x / (F.col("n") * p))).otherwise(0.0)
    ratio = part(F.col("t"), share) + part(F.col("n") - F.col("t"), 1 - share)
    telling = counts.where((F.col("t") > share * F.col("n")) & (ratio > float(np.log(n_words)) if n_words else F.lit(False))).select("w")
    toxic = _windows(texts.where("label = 1"), SPAN)
    toxic = toxic.withColumn("w", F.explode("words")).join(telling, "w", "left_semi").drop("w").distinct()
    ordinary = trained(_all(_windows(texts.where("label = 0"), WINDOW)), ORDINARY)
    return trained(_all(toxic), TOXIC) + ordinary, ordinary


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds_of: tuple[int, int] = (4, 2), sample: int = 9000, threshold: float = 0.3) -> DataFrame:
    """Toxicity score of every document, whether it is in the held-out fold, and the prediction at the threshold.

    Learns from at most `sample` labelled documents of each label outside the held-out fold, spread evenly by a hash of the id: three fifths train the
    dictionaries (all their windows; TOXIC and ORDINARY bytes), the rest the calibration. Of an id with several texts the least is learned from, and an
    id that has both labels counts as toxic. Without two classes to learn from, every score is the share of label 1 (0 without labels). A null or
    empty text is scored as one without windows; whole texts are read; repeated rows and null ids are carried along; further columns are not read.
    """
    d = C.id_text(docs, id_col, text_col)
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~folds.held_out("doc_id", *folds_of))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    some = folds.sample_ids(known.where("label = 1"), sample).unionByName(folds.sample_ids(known.where("label = 0"), sample))
    learn = d.where("text is not null").join(F.broadcast(some), "doc_id")
    learn = C.written(learn.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")), "toxicity-sample")
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(5))
    pair, model = dictionaries(learn.where(part < 3)), None
    if pair:

        def gather(batches):
            a, b = map(compressor, pair)
            for x in C.chunks(batches):
                yield pa.RecordBatch.from_arrays([x.column("doc_id"), x.column("label"), pa.array(measure(a, b, x.column("text").to_pylist()).tolist(), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

        rows = learn.where(part >= 3).mapInArrow(C.lean(gather), "doc_id long, label int, x array<double>").collect()
        rows.sort(key=lambda r: (r.doc_id, r.label))
        # Classes are drawn apart, so each row counts as often as its class is among all labels.
        total = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
        y = np.array([r.label for r in rows], float)
        if 0 < y.sum() < len(y):
            model = calibrate(np.array([r.x for r in rows]), y)
            model.weight[0] += np.log(total[1] / total[0]) - np.log(y.sum() / (len(y) - y.sum()))
    alike = 0.0 if model else float(known.agg(F.avg("label")).first()[0] or 0.0)

    def run(batches):
        if model:
            a, b = map(compressor, pair)
        for x in C.chunks(batches):
            p = model.score(measure(a, b, x.column("text").to_pylist())) if model else np.full(x.num_rows, alike)
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    got = d.mapInArrow(C.lean(run), "doc_id long, score double")
    return got.select("doc_id", folds.held_out("doc_id", *folds_of).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
