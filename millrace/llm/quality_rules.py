"""Operator 1: weak supervision over document-quality rules.

Each rule votes good (1), bad (0) or abstains (-1). The votes of a document are the only evidence; expectation-maximisation over the table of
distinct vote patterns estimates the share of good documents and each rule's two accuracies, among good documents and among bad ones, and a
document's verdict is its posterior probability. With two accuracies, a vote that good documents hardly ever get outweighs many that bad ones get too.
No rule restates the base rule (few words, repeated windows), which is judged apart.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import common as C

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_distinct_words", "n_closed", "n_alpha_words", "n_plain_words", "n_word_letters")
_LOWER, _UPPER, _BEYOND = bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(0xC0, 0x100))
#: Bytes by kind. Every character outside ASCII counts as a letter, by its lead byte.
_IS = {k: np.isin(np.arange(256), list(v)) for k, v in {"symbol": b"#*$%&|<>", "close": b".?!:;\"'", "upper": _UPPER, "lower": _LOWER, "letter": _LOWER + _UPPER + _BEYOND, "plain": _LOWER + _UPPER + bytes(range(0x80, 0x100)) + b"0123456789.?!:;,\"')"}.items()}


def _measure(batches):
    for b in C.chunks(batches):
        raw, off = C.flat(b.column("text"))
        n = b.num_rows
        start, end, row = C.words(raw, off)
        sums = C.prefix_sums(raw)
        h = C.span_hash(sums, start, end)
        salt = C.mix(np.arange(n, dtype=np.uint64) + np.uint64(1))

        def seen(mask, raw=raw, off=off):
            total = np.concatenate(([0], np.cumsum(mask[raw])))
            return total[off[1:]] - total[off[:-1]]

        lead = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # code points before each byte
        out = {"n_words": C.per_row(row, n), "word_chars": C.per_row(row, n, lead[end] - lead[start]).astype(np.int64)}
        # Words in windows of three that occur twice or more in the same text.
        marked = np.zeros(len(h), bool)
        if len(h) > 2:
            inside = row[2:] == row[:-2]
            key = C.mix(h[:-2] + C.mix(h[1:-1] + C.mix(h[2:] + np.uint64(3)))) ^ salt[row[2:]]
            at = np.flatnonzero(inside)
            again = at[C.repeated(key[at])]
            for step in range(3):
                marked[again + step] = True
        out["n_repeat_words"] = C.per_row(row[marked], n)
        out["n_distinct_words"] = C.per_row(row[np.unique(h ^ salt[row], return_index=True)[1]], n) if len(h) else np.zeros(n, np.int64)
        # Lines: pieces between \n within a row, those with a word only.
        breaks = np.flatnonzero(raw == 10)
        first = np.sort(np.concatenate((off[:-1][np.diff(off) > 0], breaks + 1)))
        first = np.unique(first[first < len(raw)]) if len(raw) else first[:0]
        line_row = np.searchsorted(off, first, "right") - 1
        stop = np.minimum(np.append(first[1:], len(raw)), off[line_row + 1])
        stop = np.where((stop > first) & (raw[np.maximum(stop - 1, 0)] == 10), stop - 1, stop) if len(first) else stop
        has = np.searchsorted(start, stop) > np.searchsorted(start, first)
        first, stop, line_row = first[has], stop[has], line_row[has]
        key = C.span_hash(sums, first, stop) ^ salt[line_row]
        out["n_lines"] = C.per_row(line_row, n)
        once = np.unique(key, return_index=True)[1]
        out["n_dup_lines"] = out["n_lines"] - C.per_row(line_row[once], n)
        tail = end[np.searchsorted(start, stop) - 1] - 1 if len(first) else first
        out["n_closed"] = C.per_row(line_row[_IS["close"][raw[tail]]], n) if len(first) else np.zeros(n, np.int64)
        out["n_symbols"], out["n_upper"] = seen(_IS["symbol"]), seen(_IS["upper"])
        out["n_letters"] = out["n_upper"] + seen(_IS["lower"])
        out["n_word_letters"] = seen(_IS["letter"])
        letters = np.concatenate(([0], np.cumsum(_IS["letter"][raw])))
        out["n_alpha_words"] = C.per_row(row[letters[end] > letters[start]], n)
        out["n_plain_words"] = C.per_row(row[_IS["plain"][raw[end - 1]]], n)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pc.is_null(b.column("text")), *(pa.array(out[k], pa.int64()) for k in _COUNTS)], ["doc_id", "no_text", *_COUNTS])


def measure(docs: DataFrame) -> DataFrame:
    """The counts of each document that the rules read, in one pass over the text without a shuffle."""
    schema = "doc_id long, no_text boolean, " + ", ".join(f"{k} long" for k in _COUNTS)
    return docs.mapInArrow(C.lean(_measure), schema)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, 0).when(good, 1).otherwise(-1)


def rules() -> dict[str, Column]:
    """The rules by name, each a vote over the counts. Ratios compare products, so no count of zero divides."""
    c = F.col
    w, some, chars = c("n_words"), c("n_words") > 0, c("word_chars")
    return {
        "word_length": _vote((chars >= 3 * w) & (chars <= 9 * w) & some, (chars < 2.5 * w) | (chars > 12 * w)),
        "symbols": _vote((100 * c("n_symbols") < w) & some, 10 * c("n_symbols") > w),
        "dup_lines": _vote((c("n_dup_lines") == 0) & (c("n_lines") > 1), 10 * c("n_dup_lines") > 3 * c("n_lines")),
        "upper": _vote((100 * c("n_upper") < 15 * c("n_letters")), 100 * c("n_upper") > 50 * c("n_letters")),
        "distinct": _vote(100 * c("n_distinct_words") > 35 * w, 100 * c("n_distinct_words") < 15 * w),
        "endings": _vote((2 * c("n_closed") >= c("n_lines")) & (c("n_lines") > 0), (10 * c("n_closed") < c("n_lines")) & (c("n_lines") > 3)),
        "letters": _vote((100 * c("n_word_letters") >= 85 * chars) & some, 100 * c("n_word_letters") < 75 * chars),
        "alpha_words": _vote((10 * c("n_alpha_words") >= 9 * w) & some, 10 * c("n_alpha_words") < 8 * w),
        "plain_words": _vote((10 * c("n_plain_words") >= 9 * w) & some, 10 * c("n_plain_words") < 8 * w),
    }


@dataclass
class Fit:
    """share of good documents; of each rule's votes on good documents the share that says good, and of those on bad documents the share that says bad."""

    share: float
    on_good: np.ndarray
    on_bad: np.ndarray

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """What a good and what a bad vote of each rule adds to the log odds."""
        return np.log(self.on_good / (1 - self.on_bad)), np.log((1 - self.on_good) / self.on_bad)

    def odds(self) -> float:
        return float(np.log(self.share / (1 - self.share)))


def fit(patterns: np.ndarray, weight: np.ndarray, rounds: int = 100) -> Fit:
    """The model by EM. patterns: one row of votes (-1, 0, 1) for each distinct pattern; weight: its documents.

    It begins with four fifths of the documents good, rules right in nine of ten votes on good ones and in half of those on bad ones, and so finds the
    solution in which votes for bad are rare among good documents. One vote with these accuracies is added to each rule's; a rule that never votes keeps them.
    """
    cast, good = patterns >= 0, patterns == 1
    m = Fit(0.8, np.full(patterns.shape[1], 0.9), np.full(patterns.shape[1], 0.5))
    total = weight.sum()
    for _ in range(rounds if total else 0):
        p = posterior(patterns, m) * weight
        q = weight - p
        m = Fit(float((p.sum() + 0.8) / (total + 1)), (p @ good + 0.9) / (p @ cast + 1), (q @ (cast & ~good) + 0.5) / (q @ cast + 1))
    return m


def posterior(patterns: np.ndarray, m: Fit) -> np.ndarray:
    good, bad = m.weights()
    return 1 / (1 + np.exp(-(m.odds() + np.where(patterns == 1, good, np.where(patterns == 0, bad, 0)).sum(1))))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Counts, votes, posterior and verdict of every document.

    A null or empty text has no words and fails the base rule; a repeated row is judged like any other; a null id is carried along; an empty table gives
    an empty result. Only the id and the text are read, so further columns do no harm. The table of vote patterns has at most 3 ** rules rows,
    whatever the number of documents, and is all that reaches the driver.
    """
    votes = rules()
    seen = C.written(measure(C.id_text(docs, id_col, text_col)), "quality-rules").withColumns({f"vote_{k}": v.cast("int") for k, v in votes.items()})
    names = [f"vote_{k}" for k in votes]
    table = seen.groupBy(*names).count().collect()
    order = sorted(range(len(table)), key=lambda i: tuple(table[i][k] for k in names))  # sums do not depend on the order of arrival
    m = fit(np.array([[table[i][k] for k in names] for i in order], int).reshape(-1, len(names)), np.array([table[i]["count"] for i in order], float))
    odds = reduce(lambda a, b: a + b, (F.when(F.col(k) == 1, float(g)).when(F.col(k) == 0, float(b)).otherwise(0.0) for k, g, b in zip(names, *m.weights())), F.lit(m.odds()))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return seen.withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality") >= threshold))
