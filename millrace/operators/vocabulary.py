"""Bags of words and tf-idf weights over a fitted vocabulary: every text is cut into terms once, whatever the vocabulary's size."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.steps import Fit, Step

#: Cells of a dense table that a task fills at a time.
_CELLS = 1 << 22
#: Bytes of text that a task cuts into terms at a time; it bounds a worker's memory, not the work.
_CHUNK_BYTES = 2 << 20
#: What stands between terms.
_GAPS = r"[^\p{L}\p{N}_]+"


def _terms(text: pa.Array) -> pa.ListArray:
    """The terms of lower-case texts, those of functions.text.terms: runs of two and more letters, digits and underscores; none in a null text."""
    lists = pc.split_pattern_regex(text, _GAPS)
    flat = lists.flatten()
    long = pc.greater(pc.utf8_length(flat), 1)
    row = pc.list_parent_indices(lists).to_numpy()[long.to_numpy(zero_copy_only=False)]
    ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(text)))))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat.filter(long))


def _pieces(b: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of some _CHUNK_BYTES of text, a single longer text whole; memory is given back after each batch."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // _CHUNK_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), b.num_rows]
    for lo, hi in zip(cuts, cuts[1:]):
        yield b.slice(lo, hi - lo)
    pa.default_memory_pool().release_unused()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n, held) of each batch: how often a term stands in its texts, and in how many of them."""
    for b in (piece for whole in batches for piece in _pieces(whole, 0)):
        lists = _terms(b.column("text"))
        flat = pc.dictionary_encode(lists.flatten())
        if len(flat):
            code, row, size = flat.indices.to_numpy(), pc.list_parent_indices(lists).to_numpy(), len(flat.dictionary)
            held = np.bincount(np.unique(row.astype(np.int64) * size + code) % size, minlength=size)
            yield pa.RecordBatch.from_arrays([flat.dictionary, pa.array(np.bincount(code, minlength=size)), pa.array(held)], ["term", "n", "held"])


def term_counts(df: DataFrame, text: str) -> DataFrame:
    """(term, n, held) over all texts; terms of a batch are summed up before they are shuffled."""
    some = df.select(F.lower(text).alias("text")).mapInArrow(_counted, "term string, n long, held long")
    return some.groupBy("term").agg(F.sum("n").alias("n"), F.sum("held").alias("held"))


def _top(df: DataFrame, text: str, most: int) -> list:
    """The `most` most frequent terms, ties by the alphabet, in alphabetical order."""
    return sorted(term_counts(df, text).orderBy(F.desc("n"), "term").limit(most).collect(), key=lambda r: r.term)


def _weights(vocabulary: list[str], weight, kind: pa.DataType, sparse: bool):
    """The rows of a batch with the weights of their known terms: `weight` takes the rows, the terms' numbers and their counts, sorted by row and number."""

    def run(batches: Iterator[pa.RecordBatch]):
        known, size = pa.array(vocabulary, pa.string()), len(vocabulary)
        step = max(1, _CELLS // max(1, size)) if not sparse else 1 << 14
        for whole in (piece for b in batches for piece in _pieces(b, 1)):
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                lists = _terms(b.column(1))
                code = pc.index_in(lists.flatten(), value_set=known)
                found = code.is_valid().to_numpy(zero_copy_only=False)
                key = pc.list_parent_indices(lists).to_numpy()[found].astype(np.int64) * size + code.to_numpy(zero_copy_only=False)[found].astype(np.int64)
                key, n = np.unique(key, return_counts=True)
                row, term = key // max(1, size), key % max(1, size)
                w = weight(b.num_rows, row, term, n)
                if sparse:
                    ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=b.num_rows)))).astype(np.int32))
                    made = [pa.ListArray.from_arrays(ends, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(w, kind))]
                    yield pa.RecordBatch.from_arrays([b.column(0), *made], [b.schema.names[0], "indices", "values"])
                else:
                    table = np.zeros((size, b.num_rows), w.dtype)
                    table[term, row] = w
                    yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, kind) for c in table)], [b.schema.names[0], *vocabulary])

    return run


def _transformed(df: DataFrame, key: str, text: str, vocabulary: list[str], weight, kind: tuple, sparse: bool) -> DataFrame:
    schema = T.StructType([df.schema[key]])
    for name in ("indices", "values") if sparse else vocabulary:
        schema = schema.add(name, kind[0] if not sparse else T.ArrayType(T.IntegerType() if name == "indices" else kind[0]))
    return df.select(key, F.lower(text).alias("_text")).mapInArrow(_weights(vocabulary, weight, kind[1], sparse), schema)


class BagOfWordsModel(Step):
    def apply(self, df, key, text, vocabulary, max_features=100, sparse=False):
        return _transformed(df, key, text, vocabulary, lambda rows, row, term, n: n, (T.LongType(), pa.int64()), sparse)


class BagOfWords(Fit):
    """A column of counts for each of the max_features most frequent terms, ties by the alphabet, columns in alphabetical order. Each row is counted where it
    lies, without a shuffle; a null text has zeros. With `sparse` a row has the numbers of its terms (indices) and their counts (values) instead, for
    vocabularies too large for columns."""

    step = BagOfWordsModel

    def learn(self, df, key, text, max_features=100, sparse=False):
        return {"vocabulary": [r.term for r in _top(df, text, max_features)]}


class TfIdfModel(Step):
    def apply(self, df, key, text, vocabulary, idf, max_features=100, sparse=False):
        scale = np.array(idf, float)

        def weight(rows, row, term, n):
            w = (1 + np.log(n)) * scale[term]
            return w / np.sqrt(np.bincount(row, w * w, minlength=rows))[row] if len(w) else w

        return _transformed(df, key, text, vocabulary, weight, (T.DoubleType(), pa.float64()), sparse)


class TfIdf(Fit):
    """(1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), rows scaled to length 1, over the vocabulary of BagOfWords, each row where it lies. `sparse` as there."""

    step = TfIdfModel

    def learn(self, df, key, text, max_features=100, sparse=False):
        top, n = _top(df, text, max_features), df.count()
        return {"vocabulary": [r.term for r in top], "idf": [math.log((1 + n) / (1 + r.held)) + 1 for r in top]}
