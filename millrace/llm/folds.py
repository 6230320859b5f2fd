"""Held-out folds by a checksum of the id, and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """True where crc32 of the id as text leaves `fold` modulo `folds`; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def sample_ids(ids: DataFrame, most: int) -> DataFrame:
    """At most `most` rows, those with the least hash of doc_id: spread evenly, the same on every run, and bounded, so that they may be broadcast."""
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
