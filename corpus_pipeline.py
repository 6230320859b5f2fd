"""Cleans the documents table in five stages. Each stage reads what its predecessor kept, written as Parquet and read again.

All stages but the last return the columns of documents; a stage that changes a text recounts n_chars. Null and empty texts pass through every stage, as does a row
without an id, which no stage rejects (only its passages are cut); further columns are carried along; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common as C
from millrace.llm.bpe import bpe
from millrace.llm.decontamination import decontaminate
from millrace.llm.near_dedup import near_dedup
from millrace.llm.quality_classifier import quality_classifier
from millrace.llm.queries import tokenizer_file
from millrace.llm.suffix_dedup import keyed, repeated_spans, without_spans


#: The session's setting of how many rows Python workers get at a time.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """From now on Python workers get at most so many rows at a time: whole documents are long, and executors hold a batch on both sides.

    A stage is computed when its result is written, so that the setting must outlast the stage's function; `run` restores it."""
    if not 0 < int(spark.conf.get(BATCH_ROWS)) <= rows:
        spark.conf.set(BATCH_ROWS, str(rows))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    small_batches(spark)
    rejected = quality_classifier(docs, C.table(spark, sf_dir, "labels")).where("predicted = 0 and doc_id is not null").select("doc_id").distinct()
    return C.only(docs, C.written(rejected, "rejected"), "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8. Of rows of one id with equal texts one stays; where an id has
    several texts, each of them stays or none."""
    small_batches(spark)
    copies = near_dedup(docs, shingle=5, threshold=80).where("not kept").select("doc_id").distinct()
    kept = C.only(docs, C.written(copies, "copies"), "left_anti")
    again = C.written(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    return C.only(kept, again, "left_anti").unionByName(C.only(kept, again).dropDuplicates(["doc_id", "text"]))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 200 bytes and more that stand twice; a document of which nothing else than white space is left goes. Documents that were blank before stay."""
    small_batches(spark)
    keys = keyed(docs, "doc_id", "text").select("t1", "t2", "text")
    return without_spans(docs, repeated_spans(keys), blank=False)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    small_batches(spark)
    found = decontaminate(docs, C.table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return C.only(docs, C.written(found, "leaks"), "left_anti")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with the digests of ids and decoded text. Workers hold less than alone, as the stages before have filled the executors."""
    small_batches(spark)
    return bpe(docs, tokenizer_file("word_bpe_49k.json"), with_ids=True, remembered=40_000, chunk=1 << 19)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", leaks),
    ("BPE encoding and decoding", tokens),
]

#: No SQL expresses the classifier; the run is tested stage by stage in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before, rows = C.table(spark, sf_dir, "documents"), C.scratch(), spark.conf.get(BATCH_ROWS)
    try:
        for name, stage in STAGES:
            docs = C.written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
            C.sweep(spark, before, keep=1)  # what the stage wrote on its way
    finally:
        spark.conf.set(BATCH_ROWS, rows)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
