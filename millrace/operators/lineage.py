"""Cutting lineage with reliable checkpoints, so that what was computed once is not computed again with other partitions or order."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Only a local session may lack the setting; it gets a folder of its own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="millrace-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, rows: int = 50_000, by: tuple[str, ...] = ()) -> DataFrame:
    """df dealt anew into parts of some `rows` rows at most, and at least four for each core: for work that costs far more than reading a row, where the few
    splits of a small file would leave cores idle. To be called while rows are narrow, as all of them are shuffled; they are counted first. Dealt by a key, rows
    of one key are in one part, and what is grouped by the key later is not shuffled again."""
    return df.repartition(max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)), *by)


#: Rows that a task keeps in memory at a time.
HELD_ROWS = 500_000


def parts(df: DataFrame, rows: int = HELD_ROWS) -> int:
    """Into how many parts to deal df so that each has some `rows` rows, one for each core at least. The table is counted."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
