"""Incremental forms of batch operators, for Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.aggregate import profile
from millrace.operators.monitor import control_chart, numeric_drift, ooc_summary, series_state


def resample_stream(df: DataFrame, date: str, freq: str, sensors: list[str], late: str = "10 minutes", groups: list[str] = ()) -> DataFrame:
    """Mean and deviation of each sensor by bins of event time; bins close once the watermark passes them. Also runs on a batch table."""
    aggs = [f(c).alias(f"{c}_{k}") for c in sensors for k, f in (("mean", F.avg), ("std", F.stddev))]
    return df.withWatermark(date, late).groupBy(*groups, F.window(date, freq)).agg(*aggs).withColumn(date, F.col("window.start")).drop("window")


def probe_stream(df: DataFrame, path: str, checkpoint: str, keep_ratio: float = 1.0, seed: int = 0) -> StreamingQuery:
    """Appends each batch's sample with its batch number; a batch that is tried again writes the same folder anew."""

    def keep(batch: DataFrame, number: int) -> None:
        kept = batch.sample(keep_ratio, seed + number) if keep_ratio < 1 else batch
        kept.withColumn("probe_ts", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(keep).trigger(availableNow=True).start()


def drift_stream(df: DataFrame, baseline: DataFrame, cols: list[str], path: str, checkpoint: str, threshold: float = 0.15) -> StreamingQuery:
    """Drift rows of each batch against a baseline profile."""

    def compare(batch: DataFrame, number: int) -> None:
        numeric_drift(baseline, profile(batch, cols), threshold).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(compare).trigger(availableNow=True).start()


def control_stream(df: DataFrame, order: str, cols: list[str], limits: DataFrame, path: str, checkpoint: str, group: list[str] = ()) -> StreamingQuery:
    """Control charts of a live feed: each batch's values outside given limits with the running share of their series, and its summary by series.

    The share runs on over all batches: what the series have had so far is a small table that each batch reads from the one before it and leaves for the
    next, under its own number. So a batch that is tried again starts from the same state, and writes points, summary and state anew. Within a batch points
    count in order; a point that comes in a later batch counts there."""
    group = list(group)

    def watch(batch: DataFrame, number: int) -> None:
        before = batch.sparkSession.read.parquet(f"{path}/state/batch={number - 1}") if number else None
        chart = control_chart(batch, order, cols, group, limits, before).cache()
        chart.where("ooc = 1").write.mode("overwrite").parquet(f"{path}/points/batch={number}")
        ooc_summary(chart, order, group).write.mode("overwrite").parquet(f"{path}/summary/batch={number}")
        series_state(chart, group, before).write.mode("overwrite").parquet(f"{path}/state/batch={number}")
        chart.unpersist()

    return df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(watch).trigger(availableNow=True).start()
