"""Structured Streaming forms: windowed request rates, deduplicating ingest, budgets, resumable stages, betting processes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def request_rates(events: DataFrame, ts: str, key: str, window: str = "60 seconds", late: str | None = "10 minutes") -> DataFrame:
    """start, key, n in tumbling windows; on streams, rows later than the watermark are dropped."""
    df = events.withWatermark(ts, late) if events.isStreaming and late else events
    return df.groupBy(F.window(ts, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def distinct_ingest(rows: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """Rows with a key not seen within the watermark; state stays bounded."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark([key]) if rows.isStreaming else rows.dropDuplicates([key])


def within_budget(log: DataFrame, run: str, order: list[str], cost: str, budget: int) -> DataFrame:
    """The requests of each run before its running cost exceeds the budget."""
    used = F.sum(F.coalesce(cost, F.lit(0))).over(W.partitionBy(run).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return log.withColumn("used", used).where(F.col("used") <= budget)


def todo(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work without a terminal record: the resume step of a restarted stage."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def upsert_stream(stream: DataFrame, target: str, key: str, checkpoint: str, available_now: bool = True):
    """Appends rows whose key the target lacks, batch by batch; a replayed batch adds nothing twice."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key])
        try:
            new = new.join(spark.read.parquet(target).select(key), key, "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new.write.mode("append").parquet(target)

    w = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def running_totals(stream: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, total, highest per key over the life of a stream, with explicit state that survives restarts."""

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, high = state.get if state.exists else (0, 0.0, float("-inf"))
        for f in frames:
            v = f[value].dropna()
            n, total, high = n + len(v), total + float(v.sum()), max(high, float(v.max()) if len(v) else high)
        state.update((n, total, high))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total], "highest": [high]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n long, total double, highest double", "n long, total double, highest double", "update", GroupStateTimeout.NoTimeout)


def read_stream(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
