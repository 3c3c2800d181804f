"""Streaming form of the late-event counters: each micro-batch leaves a state of cells, states merge idempotently."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import late_events
from marlstone.operators.late_events import LatenessPolicy


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole versions below a folder: a job marks each as done when all of it is written."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def start(claims: DataFrame, state_path: str, checkpoint: str):
    """Writes the merged cells of each micro-batch as one part, ``state_path``/v=N.

    Parts only ever grow in number; a batch that is delivered again overwrites its own part, and since merging takes
    the greatest version of a writer, overlapping or reordered batches change nothing. ``claims`` is a streaming table with event_id,
    source_id, content_hash, valid_from and recorded_from.
    """
    def keep(batch: DataFrame, epoch: int) -> None:
        late_events.merge_cells(late_events.delivered_cells(batch)).write.mode("overwrite").parquet(f"{state_path}/v={epoch}")

    return claims.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cells(spark: SparkSession, state_path: str) -> DataFrame:
    """All whole parts merged: one cell per event."""
    return late_events.merge_cells(*[spark.read.parquet(f"{state_path}/v={v}") for v in _versions(spark, state_path)])


def compact(spark: SparkSession, state_path: str, into: str) -> None:
    """Writes the merged cells as the single part of a new folder, for a stream that is started anew on it."""
    cells(spark, state_path).write.mode("overwrite").parquet(f"{into}/v=0")


def publish(spark: SparkSession, state_path: str, counts_path: str, policy: LatenessPolicy = LatenessPolicy()) -> None:
    """Sums the cells that are there into counters under the number of parts they come from; to publish the same parts again overwrites the same counters."""
    sequence = len(_versions(spark, state_path))
    late_events.counters(cells(spark, state_path), sequence, policy).write.mode("overwrite").parquet(f"{counts_path}/v={sequence}")


def read(spark: SparkSession, counts_path: str) -> DataFrame:
    """Corrected counts per period and source from all publications, in whatever order they were made."""
    parts = [spark.read.parquet(f"{counts_path}/v={v}") for v in _versions(spark, counts_path)]
    return late_events.read_counters(late_events.merge_counters(*parts))


def windowed_counts(events: DataFrame, period: str = "1 day", lateness: str = "3 days") -> DataFrame:
    """The plain engine form: event-time windows closed by a watermark; late rows past it are dropped by the engine."""
    return events.withWatermark("valid_from", lateness).groupBy(F.window("valid_from", period), "source_id").agg(F.count(F.lit(1)).alias("n"))
