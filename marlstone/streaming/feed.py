"""Streaming intake of a change feed: the log grows by micro-batches, the current state is rebuilt from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import change_feed


def start(changes: DataFrame, log_path: str, checkpoint: str):
    """Appends each micro-batch to the log under its own number; a repeated batch overwrites itself."""
    def append(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log_path}/batch={epoch}")

    return changes.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_state(spark: SparkSession, log_path: str) -> DataFrame:
    """Artifacts alive after all logged changes."""
    log = spark.read.parquet(log_path)
    if "ref" not in log.columns:
        log = log.select(
            "seq", F.struct("partition_key", F.lit(None).cast("string").alias("artifact_kind"), "external_id", "provider_revision").alias("ref"), "operation", "policy_id",
            F.struct(F.lit("feed").alias("adapter"), F.lit(None).cast("string").alias("kind"), "ordinal").alias("provider_order"),
        )
    return change_feed.alive_artifacts(log)
