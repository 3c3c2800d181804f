"""Incremental intake: paged feeds, inferred deletes, publication checks and contract rules as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pending_log(changes: DataFrame) -> DataFrame:
    """The last logged entry of each artifact: partition_key, external_id, seq, operation."""
    last = changes.groupBy("ref.partition_key", "ref.external_id").agg(F.max(F.struct("seq", "operation")).alias("_l"))
    return last.select("partition_key", "external_id", "_l.seq", "_l.operation")


def page_summary(changes: DataFrame) -> DataFrame:
    """Per page its changes, first and last position and partitions."""
    return changes.groupBy("page_no").agg(F.count(F.lit(1)).alias("n_changes"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count_distinct("ref.partition_key").alias("n_partitions"))


def inferred_deletes(known: DataFrame, seen: DataFrame, keys: list[str], scan_completed: bool, same_config: bool, confirmed: Column | None = None) -> DataFrame:
    """Known rows that a scan did not see and that are confirmed gone. Only a completed scan with the same configuration says anything."""
    if not (scan_completed and same_config):
        return known.where(F.lit(False))
    gone = known.join(seen.select(*keys).distinct(), keys, "left_anti")
    return gone if confirmed is None else gone.where(confirmed)


def reconcile_due(states: DataFrame, now_us: int, every_us: int = 86_400_000_000) -> DataFrame:
    """States (id, last_us) whose last full scan is missing or at least one interval ago."""
    return states.withColumn("due", F.coalesce(F.lit(now_us) - F.col("last_us") >= every_us, F.lit(True)))


def policy_refresh_due(policies: DataFrame, now_us: int) -> DataFrame:
    """A policy is refreshed once half of its life has passed."""
    return policies.withColumn("due", F.lit(now_us) >= F.col("verified_us") + F.floor((F.col("expires_us") - F.col("verified_us")) / 2))


def contract_violations(changes: DataFrame) -> DataFrame:
    """Rules that a batch of changes must keep, as rows (rule, n) of what breaks them; no row, no violation."""
    ref = F.col("ref")
    rules = {
        "partition_missing": ref["partition_key"].isNull(),
        "external_id_missing": ref["external_id"].isNull() | (F.trim(ref["external_id"]) == ""),
        "operation_unknown": ~F.coalesce(F.col("operation").isin("upsert", "delete", "policy_change"), F.lit(False)),
        "upsert_without_revision": (F.col("operation") == "upsert") & ref["provider_revision"].isNull(),
        "policy_change_without_policy": (F.col("operation") == "policy_change") & F.col("policy_id").isNull(),
        "ordinal_without_order": (F.col("provider_order.kind") == "monotonic") & F.col("provider_order.ordinal").isNull(),
        "order_without_ordinal": (F.col("provider_order.kind") != "monotonic") & F.col("provider_order.ordinal").isNotNull(),
        "received_missing": F.col("received_at").isNull(),
    }
    row = changes.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    return row.unpivot([], list(rules), "rule", "n").where("n > 0")


def publication_problems(members: DataFrame, tombstones: DataFrame, suppressed: DataFrame, epoch: int, current_epoch: int) -> DataFrame:
    """Why a generation may not be published: (id, reason) rows, and one row without id where the suppression epoch moved on."""
    moved = members.sparkSession.createDataFrame([(None, "epoch_moved")] if epoch != current_epoch else [], "id string, reason string")
    ids = members.select("id").distinct()
    dead = ids.join(tombstones.select("id"), "id", "left_semi").withColumn("reason", F.lit("tombstoned"))
    hidden = ids.join(suppressed.select("id"), "id", "left_semi").withColumn("reason", F.lit("suppressed"))
    return dead.unionByName(hidden).unionByName(moved)


def publish_outcome(previous: str | None, candidate: str, n_changes: int, published: set[str]) -> str:
    """published, already_current, already_published or no_changes."""
    if candidate == previous:
        return "already_current"
    if candidate in published:
        return "already_published"
    return "published" if n_changes else "no_changes"


def recovered_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs that were running when the process ended count as failed."""
    return jobs.withColumn("error", F.when(F.col("status").isin("indexing", "running"), F.lit("interrupted")).otherwise(F.col("error"))).withColumn(
        "status", F.when(F.col("status").isin("indexing", "running"), F.lit("failed")).otherwise(F.col("status"))
    )


def stale_views(views: DataFrame, epoch: int) -> DataFrame:
    """Views made under another authorisation epoch."""
    return views.where(F.col("authorization_epoch") != epoch)


def generation_counts(rows: DataFrame, kind: str, content: str) -> DataFrame:
    """Per representation its rows and an order-free checksum."""
    h = F.xxhash64(content)
    return rows.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("checksum"))
