"""Keyed lookups, upserts, de-duplication, ranking and budget cuts over plain tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.plans.skew import running_sum


def lookup_in_order(table: DataFrame, key: str, ids: Sequence) -> DataFrame:
    """Rows of the asked ids with ``pos``, their place in the list; unknown ids give nothing, repeated ones their row again."""
    asked = table.sparkSession.createDataFrame([(i, v) for i, v in enumerate(ids)], f"pos int, {key} {table.schema[key].dataType.simpleString()}")
    return asked.join(table, key).orderBy("pos")


def page(table: DataFrame, order: Sequence[str], limit: int, offset: int = 0, most: int = 100) -> DataFrame:
    """One page of a sorted table; the limit is kept within 0..most, the offset at 0 or more."""
    return table.orderBy(*order).offset(max(0, offset)).limit(max(0, min(limit, most)))


def substring_search(names: DataFrame, mentions: DataFrame, needle: str, limit: int = 25) -> DataFrame:
    """Names (id, name) that contain the needle, most mentioned first, then by name."""
    hits = names.where(F.contains("name", F.lit(needle)))
    counted = mentions.join(hits.select("id"), "id", "left_semi").groupBy("id").agg(F.count_distinct("passage_id").alias("passage_count"))
    found = hits.join(counted, "id", "left").withColumn("passage_count", F.coalesce("passage_count", F.lit(0)))
    return found.orderBy(F.desc("passage_count"), "name", "id").limit(limit)


def new_rows(incoming: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows whose key is not stored yet, one per key."""
    return incoming.dropDuplicates(list(keys)).join(stored.select(*keys), list(keys), "left_anti")


def upsert(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows as they are and the new ones; adding the same rows again changes nothing."""
    return stored.unionByName(new_rows(incoming, stored, keys).select(*stored.columns))


def best_pairs(pairs: DataFrame) -> DataFrame:
    """Undirected scored pairs (a, b, score, manual): one row per pair with a < b, the best score, manual if any was."""
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    return pairs.where("a <> b").groupBy(lo.alias("a"), hi.alias("b")).agg(F.max("score").alias("score"), F.bool_or("manual").alias("manual"))


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key. Taken as a minimum, so that it combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    least = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_r"))
    return least.select(*[c if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def ranked(df: DataFrame, order: Sequence[Column | str], by: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """Adds 1-based ranks inside ``by``; without ``by`` over the table (one task then sorts it: use ``top`` for a few)."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return df.withColumn(out, F.row_number().over(w.orderBy(*order)))


def top(df: DataFrame, order: Sequence[Column | str], k: int, by: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """The first k rows with their rank; over the whole table only k rows of each partition travel."""
    if by:
        return ranked(df, order, by, out).where(F.col(out) <= k)
    return ranked(df.orderBy(*order).limit(k), order, (), out)


def round_robin(df: DataFrame, seed: str, order: Sequence[Column | str], item: str) -> DataFrame:
    """One item per seed and turn; an item counts where it comes first. Columns: turn, seed, item."""
    turned = ranked(df, order, [seed], "turn")
    first = turned.groupBy(item).agg(F.min(F.struct("turn", seed)).alias("_s"))
    return first.select("_s.turn", F.col(f"_s.{seed}").alias(seed), item)


def tiered_interleave(df: DataFrame, group: str, omega: str, direction: str, name: str) -> DataFrame:
    """Position of each row: tiers of equal weight (4 digits) from the best down; inside a tier in and out take turns, in first."""
    tier = df.withColumn("tier", F.round(omega, 4))
    turn = F.row_number().over(Window.partitionBy(group, "tier", direction).orderBy(name))
    out = tier.withColumn("turn", turn)
    place = Window.partitionBy(group).orderBy(F.desc("tier"), "turn", F.when(F.col(direction) == "in", 0).otherwise(1), name)
    return out.withColumn("position", F.row_number().over(place))


def prefix_cut(df: DataFrame, by: Sequence[str], bucket: Column, order: Sequence[str], text: str, budget: int) -> DataFrame:
    """The longest prefix of lines that fits the budget (one character between lines); all after the first that overflows go. ``bucket``: a
    coarse value that does not fall along the order, by which long groups are summed in parts."""
    running = running_sum(df, by, bucket, order, F.length(text) + 1, "running")
    return running.withColumn("running", F.col("running") - 1).where(F.col("running") <= budget)


def greedy_fill(df: DataFrame, by: Sequence[str], order: Sequence[str], size: str, budget: int, most: int) -> DataFrame:
    """Items in order as long as they fit; one that overflows is skipped and later ones may still enter; at most ``most`` items.

    An item without size never fits. Groups are sorted and folded row by row,
    so that a group may be of any size: only the open group's two numbers are held."""
    import pyarrow as pa

    by, order = list(by), list(order)
    rows = df.select(*by, *order, F.col(size).cast("bigint").alias(size))
    key = F.sha2(F.to_json(F.struct(*by), {"ignoreNullFields": "false"}), 256)
    placed = rows.withColumn("_g", key).repartition("_g").sortWithinPartitions("_g", *[F.asc_nulls_last(c) for c in [*order, size]])

    def fold(batches):
        group, used, n = None, 0, 0
        for b in batches:
            keep = []
            for g, s in zip(b.column("_g").to_pylist(), b.column(size).to_pylist()):
                if g != group:
                    group, used, n = g, 0, 0
                fits = n < most and s is not None and used + s <= budget
                keep.append(fits)
                if fits:
                    used, n = used + s, n + 1
            yield b.filter(pa.array(keep, pa.bool_()))

    return placed.mapInArrow(fold, placed.schema).drop("_g")


def rank_changes(before: DataFrame, after: DataFrame, key: str, k: int = 10) -> DataFrame:
    """How the first k of two rankings (key, rank) differ: up, down, same, new or dropped."""
    a = before.where(F.col("rank") <= k).select(key, F.col("rank").alias("rank_before"))
    b = after.where(F.col("rank") <= k).select(key, F.col("rank").alias("rank_after"))
    change = (
        F.when(F.col("rank_before").isNull(), "new").when(F.col("rank_after").isNull(), "dropped")
        .when(F.col("rank_after") < F.col("rank_before"), "up").when(F.col("rank_after") > F.col("rank_before"), "down").otherwise("same")
    )
    return a.join(b, key, "full").withColumn("change", change)


def reordered(df: DataFrame, kept: Column, demoted: Column, expanded: Column) -> DataFrame:
    """Kept rows first, then the rest, the demoted, the expanded, each in their old order, with new ranks."""
    bucket = F.when(expanded, 3).when(demoted, 2).when(kept, 0).otherwise(1)
    return ranked(df.withColumn("bucket", bucket).withColumnRenamed("rank", "old_rank"), ["bucket", "old_rank"])


def select_width(k: int) -> int:
    """How many candidates a selection of k is made from."""
    return max(2 * k, k + 5)


def missing_members(required: DataFrame, present: DataFrame, group: str, member: str) -> DataFrame:
    """Relational division: per group of required members whether all of them are present, and how many are missing."""
    marked = required.select(group, member).distinct().join(present.select(member).distinct().withColumn("_there", F.lit(True)), member, "left")
    return marked.groupBy(group).agg(F.every(F.coalesce("_there", F.lit(False))).alias("complete"), F.count_if(F.col("_there").isNull()).alias("n_missing"))


def merged_bundles(rows: DataFrame, key: str, content: str) -> DataFrame:
    """Rows of several bundles by key with ``in_conflict`` where one key comes with different contents; the least content is shown."""
    return rows.groupBy(key).agg(F.min(content).alias(content), (F.count_distinct(content) > 1).alias("in_conflict"), F.count(F.lit(1)).alias("n_bundles"))
