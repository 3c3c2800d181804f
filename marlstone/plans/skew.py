"""Ways to keep one hot key from landing in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one key that one task may take before the key is salted. No table has more than rows / HOT_ROWS such keys.
HOT_ROWS = 200_000


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows and the number of salts each is split into.

    Counts are combined map-side. At most ``rows / hot_rows`` keys come out, which bounds this table.
    """
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counted.where(F.col("_n") > hot_rows).select(*keys, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts"))


def salted_lookup(members: DataFrame, groups: DataFrame, keys: Sequence[str], count_col: str, spread_by: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join every member row to the single ``groups`` row of its key, with hot keys spread over several tasks.

    ``groups`` has one row per key and its member count. A member draws its salt from ``spread_by``; a group with more
    than ``hot_rows`` members is repeated once per salt. Both sides derive the number of salts from the group's
    count, which members learn from the (at most ``rows / hot_rows``) hot groups.
    """
    keys = list(keys)
    salts = F.ceil(F.col(count_col) / F.lit(hot_rows)).cast("int")
    hot = groups.where(F.col(count_col) > hot_rows).select(*keys, salts.alias("_salts"))
    # at most rows / hot_rows keys are hot, so members learn their salts without a shuffle of their own
    spread = members.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.coalesce(F.pmod(F.xxhash64(spread_by), F.col("_salts")).cast("int"), F.lit(0))
    ).drop("_salts")
    repeated = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    return spread.join(repeated, [*keys, "_salt"], "inner").drop("_salt")


def running_sum(df: DataFrame, by: Sequence[str], bucket: Column, order: Sequence[Column | str], value: Column, out: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows of ``by`` up to each row in ``order``, without one task sorting a whole group.

    ``bucket`` must not fall along the order. Buckets are summed first (combined before the shuffle), a group's buckets give the offsets, and rows
    are sorted inside their bucket only. Groups with a null key are groups like others.
    """
    by = list(by)
    rows = df.withColumn("_bucket", bucket).withColumn("_value", value)
    before = Window.partitionBy(*[f"_{c}" for c in by]).orderBy(F.asc_nulls_first("_at")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*[F.col(c).alias(f"_{c}") for c in by], F.col("_bucket").alias("_at")).agg(F.sum("_value").alias("_sum"))
    offsets = totals.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    same = F.col("_bucket").eqNullSafe(F.col("_at"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.join(offsets, same).withColumn(out, F.col("_before") + F.sum("_value").over(inside)).select(*df.columns, out)
