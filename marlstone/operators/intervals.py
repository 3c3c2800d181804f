"""Continuous periods and gaps of overlapping, nested and gapped intervals per entity.

Bounds are integers (microseconds). An entity's bounds are numbered in order, its intervals decomposed into canonical
dyadic blocks of these numbers, blocks inside an ancestor dropped, siblings merged upward and touching blocks joined. That
takes one shuffle by entity.

An entity with very many intervals is spread over tasks: time is cut into cells of ``2**CELL_BITS``; an interval falls into
at most two fragments inside cells and canonical blocks of whole cells. Fragments are united cell by cell, and
stitching across cells carries one number per cell, never an entity's whole list.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.dyadic import canonical_blocks, dyadic_union
from marlstone.plans.skew import HOT_ROWS, hot_keys

CELL_BITS = 38  # 3.2 days of microseconds
CELL = 1 << CELL_BITS
#: Cells are counted from the year 1 BC or so, as blocks need non-negative numbers.
CELL_SHIFT = 1 << 18
#: Levels of whole-cell blocks; the top block covers all times Spark can hold.
CELL_LEVELS = 21
OPEN_US = ((1 << CELL_LEVELS) - CELL_SHIFT) * CELL
_GROUPS = 1 << 16


def _unite(keys: Sequence[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), _GROUPS):
                pdf = whole.iloc[at : at + _GROUPS]
                by = [*keys, "_cell"]
                group = pdf.groupby(by, dropna=False, sort=False).ngroup().to_numpy()
                base = pdf["_cell"].to_numpy() * CELL
                g, lo, hi = dyadic_union(group, pdf["lo"].to_numpy() - base, pdf["hi"].to_numpy() - base, CELL_BITS)
                named = pdf.assign(_g=group).drop_duplicates("_g").set_index("_g")[by].loc[g].reset_index(drop=True)
                yield named.assign(lo=lo + named["_cell"].to_numpy() * CELL, hi=hi + named["_cell"].to_numpy() * CELL)[[*keys, "lo", "hi"]]

    return run


def _cell(us: Column) -> Column:
    return F.shiftright(us, CELL_BITS)


def united_pieces(intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Covered pieces (keys, lo, hi), disjoint inside each cell; a piece never crosses a cell unless it is whole cells.

    ``intervals`` has the key columns and bigint ``lo`` and ``hi``; a null ``hi`` is open and becomes ``OPEN_US``. Rows without
    ``lo`` and rows with ``hi <= lo`` cover nothing and are left out.
    """
    rows = intervals.select(*keys, "lo", F.least(F.coalesce("hi", F.lit(OPEN_US)), F.lit(OPEN_US)).alias("hi")).where("lo < hi")
    first, last = _cell(F.col("lo")), _cell(F.col("hi") - 1)
    one_cell = first == last
    fragment = lambda lo, hi: F.when(lo < hi, F.struct(lo.alias("lo"), hi.alias("hi")))
    from_cell = _cell(F.col("lo") + CELL - 1)
    to_cell = _cell(F.col("hi"))
    cut = rows.select(
        *keys, "lo", "hi",
        F.when(one_cell, F.array(fragment(F.col("lo"), F.col("hi")))).otherwise(
            F.array(fragment(F.col("lo"), from_cell * CELL), fragment(to_cell * CELL, F.col("hi")))
        ).alias("fragments"),
        from_cell.alias("from_cell"), to_cell.alias("to_cell"),
    )
    fragments = cut.select(*keys, F.explode("fragments").alias("f")).where("f is not null").select(*keys, _cell(F.col("f.lo")).alias("_cell"), "f.lo", "f.hi")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in intervals.select(*keys).schema) + ", lo bigint, hi bigint"
    inside = fragments.repartition(*keys, "_cell").mapInPandas(_unite(keys), schema)
    block = F.explode(canonical_blocks(F.col("from_cell") + CELL_SHIFT, F.col("to_cell") + CELL_SHIFT, CELL_LEVELS)).alias("b")
    width = F.call_function("shiftleft", F.lit(CELL), F.col("b.level"))
    whole = (
        cut.where("from_cell < to_cell").select(*keys, block)
        .distinct()  # repeats of a block go before they are shuffled
        .select(*keys, (F.col("b.block") * width - F.lit(CELL_SHIFT * CELL)).alias("lo"), ((F.col("b.block") + 1) * width - F.lit(CELL_SHIFT * CELL)).alias("hi"))
    )
    return inside.unionByName(whole)


def _entity_spans(entity: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entity, kind (0 period, 1 gap), lo and hi of the spans of whole entities; ``entity`` numbers them from 0 on in order."""
    n = len(entity)
    owner, bound = np.concatenate([entity, entity]), np.concatenate([lo, hi])
    order = np.lexsort((bound, owner))
    owner, bound = owner[order], bound[order]
    fresh = np.ones(2 * n, bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (bound[1:] != bound[:-1])
    number = np.empty(2 * n, np.int64)
    number[order] = np.cumsum(fresh) - 1
    values, owners = bound[fresh], owner[fresh]
    first = np.searchsorted(owners, np.arange(entity.max() + 1))
    local = number - first[np.concatenate([entity, entity])]
    bits = max(1, int(local.max()).bit_length())
    e, a, b = dyadic_union(entity, local[:n], local[n:], bits)
    a, b = values[first[e] + a], values[first[e] + b]
    next_to = np.flatnonzero(e[1:] == e[:-1])
    return np.concatenate([e, e[next_to]]), np.repeat([0, 1], [len(e), len(next_to)]), np.concatenate([a, b[next_to]]), np.concatenate([b, a[next_to + 1]])


def _sweep(keys: Sequence[str]):
    """Spans of a partition that is sorted by entity; an entity may go on in the next batch."""
    names = list(keys)

    def spans(pdf: pd.DataFrame) -> pd.DataFrame:
        shown = pdf[names]
        changed = (~(shown.eq(shown.shift()) | (shown.isna() & shown.shift().isna())).all(axis=1)).to_numpy()
        changed[0] = True
        entity = np.cumsum(changed) - 1
        e, kind, lo, hi = _entity_spans(entity, pdf["lo"].to_numpy(), pdf["hi"].to_numpy())
        rows = shown.iloc[np.flatnonzero(changed)[e]].reset_index(drop=True)
        return rows.assign(span_kind=np.where(kind == 0, "period", "gap"), lo=lo, hi=hi)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            last, tail = batch.iloc[-1], batch[names]
            same = (tail.eq(last[names]) | (tail.isna() & last[names].isna())).all(axis=1).to_numpy()
            cut = len(batch) if not same[-1] else int(np.flatnonzero(~same)[-1]) + 1 if (~same).any() else 0
            if cut:
                yield spans(pd.concat([*held, batch.iloc[:cut]], ignore_index=True))
                held = []
            held.append(batch.iloc[cut:])
        if held:
            yield spans(pd.concat(held, ignore_index=True))

    return run


def periods_and_gaps(intervals: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Longest covered stretches (``period``) and holes between neighbours (``gap``) per key: span_kind, lo, hi.

    ``intervals`` has the key columns and bigint ``lo`` and ``hi``; a null ``hi`` is open. An interval that starts exactly where another ends
    leaves no hole. Rows without ``lo`` and rows with ``hi <= lo`` cover nothing and are left out. ``hi`` is null for an open period. Repeated rows
    and ties change nothing; null keys form their own entity; an empty input gives an empty result. Other columns of the
    input are ignored, whatever their names. Entities with more than ``hot_rows`` intervals are spread over tasks, with the
    same result.
    """
    keys = list(keys)
    rows = intervals.select(*keys, "lo", F.least(F.coalesce("hi", F.lit(OPEN_US)), F.lit(OPEN_US)).alias("hi")).where("lo < hi")
    hot = hot_keys(rows, keys, hot_rows).drop("_salts")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    if hot.isEmpty():
        crowded, rest = None, rows
    else:
        same = [F.expr(f"r.`{k}` <=> h.`{k}`") for k in keys]
        crowded = rows.alias("r").join(hot.alias("h"), same, "left_semi")
        rest = rows.alias("r").join(hot.alias("h"), same, "left_anti")
    # the bounds of an entity have to come in one piece, not in order; sorting by key brings them together
    swept = rest.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(_sweep(keys), f"{schema}, span_kind string, lo bigint, hi bigint")
    swept = swept.withColumn("hi", F.when((F.col("hi") < OPEN_US) | (F.col("span_kind") == "gap"), F.col("hi")))
    return swept if crowded is None else swept.unionByName(_spread_spans(crowded, keys))


def _spread_spans(intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``periods_and_gaps`` with each entity spread over the cells of its time."""
    keys = list(keys)
    pieces = united_pieces(intervals, keys).withColumn("_chunk", _cell(F.col("lo")))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    chunk_order = Window.partitionBy(*keys).orderBy("_chunk")
    # one row per entity and cell: how far earlier cells reach
    reach = pieces.groupBy(*keys, "_chunk").agg(F.max("hi").alias("_reach"))
    carried = reach.withColumn("_carry", F.max("_reach").over(before(chunk_order))).drop("_reach")
    in_chunk = Window.partitionBy(*keys, "_chunk").orderBy("lo", "hi")
    on = lambda a, b: [F.expr(f"{a}.`{k}` <=> {b}.`{k}`") for k in [*keys, "_chunk"]]
    swept = pieces.alias("p").join(carried.alias("c"), on("p", "c")).select("p.*", "c._carry").withColumn(
        "_before", F.greatest("_carry", F.max("hi").over(before(in_chunk)))
    )
    starts = swept.where("_before is null or lo > _before").select(*keys, "_chunk", "lo", "_before")
    # a period ends where the coverage before the next start ends; the last one at the entity's overall reach
    first_start = starts.groupBy(*keys, "_chunk").agg(F.min(F.struct("lo", "_before")).alias("_s"))
    total = Window.partitionBy(*keys)
    after = reach.alias("r").join(first_start.alias("s"), on("r", "s"), "left").select("r.*", F.col("s._s._before").alias("_opens")).select(
        *keys, "_chunk",
        F.first("_opens", ignorenulls=True).over(chunk_order.rowsBetween(1, Window.unboundedFollowing)).alias("_next_end"),
        F.max("_reach").over(total).alias("_end"),
    )
    ends = starts.withColumn("_lead", F.lead("_before").over(Window.partitionBy(*keys, "_chunk").orderBy("lo")))
    whole = ends.alias("p").join(after.alias("c"), on("p", "c")).select("p.*", "c._next_end", "c._end")
    end = F.coalesce("_lead", "_next_end", "_end")
    spans = F.array(
        F.struct(F.lit("period").alias("span_kind"), F.col("lo").alias("lo"), F.when(end < OPEN_US, end).alias("hi")),
        F.when(F.col("_before").isNotNull(), F.struct(F.lit("gap").alias("span_kind"), F.col("_before").alias("lo"), F.col("lo").alias("hi"))),
    )
    return whole.select(*keys, F.explode(spans).alias("s")).where("s is not null").select(*keys, "s.span_kind", "s.lo", "s.hi")


def claim_intervals(temporal_events: DataFrame) -> DataFrame:
    """Validity of the claim rows as integers, keyed by source_id, scope_key and predicate."""
    return temporal_events.where("claim is not null and valid_from is not null").select(
        "source_id", "scope_key", F.col("claim.predicate").alias("predicate"),
        F.unix_micros("valid_from").alias("lo"), F.unix_micros("valid_to").alias("hi"),
    )
