"""Attributes as known at event time: point location in bitemporal rectangles.

A claim is a rectangle: valid time [valid_from, valid_to) by recorded time [recorded_from, ever). Its valid side is cut
into canonical dyadic blocks. All rectangles of one block span the block's whole valid range, so inside it the plane
splits along recorded time alone into disjoint regions, each with one current claim: the running best in order of
recording. A question looks up the one block of each level that holds its valid_at and takes the best of the regions it meets.

For questions the blocks are hours and, in those hours where a claim begins or ends and a question asks, microseconds. The regions themselves
are laid over the numbered bounds of each series, so that a claim takes few blocks however long it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.dyadic import canonical_blocks
from marlstone.plans.skew import HOT_ROWS, hot_keys

HOUR_US = 3_600_000_000
#: Hours are counted from far before the year 1, as blocks need non-negative numbers.
HOUR_SHIFT = 1 << 26
HOUR_LEVELS = 27
OPEN_US = ((1 << HOUR_LEVELS) - HOUR_SHIFT) * HOUR_US
MICRO_LEVELS = 32
#: Levels of blocks over numbered bounds.
BOUND_LEVELS = 40
_S = ["_s1", "_s2"]


def _series(keys: Sequence[str]) -> list[Column]:
    """128 bits that name a series; two independent hashes keep long strings out of the shuffles."""
    return [F.xxhash64(*keys).alias("_s1"), F.xxhash64(F.lit("series"), *reversed(keys)).alias("_s2")]


def _hour(us: Column) -> Column:
    return ((us - F.pmod(us, F.lit(HOUR_US))) / HOUR_US).cast("bigint") + HOUR_SHIFT


def _running_best(claims: DataFrame, points: DataFrame, cell: Sequence[str]) -> DataFrame:
    """For each point, the best claim of its cell recorded by the point's known time. One ordered pass, no pairs."""
    both = claims.select(*cell, F.col("_rf").alias("_at"), F.lit(0).alias("_kind"), "_best", F.lit(None).cast(points.schema["_q"].dataType).alias("_q")).unionByName(
        points.select(*cell, F.col("_known").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(claims.schema["_best"].dataType).alias("_best"), "_q")
    )
    order = Window.partitionBy(*cell).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("_best", F.max("_best").over(order)).where("_kind = 1 and _best is not null").select("_q", "_best")


def covering(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, lo: str, hi: str) -> DataFrame:
    """Every pair of a point (keys, ``at``) and a span (keys, ``lo``, ``hi``; null: open) of its series with lo <= at < hi.

    Spans are cut into blocks of the hours they touch and met by equality, so that no pair is tried but the found ones and those that
    share a span's first or last hour. Columns of both come out, the keys once; other names must differ. Null keys and bounds meet nothing.
    """
    cut = spans.where(F.col(lo).isNotNull() & (F.col(hi).isNull() | (F.col(lo) < F.col(hi))))
    end = F.least(F.coalesce(F.col(hi), F.lit(OPEN_US)), F.lit(OPEN_US))
    cut = cut.withColumn("_b", F.explode(canonical_blocks(_hour(F.col(lo)), _hour(end - 1) + 1, HOUR_LEVELS)))
    asked = points.where(F.col(at).isNotNull()).withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(HOUR_LEVELS)))).withColumn("_h", _hour(F.col(at)))
    asked = asked.withColumn("_block", F.expr("shiftright(_h, _level)")).drop("_h")
    met = asked.join(cut.select("*", F.col("_b.level").alias("_level"), F.col("_b.block").alias("_block")).drop("_b"), [*keys, "_level", "_block"])
    return met.where((F.col(lo) <= F.col(at)) & (F.col(hi).isNull() | (F.col(at) < F.col(hi)))).drop("_level", "_block")


def as_of_join(questions: DataFrame, claims: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """The claim current for each question: columns ``question`` and ``claim`` (their ids).

    ``questions``: keys, ``id`` (unique), ``valid_us``, ``known_us``. ``claims``: keys, ``id``, ``from_us``, ``to_us`` (null: open),
    ``recorded_us``, ``ordinal``. Of the claims of the series with from <= valid < to and recorded <= known the one with the greatest
    ordinal (null is lowest), then latest recording, then greatest id is taken. Rows lacking a key, an id or one of the
    times (but ``to_us``) match nothing. Claims that end at or before their start hold nowhere. Repeated claims tie and give one row.
    Questions without a claim are not listed.
    """
    need_q = [*keys, "id", "valid_us", "known_us"]
    q = questions.dropna(subset=need_q).select(
        *_series(keys), F.col("id").alias("_q"), F.col("valid_us").alias("_valid"), F.col("known_us").alias("_known")
    )
    c = claims.dropna(subset=[*keys, "id", "from_us", "recorded_us"]).select(
        *_series(keys), F.col("from_us").alias("_lo"), F.least(F.coalesce("to_us", F.lit(OPEN_US)), F.lit(OPEN_US)).alias("_hi"),
        F.col("recorded_us").alias("_rf"),
        F.struct(F.col("ordinal").isNotNull().alias("has"), F.col("ordinal").alias("ordinal"), F.col("recorded_us").alias("rf"), F.col("id").alias("id")).alias("_best"),
    ).where("_lo < _hi")
    # series that nobody asks for go before they are cut into blocks
    c = c.join(q.select(*_S).distinct(), _S, "left_semi")
    # a series with very many claims is split by salt: the best of the best of its parts is its best
    hot = F.broadcast(hot_keys(c, _S, hot_rows))  # at most rows / hot_rows series
    c = c.join(hot, _S, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("_best"), F.col("_salts")).cast("int"), F.lit(0))).drop("_salts")
    q = q.join(hot, _S, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_salts")
    s = [*_S, "_salt"]
    from_hour = _hour(F.col("_lo") + HOUR_US - 1)
    to_hour = _hour(F.col("_hi"))
    whole = c.select(*s, "_rf", "_best", F.explode(canonical_blocks(from_hour, to_hour, HOUR_LEVELS)).alias("b")).select(*s, "b.level", "b.block", "_rf", "_best")
    hour_points = q.select(
        *s, "_q", "_known", _hour(F.col("_valid")).alias("_h"), F.explode(F.sequence(F.lit(0), F.lit(HOUR_LEVELS))).alias("level")
    ).select(*s, "level", F.expr("shiftright(_h, level)").alias("block"), "_known", "_q")
    best = [_running_best(whole, hour_points, [*s, "level", "block"])]

    # hours that a claim covers partly are cut to microseconds, but only where a question falls into them
    points = q.withColumn("_h", _hour(F.col("_valid")))
    edge = lambda us: F.when(F.pmod(us, F.lit(HOUR_US)) != 0, _hour(us))
    edges = c.select("*", F.explode(F.array_distinct(F.array(edge(F.col("_lo")), edge(F.col("_hi"))))).alias("_h")).where("_h is not null")
    edges = edges.join(points.select(*s, "_h").distinct(), [*s, "_h"], "left_semi")
    start = (F.col("_h") - HOUR_SHIFT) * HOUR_US
    fine = edges.select(
        *s, "_h", "_rf", "_best",
        F.explode(canonical_blocks(F.greatest(F.col("_lo") - start, F.lit(0)), F.least(F.col("_hi") - start, F.lit(HOUR_US)), MICRO_LEVELS)).alias("b"),
    ).select(*s, "_h", "b.level", "b.block", "_rf", "_best")
    fine_points = points.select(
        *s, "_h", "_q", "_known", (F.col("_valid") - start).alias("_at"), F.explode(F.sequence(F.lit(0), F.lit(MICRO_LEVELS))).alias("level")
    ).select(*s, "_h", "level", F.expr("shiftright(_at, level)").alias("block"), "_known", "_q")
    found = _running_best(whole, hour_points, [*s, "level", "block"]).unionByName(_running_best(fine, fine_points, [*s, "_h", "level", "block"]))
    return found.groupBy(F.col("_q").alias("question")).agg(F.max("_best").alias("_best")).select("question", F.col("_best.id").alias("claim"))


def current_regions(claims: DataFrame, keys: Sequence[str], known_us: int | None = None) -> DataFrame:
    """The disjoint regions of valid time and the claim current in each as known at ``known_us`` (by default, by all that is recorded): keys,
    ``from_us``, ``to_us`` (null: open), ``claim``. Neighbouring regions of one series differ in their claim or have a gap between them.

    Claims as for ``as_of_join``, with the same rows left out. Bounds of a series are numbered by counting those of each hour and of the
    hours before; claims are cut into blocks of numbers, each block keeps its best claim, and every bound looks up the blocks around it. No
    step sorts or gathers a series: what is per block combines before the shuffle, and neighbours are met by number.
    """
    held = claims.dropna(subset=[*keys, "id", "from_us", "recorded_us"])
    if known_us is not None:
        held = held.where(F.col("recorded_us") <= known_us)
    held = held.select(
        *_series(keys), *keys, F.col("from_us").alias("_lo"), F.least(F.coalesce("to_us", F.lit(OPEN_US)), F.lit(OPEN_US)).alias("_hi"),
        F.struct(F.col("ordinal").isNotNull().alias("has"), F.col("ordinal").alias("ordinal"), F.col("recorded_us").alias("rf"), F.col("id").alias("id")).alias("_best"),
    ).where("_lo < _hi")
    ends = held.drop(*keys).select("*", F.explode(F.array("_lo", "_hi")).alias("_at")).withColumn("_h", _hour(F.col("_at")))
    ends = ends.withColumn("_nth", F.dense_rank().over(Window.partitionBy(*_S, "_h").orderBy("_at")))
    before = Window.partitionBy(*_S).orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.groupBy(*_S, "_h").agg(F.max("_nth").alias("_n")).select(*_S, "_h", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ends = ends.join(offsets, [*_S, "_h"]).withColumn("_number", F.col("_before") + F.col("_nth") - 1)
    spans = ends.groupBy(*_S, "_best", "_lo", "_hi").agg(F.min("_number").alias("_from"), F.max("_number").alias("_to"))
    blocks = spans.select(*_S, "_best", F.explode(canonical_blocks(F.col("_from"), F.col("_to"), BOUND_LEVELS)).alias("b"))
    best = blocks.groupBy(*_S, F.col("b.level").alias("_level"), F.col("b.block").alias("_block")).agg(F.max("_best").alias("_best"))
    levels = best.groupBy(*_S).agg(F.collect_set("_level").alias("_levels"))  # at most BOUND_LEVELS + 1 a series
    bounds = ends.select(*_S, "_number", "_at").distinct()
    asked = bounds.join(levels, _S).select(*_S, "_number", F.explode("_levels").alias("_level")).withColumn("_block", F.expr("shiftright(_number, _level)"))
    now = asked.join(best, [*_S, "_level", "_block"]).groupBy(*_S, "_number").agg(F.max("_best").alias("_best")).select(*_S, "_number", F.col("_best.id").alias("_claim"))
    was = now.select(*_S, (F.col("_number") + 1).alias("_number"), F.col("_claim").alias("_was"))
    turns = bounds.join(now, [*_S, "_number"], "left").join(was, [*_S, "_number"], "left").where("not (_claim <=> _was)")
    marks = F.array(F.struct(F.col("_was").alias("claim"), F.lit(1).alias("starts")), F.struct(F.col("_claim").alias("claim"), F.lit(2).alias("starts")))
    marks = turns.select(*_S, "_at", F.explode(marks).alias("m")).select(*_S, "_at", "m.claim", "m.starts").where("claim is not null")
    pair = Window.partitionBy(*_S, "claim").orderBy("_at", "starts")
    regions = marks.withColumn("to_us", F.lead("_at").over(pair)).where("starts = 2")
    named = regions.join(held.select(*_S, *keys).distinct(), _S)
    return named.select(*keys, F.col("_at").alias("from_us"), F.when(F.col("to_us") < OPEN_US, F.col("to_us")).alias("to_us"), "claim")
