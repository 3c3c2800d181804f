"""Per-period counts of events that arrive late, out of order and repeatedly.

State is a table of conflict-free counter cells. A cell belongs to a source and one *writer*, the event that counts: all its
deliveries write the same cell, each under a version. Two states merge by taking the greatest version of every writer;
a period's value is the sum of its source's writers. Merging is commutative, associative and idempotent, so repeats, retries and
any order of arrival change nothing, and an event whose earlier delivery comes in last moves from one outcome or period to
another, leaving the old one, as its cell is replaced as a whole.

For reading, cells are summed into counters of few *lanes* per source, each under the sequence number of the cells it was summed from.
A lane is published whole; of several publications the greatest sequence per lane stands, and lanes are summed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
LANES = 16
#: Who writes a cell: an event by its hash, or by its own id where it has no hash.
WRITER = ("source_id", "content_hash", "own")
LANE = ("source_id", "lane")
OUTCOMES = {"on_time": "n_on_time", "correction": "n_corrections", "too_late": "n_too_late"}


@dataclass(frozen=True)
class LatenessPolicy:
    """Periods are UTC days of event time; ``lateness_us`` after the end of a period it is closed."""

    period_us: int = DAY_US
    lateness_us: int = 3 * DAY_US


def period_start_us(event_us: Column, policy: LatenessPolicy) -> Column:
    """Start of the event's period; the remainder is taken non-negative, so times before 1970 floor too."""
    return event_us - F.pmod(event_us, F.lit(policy.period_us))


def delivered_cells(claims: DataFrame) -> DataFrame:
    """The state of each delivery: one cell with the writer, the delivery's ``version`` and the count ``n`` of one.

    Rows with equal ``source_id`` and ``content_hash`` are deliveries of one event, a row without hash is its own event. The
    earlier a delivery was recorded the greater is its version, then the smaller its ``event_id`` is. Rows without ``valid_from`` or
    ``recorded_from`` write nothing. A null ``source_id`` counts as one source.
    """
    # bitwise not turns the order around for every number there is
    version = F.struct(
        F.bitwise_not(F.unix_micros("recorded_from")).alias("recorded"), F.bitwise_not("event_id").alias("event"), F.bitwise_not(F.unix_micros("valid_from")).alias("valid")
    )
    return claims.where(F.col("valid_from").isNotNull() & F.col("recorded_from").isNotNull()).select(
        "source_id", "content_hash", F.when(F.col("content_hash").isNull(), F.col("event_id")).alias("own"), version.alias("version"), F.lit(1).cast("bigint").alias("n")
    )


def merge_cells(*states: DataFrame) -> DataFrame:
    """The join of cell states: of every writer the cell of the greatest version. States may overlap, repeat and come in any order."""
    every = reduce(DataFrame.unionByName, states)
    best = every.groupBy(*WRITER).agg(F.max(F.struct("version", "n")).alias("cell"))
    return best.select(*WRITER, "cell.version", "cell.n")


def judged(cells: DataFrame, policy: LatenessPolicy = LatenessPolicy()) -> DataFrame:
    """Merged cells with what their version says: ``event_id``, ``period`` and ``outcome``, which is on_time before the period's end, then
    correction until the cut-off, then too_late."""
    recorded, event, valid = (F.bitwise_not(f"version.{part}") for part in ("recorded", "event", "valid"))
    period = period_start_us(valid, policy)
    closed = period + F.lit(policy.period_us)
    outcome = F.when(recorded < closed, "on_time").when(recorded < closed + F.lit(policy.lateness_us), "correction").otherwise("too_late")
    return cells.select(*WRITER, event.alias("event_id"), F.timestamp_micros(period).alias("period"), outcome.alias("outcome"), "n")


def counters(cells: DataFrame, sequence: int, policy: LatenessPolicy = LatenessPolicy(), lanes: int = LANES) -> DataFrame:
    """What merged cells come to: per period, source and lane the counts of each outcome, all under ``sequence``.

    A later publication is made from a state that holds the earlier one's cells and gets a greater sequence. All cells of a writer fall into
    one lane. Counting combines before the shuffle.
    """
    lane = F.pmod(F.xxhash64(*WRITER), F.lit(lanes)).cast("int")
    each = [F.sum(F.when(F.col("outcome") == o, F.col("n")).otherwise(0)).alias(name) for o, name in OUTCOMES.items()]
    return judged(cells, policy).withColumn("lane", lane).groupBy("period", *LANE).agg(*each).withColumn("sequence", F.lit(sequence).cast("bigint"))


def merge_counters(*published: DataFrame) -> DataFrame:
    """The join of publications: each lane as it stands under its greatest sequence, whole. Any order and repetition gives the same.

    The lanes of a source are few, so the table of greatest sequences is small whatever the number of periods.
    """
    every = reduce(DataFrame.unionByName, published)
    last = every.groupBy(*[F.col(c).alias(f"_{c}") for c in LANE]).agg(F.max("sequence").alias("_sequence"))
    newest = (F.col("source_id").eqNullSafe(F.col("_source_id"))) & (F.col("lane") == F.col("_lane")) & (F.col("sequence") == F.col("_sequence"))
    return every.join(last, newest, "left_semi").distinct()


def read_counters(state: DataFrame) -> DataFrame:
    """Per period and source, the sum of the lanes: on-time count, corrections that came in by the cut-off, rejected late events, and the total.

    ``n_total`` is the corrected value of the period; ``n_too_late`` does not enter it.
    """
    return state.groupBy("period", "source_id").agg(*[F.sum(name).alias(name) for name in OUTCOMES.values()]).withColumn("n_total", F.col("n_on_time") + F.col("n_corrections"))


def claim_rows(temporal_events: DataFrame) -> DataFrame:
    """The claim rows of ``temporal_events``; only the needed columns are read."""
    return temporal_events.where(F.col("claim").isNotNull()).select("event_id", "source_id", "content_hash", "valid_from", "recorded_from")


def late_claims(deliveries: Sequence[DataFrame], policy: LatenessPolicy = LatenessPolicy()) -> DataFrame:
    """Judged cells of claims that came in by any number of deliveries."""
    return judged(merge_cells(*[delivered_cells(d) for d in deliveries]), policy)
