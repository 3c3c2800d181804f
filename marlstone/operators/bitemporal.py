"""Selection and conflicts of bitemporal rows with half-open intervals; a null end is open."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Selector:
    """What is asked: mode is current, as_of, during, throughout or atemporal; instants in microseconds."""

    mode: str
    known_us: int
    at_us: int | None = None
    to_us: int | None = None


def resolve_selector(explicit: Selector | None, inherited: Selector | None, latest_us: int) -> Selector:
    """The explicit selector, else the inherited one, else the state now as known at the latest cut-off."""
    return explicit or inherited or Selector("current", latest_us, latest_us)


def contains(start: Column, end: Column, at: Column) -> Column:
    return F.coalesce(start <= at, F.lit(False)) & (end.isNull() | (at < end))


def overlaps(start: Column, end: Column, a: Column, b: Column) -> Column:
    return F.coalesce((b.isNull() | (start < b)), F.lit(True)) & (end.isNull() | (a < end)) & start.isNotNull()


def covers(start: Column, end: Column, a: Column, b: Column) -> Column:
    return F.coalesce(start <= a, F.lit(False)) & (end.isNull() | F.coalesce(b <= end, F.lit(False)))


def known(recorded_from: Column, recorded_to: Column, at: Column) -> Column:
    """Recorded by then and not yet withdrawn."""
    return contains(recorded_from, recorded_to, at)


def _not_known(s_known: Column) -> Column:
    """Why a row is not known at an instant, null where it is. A row without recording time was never recorded."""
    early = F.coalesce(F.col("recorded_us") > s_known, F.lit(True))
    return F.when(early, "recorded_after_cutoff").when(F.col("recorded_to_us") <= s_known, "recorded_closed")


def decide(df: DataFrame, s: Selector) -> DataFrame:
    """Adds ``decision`` (proven, contextual, excluded) and ``reason``. Columns in microseconds: from_us, to_us, recorded_us, recorded_to_us, and
    ``precision`` and ``validity_kind``.

    Rows not known at ``known_us`` are excluded. Only an explicit interval stated to the instant proves or excludes anything; without one,
    or with a coarser one, a row is context wherever it lies. An atemporal row holds at every point and for the atemporal
    question, which other rows with an interval are excluded from. ``current`` asks for the point ``known_us``.
    """
    start, end = F.col("from_us"), F.col("to_us")
    kind = F.coalesce("validity_kind", F.lit("unknown"))
    timeless = kind == "atemporal"
    unknown = (kind != "explicit_interval") | start.isNull()
    vague = F.coalesce(F.col("precision") != "instant", F.lit(True))
    if s.mode == "atemporal":
        steps = [(timeless, "proven", "atemporal_match"), (kind.isin("unknown", "observed_snapshot"), "contextual", "effective_unknown"), (F.lit(True), "excluded", "effective_outside")]
    else:
        at = F.lit(s.known_us if s.mode == "current" else s.at_us).cast("bigint")
        to = F.lit(s.to_us).cast("bigint")
        if s.mode in ("current", "as_of"):
            first, held = [(timeless, "proven", "atemporal_match")], contains(start, end, at)
        elif s.mode in ("during", "throughout"):
            first, held = [], overlaps(start, end, at, to) if s.mode == "during" else covers(start, end, at, to)
        else:
            raise ValueError(f"unknown mode {s.mode!r}")
        steps = [*first, (unknown, "contextual", "effective_unknown"), (vague, "contextual", "effective_imprecise"), (held, "proven", "effective_match"), (F.lit(True), "excluded", "effective_outside")]
    return _decided(df, s.known_us, steps)


def _decided(df: DataFrame, known_us: int, steps: list[tuple[Column, str, str]]) -> DataFrame:
    """The first step that holds decides, after the rows that are not known."""
    late = _not_known(F.lit(known_us).cast("bigint"))
    decision, reason = F.when(late.isNotNull(), "excluded"), F.when(late.isNotNull(), late)
    for condition, what, why in steps:
        decision, reason = decision.when(condition, what), reason.when(condition, why)
    return df.withColumn("decision", decision).withColumn("reason", reason)


def changes_between(df: DataFrame, clock: str, a_us: int, b_us: int, known_us: int) -> DataFrame:
    """Adds ``decision`` and ``reason``: whether the row's instant of the chosen clock lies in [a, b).

    ``published`` reads published_us, or recorded_us where ``recorded_is_publication`` is true; ``source_modified`` reads modified_us, stated to
    ``modified_precision``; ``effective`` reads from_us of an explicit interval, stated to ``precision``. A missing or imprecise instant is context.
    """
    clocks = {
        "published": lambda: (F.coalesce("published_us", F.when(F.col("recorded_is_publication"), F.col("recorded_us"))), F.lit("instant")),
        "source_modified": lambda: (F.col("modified_us"), F.col("modified_precision")),
        "effective": lambda: (F.when(F.col("validity_kind") == "explicit_interval", F.col("from_us")), F.col("precision")),
    }
    at, precision = clocks[clock]()
    untold = at.isNull() | F.coalesce(precision != "instant", F.lit(True))
    inside = (at >= a_us) & (at < b_us)
    return _decided(df, known_us, [(untold, "contextual", "change_clock_unknown"), (inside, "proven", "change_match"), (F.lit(True), "excluded", "change_outside")])


def compare_sides(df: DataFrame, key: list[str], value: str, left: Selector, right: Selector) -> DataFrame:
    """The proven values of each key on two sides and how they differ: added, removed, changed or same."""
    def side(s: Selector, name: str) -> DataFrame:
        return decide(df, s).where("decision = 'proven'").groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set(value)), "|").alias(name))

    both = side(left, "before").join(side(right, "after"), key, "full")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") == F.col("after"), "same").otherwise("changed")
    return both.withColumn("change", change)


def order_relation(pairs: DataFrame) -> DataFrame:
    """Adds ``relation`` of two versions (a, b structs of adapter, version, kind, ordinal): older, same, newer, or ambiguous where the contracts
    differ or do not order."""
    a, b = F.col("a"), F.col("b")
    ordered = (a["adapter"] == b["adapter"]) & (a["version"] == b["version"]) & (a["kind"] == "monotonic") & (b["kind"] == "monotonic") & a["ordinal"].isNotNull() & b["ordinal"].isNotNull()
    relation = F.when(a["ordinal"] < b["ordinal"], "older").when(a["ordinal"] == b["ordinal"], "same").otherwise("newer")
    return pairs.withColumn("relation", F.when(F.coalesce(ordered, F.lit(False)), relation).otherwise("ambiguous"))


def _versions(df: DataFrame, series: list[str]) -> DataFrame:
    """Distinct versions of each series and adapter contract with ``_at``, the ordinal where it orders anything."""
    return df.select(*series, "adapter", "adapter_version", "version_id", F.when(F.col("kind") == "monotonic", F.col("ordinal")).alias("_at")).distinct()


def current_versions(df: DataFrame, series: list[str]) -> DataFrame:
    """Per series and adapter contract what is current: series, adapter, adapter_version, ordinal, n_versions, is_ambiguous, n_superseded.

    Columns: version_id, adapter, adapter_version, kind, ordinal. Only monotonic ordinals of one contract order versions, so a version is
    superseded by a greater one, and those without such an ordinal stay current. A series with several current versions is
    ambiguous. ``ordinal`` is the greatest one, null where none orders. Two combined aggregates, no sort of a series.
    """
    contract = [*series, "adapter", "adapter_version"]
    at = _versions(df, series).groupBy(*contract, "_at").agg(F.count(F.lit(1)).alias("n"))
    best = at.groupBy(*contract).agg(
        F.max(F.when(F.col("_at").isNotNull(), F.struct("_at", "n"))).alias("_b"), F.coalesce(F.sum(F.when(F.col("_at").isNull(), F.col("n"))), F.lit(0)).alias("_loose"), F.sum("n").alias("_all")
    )
    current = F.coalesce("_b.n", F.lit(0)) + F.col("_loose")
    return best.select(*contract, F.col("_b._at").alias("ordinal"), current.alias("n_versions"), (current > 1).alias("is_ambiguous"), (F.col("_all") - current).alias("n_superseded"))


def superseded_and_current(df: DataFrame, series: list[str]) -> tuple[DataFrame, DataFrame]:
    """The versions (version_id) that some series proves older, and those that are current in some series."""
    contract = [*series, "adapter", "adapter_version"]
    rows = _versions(df, series)
    top = rows.groupBy(*[F.col(c).alias(f"_{c}") for c in contract]).agg(F.max("_at").alias("_top"))
    same = F.lit(True)
    for c in contract:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    both = rows.join(top, same)
    older = F.coalesce(F.col("_at") < F.col("_top"), F.lit(False))
    return both.where(older).select("version_id").distinct(), both.where(~older).select("version_id").distinct()


def fully_superseded(superseded: DataFrame, current: DataFrame) -> DataFrame:
    """Versions superseded somewhere and current nowhere."""
    return superseded.select("version_id").distinct().join(current.select("version_id"), "version_id", "left_anti")


def conflict_sets(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys with several objects that may hold at once: key, n_objects, status, from_us, to_us.

    ``unresolved`` with the common interval where all rows of the key meet; ``possible`` where only some pairs do, or validity is
    unknown. Meeting is settled by greatest start and least end; a key whose rows do not all meet is swept once in order of starts:
    two rows of different objects meet if a row starts before the latest end so far of another object.
    """
    start, end = F.col("from_us"), F.col("to_us")
    groups = df.groupBy(*key).agg(
        F.count_distinct("object").alias("n_objects"), F.max("from_us").alias("_lo"), F.min("to_us").alias("_hi"), F.count_if(start.isNull()).alias("_unknown")
    ).where("n_objects >= 2")
    whole = F.col("_hi").isNull() | (F.col("_lo") < F.col("_hi"))
    order = Window.partitionBy(*key).orderBy("from_us", "to_us", "object").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.struct(F.coalesce(end, F.lit(2**62)).alias("end"), F.col("object").alias("object"))
    swept = df.where("from_us is not null and (to_us is null or from_us < to_us)").withColumn("_best", F.max(reach).over(order))
    # where the farthest end is of the row's own object, an earlier row has met another object already
    meets = F.coalesce((F.col("_best.object") != F.col("object")) & (F.col("_best.end") > F.col("from_us")), F.lit(False))
    pairs = swept.groupBy(*key).agg(F.bool_or(meets).alias("_some"))
    joined = groups.join(pairs, key, "left")
    status = F.when((F.col("_unknown") == 0) & whole, "unresolved").when((F.col("_unknown") > 0) | F.coalesce("_some", F.lit(False)), "possible")
    common = F.col("status") == "unresolved"
    return joined.withColumn("status", status).where("status is not null").select(
        *key, "n_objects", "status", F.when(common, F.col("_lo")).alias("from_us"), F.when(common, F.col("_hi")).alias("to_us")
    )


def replay(df: DataFrame, clock_us: int) -> DataFrame:
    """Rows recorded by the clock in their order; later ones wait."""
    return df.where(F.col("recorded_us") <= clock_us).orderBy("recorded_us", "id")


def closed_and_appended(stored: DataFrame, closures: DataFrame, staged: DataFrame, published_us: int) -> DataFrame:
    """Append-only publication: open recorded intervals named by ``closures`` (id) end at the publication, staged rows are added.

    A staged id that is also closed is an error."""
    both = closures.select("id").join(staged.select("id"), "id", "left_semi")
    checked = staged.join(both.withColumn("_bad", F.lit(True)), "id", "left").withColumn("id", F.when(F.col("_bad"), F.raise_error(F.lit("closed and appended at once"))).otherwise(F.col("id"))).drop("_bad")
    ended = stored.join(closures.select("id").distinct().withColumn("_close", F.lit(True)), "id", "left")
    ended = ended.withColumn("recorded_to_us", F.coalesce("recorded_to_us", F.when(F.col("_close"), F.lit(published_us)))).drop("_close")
    return ended.unionByName(checked.select(*ended.columns))


def history_gaps(revisions: DataFrame, retained: DataFrame, earliest_us: int, cutoff_us: int) -> DataFrame:
    """Revisions that history lacks, with ``history_unavailable`` where the cut-off lies before the first record."""
    return revisions.join(retained.select("revision_id"), "revision_id", "left_anti").withColumn("history_unavailable", F.lit(cutoff_us < earliest_us))
