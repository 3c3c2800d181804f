"""Time texts in mixed formats, precisions and zones, brought to one UTC instant or to the reason why not.

An ordered cascade of anchored patterns is tried; the first that matches decides the fields, which are then checked
strictly. A zone or offset in the text beats the declared one. Local times are turned into instants by trying the zone's
offsets from the day before and the day after: two that fit make the time ambiguous, none makes it nonexistent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
_ZONE = r"(Z|z|UTC|GMT|[+-]\d{2}:?\d{2})"
_CLOCK = r"(\d{2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_LOOSE = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
#: (pattern, order of year|month|day|hour|minute|second|fraction|half|zone as group numbers, 0 where the pattern has none)
CASCADE: tuple[tuple[str, tuple[int, ...]], ...] = (
    (rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})[Tt ]{_CLOCK}(?: ?{_ZONE})?$", (1, 2, 3, 4, 5, 6, 7, 0, 8)),
    (rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})(?: ?{_ZONE})?$", (1, 2, 3, 0, 0, 0, 0, 0, 4)),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)?(?: ?{_ZONE})?$", (1, 2, 3, 4, 5, 6, 7, 0, 8)),
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?:,? {_LOOSE})?(?: ?{_ZONE})?$", (3, 2, 1, 4, 5, 6, 7, 0, 8)),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:,? {_LOOSE}(?: ?([AaPp])\.?[Mm]\.?)?)?(?: ?{_ZONE})?$", (3, 1, 2, 4, 5, 6, 7, 8, 9)),
    (rf"^(?:[A-Za-z]{{3,9}},? )?(\d{{1,2}}) ([A-Za-z]{{3,9}})\.? (\d{{4}})(?:,? {_LOOSE}(?: ?([AaPp])\.?[Mm]\.?)?)?(?: ?{_ZONE})?$", (3, 2, 1, 4, 5, 6, 7, 8, 9)),
    (rf"^([A-Za-z]{{3,9}})\.? (\d{{1,2}}),? (\d{{4}})(?:,? {_LOOSE}(?: ?([AaPp])\.?[Mm]\.?)?)?(?: ?{_ZONE})?$", (3, 1, 2, 4, 5, 6, 7, 8, 9)),
    (rf"^(\d{{4}})-(\d{{2}})(?: ?{_ZONE})?$", (1, 2, 0, 0, 0, 0, 0, 0, 3)),
    (rf"^(\d{{4}})(?: ?{_ZONE})?$", (1, 0, 0, 0, 0, 0, 0, 0, 2)),
)
#: Digits of a plain number and the microseconds of its unit.
EPOCH_UNITS = {10: 1_000_000, 13: 1_000, 16: 1}
_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_OFFSET = r"^[+-]\d{2}:?\d{2}$"


def known_zones(spark: SparkSession) -> list[str]:
    """Zone names that Spark's JVM can resolve; a declared zone outside this list counts as not declared."""
    return sorted(spark._jvm.java.time.ZoneId.getAvailableZoneIds())


def _number(part: Column, default: int) -> Column:
    return F.when(part == "", F.lit(default)).otherwise(part.cast("int"))


def _month(part: Column) -> Column:
    name = F.lower(part)
    named = F.lit(None).cast("int")
    for number, month in enumerate(_MONTHS, 1):
        named = F.when(name.isin(month, month[:3]), number).otherwise(named)
    return F.when(part == "", F.lit(1)).when(part.rlike(r"^\d+$"), F.when(part.rlike(r"^\d+$"), part).cast("int")).otherwise(named)


def _offset_us(text: Column) -> Column:
    """Microseconds east of UTC of a checked offset text; null for hours over 18 or minutes over 59."""
    digits = F.regexp_replace(text, ":", "")
    hours, minutes = F.substring(digits, 2, 2).cast("int"), F.substring(digits, 4, 2).cast("int")
    sign = F.when(F.startswith(digits, F.lit("-")), -1).otherwise(1)
    return F.when((hours <= 18) & (minutes < 60), (sign * (hours * 60 + minutes)).cast("bigint") * 60_000_000)


def _fields(df: DataFrame) -> DataFrame:
    """Adds ``_p``: the nine fields as texts, null where no pattern matches; ``_e`` the microseconds of a plain number."""
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    df = df.withColumn("_t", text)
    parts = F.lit(None).cast("array<string>")
    for pattern, order in reversed(CASCADE):
        shape = "|".join(f"${group}" if group else "" for group in order)
        parts = F.when(F.col("_t").rlike(pattern), F.split(F.regexp_replace("_t", pattern, shape), r"\|", -1)).otherwise(parts)
    epoch = F.lit(None).cast("bigint")
    for digits, unit in EPOCH_UNITS.items():
        epoch = F.when(F.col("_t").rlike(rf"^\d{{{digits}}}$"), F.when(F.col("_t").rlike(rf"^\d{{{digits}}}$"), F.col("_t")).cast("bigint") * unit).otherwise(epoch)
    return df.withColumn("_e", epoch).withColumn("_p", F.when(F.col("_e").isNull(), parts))


def _local_us(df: DataFrame) -> DataFrame:
    """Adds ``_l``: the written wall time as microseconds since 1970, null where there is no such date or time."""
    p = lambda i: F.col("_p")[i]
    df = df.select(
        "*", p(0).cast("int").alias("_y"), _month(p(1)).alias("_mo"), _number(p(2), 1).alias("_d"), _number(p(3), 0).alias("_h"),
        _number(p(4), 0).alias("_mi"), _number(p(5), 0).alias("_s"), F.rpad(F.substring(p(6), 1, 6), 6, "0").cast("int").alias("_f"),
        F.lower(p(7)).alias("_half"),
    )
    leap = (F.col("_y") % 4 == 0) & ((F.col("_y") % 100 != 0) | (F.col("_y") % 400 == 0))
    days = F.when(F.col("_mo") == 2, F.when(leap, 29).otherwise(28)).when(F.col("_mo").isin(4, 6, 9, 11), 30).otherwise(31)
    clock = F.when(F.col("_half") == "", F.col("_h") <= 23).otherwise(F.col("_h").between(1, 12))
    real = (F.col("_y") >= 1) & F.col("_mo").between(1, 12) & F.col("_d").between(1, days) & clock & (F.col("_mi") <= 59) & (F.col("_s") <= 59)
    hour = F.when(F.col("_half") == "", F.col("_h")).otherwise(F.col("_h") % 12 + F.when(F.col("_half") == "p", 12).otherwise(0))
    day = F.unix_date(F.when(real, F.make_date("_y", "_mo", "_d"))).cast("bigint")
    local = F.when(real, day * DAY_US + ((hour * 60 + F.col("_mi")) * 60 + F.col("_s")).cast("bigint") * 1_000_000 + F.col("_f"))
    return df.withColumn("_l", local).drop("_y", "_mo", "_d", "_h", "_mi", "_s", "_f", "_half")


def normalise_times(rows: DataFrame) -> DataFrame:
    """Adds ``utc_us`` (bigint) and ``problem`` to rows with ``text`` and ``zone`` (declared zone name or offset, or null).

    Exactly one of the two is set where ``text`` is given: ``problem`` is ``invalid`` (no real date or time, the empty text included),
    ``unzoned`` (no zone in the text and none usable declared), ``ambiguous`` or ``nonexistent``. A null text has neither. A day,
    month or year stands for its first instant; digits past microseconds are cut off. The name of a weekday is not
    checked. Other columns pass through; names beginning with one underscore are reserved.
    """
    zones = known_zones(rows.sparkSession)
    df = _local_us(_fields(rows))
    written = F.col("_p")[8]
    declared = F.regexp_replace("zone", r"^\s+|\s+$", "")
    df = df.select(
        "*",
        F.when(written.isin("Z", "z", "UTC", "GMT"), F.lit(0).cast("bigint")).when(written != "", _offset_us(written)).alias("_wo"),
        (written != "").alias("_w"),
        F.when(declared.rlike(_OFFSET), _offset_us(declared)).when(declared == "Z", F.lit(0).cast("bigint")).alias("_do"),
        F.when(declared.isin(zones), declared).alias("_z"),
    )
    local = F.col("_l")

    def offset(at: Column) -> Column:
        return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(at), F.col("_z"))) - at

    df = df.select("*", offset(local - DAY_US).alias("_o1"), offset(local + DAY_US).alias("_o2"))
    df = df.select("*", (offset(local - F.col("_o1")) == F.col("_o1")).alias("_k1"), (offset(local - F.col("_o2")) == F.col("_o2")).alias("_k2"))
    bad = F.col("_e").isNull() & (local.isNull() | (F.col("_w") & F.col("_wo").isNull()))
    fixed = F.when(F.col("_w"), F.col("_wo")).otherwise(F.col("_do"))
    both = F.col("_k1") & F.col("_k2") & (F.col("_o1") != F.col("_o2"))
    problem = (
        F.when(F.col("text").isNull(), None).when(bad, "invalid").when(F.col("_e").isNotNull() | fixed.isNotNull(), None)
        .when(F.col("_z").isNull(), "unzoned").when(both, "ambiguous").when(~F.col("_k1") & ~F.col("_k2"), "nonexistent")
    )
    instant = F.coalesce(F.col("_e"), local - fixed, local - F.when(F.col("_k1"), F.col("_o1")).otherwise(F.col("_o2")))
    kept = [c for c in rows.columns]
    return df.select(*kept, problem.alias("problem"), instant.alias("_u")).select(*kept, F.when(F.col("problem").isNull(), F.col("_u")).alias("utc_us"), "problem")


def utc_text(us: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS.ffffffZ`` whatever the session's time zone."""
    within = F.pmod(us, F.lit(DAY_US))
    day = F.date_format(F.date_from_unix_date(((us - within) / DAY_US).cast("int")), "yyyy-MM-dd")
    second = (within - within % 1_000_000) / 1_000_000
    at = lambda unit, size: F.lpad((F.floor(second / unit) % size).cast("string"), 2, "0")
    return F.concat(day, F.lit("T"), at(3600, 24), F.lit(":"), at(60, 60), F.lit(":"), at(1, 60), F.lit("."), F.lpad((within % 1_000_000).cast("string"), 6, "0"), F.lit("Z"))


def stated_times(temporal_events: DataFrame, sources: DataFrame, observations: DataFrame) -> DataFrame:
    """The non-null time texts of both tables with their declared zones: tbl, row_key, grain, text, zone."""
    events = temporal_events.where("source_updated_at is not null").select("event_id", "source_id", "precision", "source_updated_at")
    zones = sources.select(F.col("id").alias("source_id"), F.col("timezone").alias("zone"))
    first = events.join(zones, "source_id", "left").select(
        F.lit("temporal_events").alias("tbl"), F.col("event_id").cast("string").alias("row_key"), F.col("precision").alias("grain"),
        F.col("source_updated_at").alias("text"), "zone",
    )
    second = observations.where("source_timestamp_original is not null").select(
        F.lit("observations").alias("tbl"), F.col("id").alias("row_key"), F.col("temporal_precision").alias("grain"),
        F.col("source_timestamp_original").alias("text"), F.col("source_timezone").alias("zone"),
    )
    return first.unionByName(second)


