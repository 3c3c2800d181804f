"""Time texts against an independent parser on zoneinfo."""

import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from marlstone.operators.timestamps import normalise_times, utc_text

MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
UTC = timezone.utc


def brute(text, zone):
    """The answer by trial of explicit formats and of both folds."""
    t = text.strip()
    if re.fullmatch(r"\d{10}|\d{13}|\d{16}", t):
        us = int(t) * {10: 10**6, 13: 10**3, 16: 1}[len(t)]
        return show(datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=us))
    off = None
    m = re.search(r"(?<=[\d])\s?(Z|z|[+-]\d\d:?\d\d)$", t) if re.search(r":|T\d|\dZ$", t) else None
    if m and not re.fullmatch(r"\d{4}-\d\d(-\d\d)?", t):
        off, t = m[1], t[: m.start()]
    frac = 0
    if f := re.search(r"(?<=:\d\d)[.,](\d+)$", t):
        frac, t = int(f[1][:6].ljust(6, "0")), t[: f.start()]
    t = re.sub(r"^\w{3}, ", "", t).replace("t", "T") if re.match(r"\d{4}-\d\d-\d\dt|\w{3}, ", t) else t
    formats = ["%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M", "%Y-%m-%d %H:%M", "%Y-%m-%d", "%Y-%m", "%Y", "%Y%m%dT%H%M%S", "%d.%m.%Y",
               "%d.%m.%Y %H:%M", "%d.%m.%Y %H:%M:%S", "%m/%d/%Y", "%m/%d/%Y %I:%M:%S %p", "%m/%d/%Y %I:%M %p", "%B %d, %Y %I:%M:%S %p", "%d %b %Y %H:%M:%S", "%d %B %Y %H:%M:%S"]
    for fmt in formats:
        try:
            local = datetime.strptime(t, fmt).replace(microsecond=frac)
            break
        except ValueError:
            local = None
    if local is None:
        return "invalid"
    z = off if off is not None else zone
    if z is None:
        return "unzoned"
    if z in "Zz":
        return show(local.replace(tzinfo=UTC))
    if o := re.fullmatch(r"([+-])(\d\d):?(\d\d)", z):
        return show((local - (1 if o[1] == "+" else -1) * timedelta(hours=int(o[2]), minutes=int(o[3]))).replace(tzinfo=UTC))
    tz = ZoneInfo(z)
    fits = {u for fold in (0, 1) if (u := local.replace(tzinfo=tz, fold=fold).astimezone(UTC)).astimezone(tz).replace(tzinfo=None) == local}
    return "nonexistent" if not fits else "ambiguous" if len(fits) > 1 else show(fits.pop())


def show(u):
    return u.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def run(spark, rows):
    df = spark.createDataFrame(rows, "k int, text string, zone string, problem_note string")
    out = normalise_times(df).select("k", F.coalesce("problem", utc_text(F.col("utc_us"))).alias("v")).collect()
    return {r.k: r.v for r in out}


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_against_brute_force_on_whole_tables(spark, sf):
    d = f"/root/testdata/{sf}"
    zones = {r.id: r.timezone for r in spark.read.parquet(f"{d}/sources.parquet").collect()}
    rows = [(r.source_updated_at, zones.get(r.source_id)) for r in spark.read.parquet(f"{d}/temporal_events.parquet").select("source_updated_at", "source_id").collect()]
    rows += [(r[0], r[1]) for r in spark.read.parquet(f"{d}/observations.parquet").select("source_timestamp_original", "source_timezone").collect()]
    rows = [(i, t, z, None) for i, (t, z) in enumerate(rows) if t is not None]
    got = run(spark, rows)
    wrong = [(t, z, got[i], brute(t, z)) for i, t, z, _ in rows if got[i] != brute(t, z)]
    assert not wrong, wrong[:5]


def test_policies(spark):
    cases = [
        ("2024-03-31 02:30", "Europe/Berlin", "nonexistent"), ("2024-10-27 02:30", "Europe/Berlin", "ambiguous"),
        ("2024-10-27 02:30+01:00", "Europe/Berlin", "2024-10-27T01:30:00.000000Z"), ("2024-04-07 01:45", "Australia/Lord_Howe", "ambiguous"),
        ("2024-01-01 00:00:00.1234567", "UTC", "2024-01-01T00:00:00.123456Z"), ("2023-02-29", "UTC", "invalid"), ("2024-02-29", "+05:30", "2024-02-28T18:30:00.000000Z"),
        ("12/31/2024 12:00 AM", "UTC", "2024-12-31T00:00:00.000000Z"), ("13/01/2024", "UTC", "invalid"), ("", "UTC", "invalid"), ("soon", None, "invalid"),
        ("2024-05-01", None, "unzoned"), ("2024-05-01", "Mars/Olympus", "unzoned"), ("2024-05-01T10:00+25:00", "UTC", "invalid"), ("1706304108", None, "2024-01-26T21:21:48.000000Z"),
        ("2024", "Asia/Tokyo", "2023-12-31T15:00:00.000000Z"), ("x" * 100_000, "UTC", "invalid"), (None, "UTC", None), ("25:61", "UTC", "invalid"), ("1969-12-31T23:59:59.999999Z", None, "1969-12-31T23:59:59.999999Z"),
        ("2024-05-01 24:00", "UTC", "invalid"), ("00/10/2024", "UTC", "invalid"), ("May 5, 2024 13:00:00 PM", "UTC", "invalid"),
    ]
    got = run(spark, [(i, t, z, None) for i, (t, z, _) in enumerate(cases)])
    assert [got[i] for i in range(len(cases))] == [w for _, _, w in cases]


def test_session_zone_does_not_matter_and_empty_input(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert run(spark, [(0, "2024-10-27 12:30", "Europe/Berlin", None)]) == {0: "2024-10-27T11:30:00.000000Z"}
        assert run(spark, []) == {}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
