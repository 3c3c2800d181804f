"""Queries of the temporal operators for the general training-data problems (p2, p3, p4, p6, p7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import asof, change_feed, intervals, late_events, timestamps
from marlstone.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Events that came after the end of their day: corrections and, past the cut-off, too late; read off the merged counter cells."""
    claims = late_events.claim_rows(table(spark, d, "temporal_events"))
    return late_events.late_claims([claims]).where("outcome <> 'on_time'").select("event_id", "outcome")


def p2_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    """Claims per source and UTC day, from three states that overlap: every row is in two of them, and they come in no order of time."""
    claims = late_events.claim_rows(table(spark, d, "temporal_events"))
    carrier = F.pmod(F.xxhash64("event_id"), F.lit(3))
    cells = late_events.merge_cells(*[late_events.delivered_cells(claims.where(carrier != left_out)) for left_out in (2, 0, 1)])
    return late_events.read_counters(late_events.counters(cells, 1)).select(
        "source_id", F.unix_micros("period").alias("period_us"), "n_on_time", "n_corrections", "n_too_late", "n_total"
    )


def _times(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.normalise_times(
        timestamps.stated_times(table(spark, d, "temporal_events"), table(spark, d, "sources"), table(spark, d, "observations"))
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _times(spark, d).select("tbl", "row_key", F.coalesce("problem", timestamps.utc_text(F.col("utc_us"))).alias("utc_value"))


def p3_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """How many texts of each table and grain could be decided, and why not."""
    return _times(spark, d).groupBy("tbl", "grain", F.coalesce("problem", F.lit("decided")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


_SERIES = ("source_id", "scope_key", "predicate")


def _claims(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "temporal_events").where("claim is not null").select(
        "source_id", "scope_key", F.col("claim.predicate").alias("predicate"), F.col("event_id").alias("id"),
        F.unix_micros("valid_from").alias("from_us"), F.unix_micros("valid_to").alias("to_us"),
        F.unix_micros("recorded_from").alias("recorded_us"), F.col("provider_order.ordinal").alias("ordinal"),
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "questions").where("query_mode = 'as_of'").select(
        *_SERIES, "id", F.unix_micros("temporal.valid_at").alias("valid_us"), F.unix_micros("temporal.known_at").alias("known_us")
    )
    found = asof.as_of_join(asked, _claims(spark, d), _SERIES)
    return found.select(F.col("question").alias("question_id"), F.col("claim").alias("event_id"))


def p4_regions(spark: SparkSession, d: str) -> DataFrame:
    """The current-version regions by all that is recorded: when each claim is the current one of its series."""
    regions = asof.current_regions(_claims(spark, d), _SERIES)
    return regions.select(*_SERIES, "from_us", F.coalesce("to_us", F.lit(-1)).alias("to_us"), F.col("claim").alias("event_id"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return change_feed.alive_artifacts(table(spark, d, "changes"))


def p6_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Artifacts per partition, alive and gone."""
    return change_feed.artifact_states(table(spark, d, "changes")).groupBy("partition_key", "is_alive").agg(F.count(F.lit(1)).alias("n"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    spans = intervals.periods_and_gaps(intervals.claim_intervals(table(spark, d, "temporal_events")), _SERIES)
    return spans.select(*_SERIES, "span_kind", F.col("lo").alias("span_from_us"), F.coalesce("hi", F.lit(-1).cast("bigint")).alias("span_to_us"))


QUERIES = {f.__name__: f for f in (p2_found, p2_daily_counts, p3_found, p3_outcomes, p4_found, p4_regions, p6_found, p6_outcomes, p7_found)}

_EVENTS = """
WITH claims AS (
  SELECT event_id, source_id, content_hash, epoch_us(valid_from) AS vf, epoch_us(recorded_from) AS rf
  FROM temporal_events WHERE claim IS NOT NULL AND valid_from IS NOT NULL AND recorded_from IS NOT NULL
), firsts AS (
  SELECT * FROM claims QUALIFY row_number() OVER (
    PARTITION BY source_id, content_hash, CASE WHEN content_hash IS NULL THEN event_id END ORDER BY rf, event_id) = 1
), seen AS (
  SELECT *, vf - ((vf % 86400000000) + 86400000000) % 86400000000 AS day FROM firsts
), judged AS (
  SELECT *, CASE WHEN rf < day + 86400000000 THEN 'on_time' WHEN rf < day + 4 * 86400000000 THEN 'correction' ELSE 'too_late' END AS outcome FROM seen
)
"""
_RUNS = """
WITH firsts AS (
  SELECT ref.partition_key AS pk, ref.external_id AS ext, coalesce(provider_order.ordinal, seq) AS o, operation, ref.provider_revision AS rev, policy_id AS pol
  FROM changes QUALIFY row_number() OVER (PARTITION BY ref.partition_key, ref.external_id, coalesce(provider_order.ordinal, seq) ORDER BY seq) = 1
), upserts AS (
  SELECT *, lag(rev) OVER w IS DISTINCT FROM rev OR row_number() OVER w = 1 AS starts
  FROM firsts WHERE operation = 'upsert' WINDOW w AS (PARTITION BY pk, ext ORDER BY o)
), steps AS (
  SELECT f.*, CASE WHEN u.starts THEN f.o END AS run_at, CASE WHEN f.operation = 'delete' THEN f.o END AS del_at
  FROM firsts f LEFT JOIN upserts u ON f.pk = u.pk AND f.ext = u.ext AND f.o = u.o
), marked AS (
  SELECT *, max(run_at) OVER w AS run_start, max(del_at) OVER w AS last_del FROM steps WINDOW w AS (PARTITION BY pk, ext ORDER BY o)
), ends AS (
  SELECT pk AS partition_key, ext AS external_id, max_by(rev, o) FILTER (WHERE operation = 'upsert') AS provider_revision,
    coalesce(max_by(pol, o) FILTER (WHERE pol IS NOT NULL AND (operation = 'policy_change' OR (operation = 'upsert' AND coalesce(last_del, -1) < run_start))), '') AS policy_id,
    coalesce(max(run_at) > coalesce(max(del_at), -1), false) AS is_alive
  FROM marked GROUP BY 1, 2
)
"""
_TIMES = r"""
WITH stated AS (
  SELECT 'temporal_events' AS tbl, event_id::VARCHAR AS row_key, precision AS grain, source_updated_at AS txt, timezone AS zone FROM temporal_events LEFT JOIN sources ON sources.id = source_id WHERE source_updated_at IS NOT NULL
  UNION ALL SELECT 'observations', id, temporal_precision, source_timestamp_original, source_timezone FROM observations WHERE source_timestamp_original IS NOT NULL
), trimmed AS (SELECT *, regexp_replace(txt, '^\s+|\s+$', '', 'g') AS t FROM stated),
zoned AS (SELECT *, CASE WHEN regexp_matches(t, ':\d\d.*[+-]\d\d:?\d\d$') THEN regexp_extract(t, '([+-]\d\d:?\d\d)$', 1) WHEN regexp_matches(t, '\d[Zz]$') THEN 'Z' END AS own FROM trimmed),
body AS (SELECT *, CASE WHEN own IS NULL THEN t ELSE regexp_replace(t, ' ?([Zz]|[+-]\d\d:?\d\d)$', '') END AS b FROM zoned),
parts AS (SELECT *, CASE WHEN regexp_matches(b, ':\d\d[.,]\d+$') THEN rpad(left(regexp_extract(b, '[.,](\d+)$', 1), 6), 6, '0')::BIGINT ELSE 0 END AS frac, regexp_replace(regexp_replace(b, '[.,]\d+$', ''), '^(\d{4}-\d\d-\d\d)t', '\1T') AS whole FROM body),
parsed AS (SELECT *, CASE WHEN regexp_matches(t, '^(\d{10}|\d{13}|\d{16})$') THEN t::BIGINT * CASE length(t) WHEN 10 THEN 1000000 WHEN 13 THEN 1000 ELSE 1 END END AS epoch,
  epoch_us(try_strptime(CASE WHEN regexp_matches(b, ':\d\d[.,]\d+$') THEN whole ELSE regexp_replace(b, '^(\d{4}-\d\d-\d\d)t', '\1T') END, ['%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M', '%Y-%m-%d %H:%M', '%Y-%m-%d', '%Y-%m', '%Y', '%Y%m%dT%H%M%S', '%d.%m.%Y', '%d.%m.%Y %H:%M',
    '%d.%m.%Y %H:%M:%S', '%m/%d/%Y', '%m/%d/%Y %I:%M %p', '%m/%d/%Y %I:%M:%S %p', '%B %d, %Y %I:%M:%S %p', '%a, %d %b %Y %H:%M:%S', '%a, %d %B %Y %H:%M:%S'])) + frac AS l FROM parts),
offsets AS (SELECT *, coalesce(own, CASE WHEN regexp_matches(zone, '^[+-]\d\d:?\d\d$') THEN zone END) AS o, coalesce(zone, 'UTC') AS z FROM parsed),
fixed AS (SELECT * EXCLUDE (z), CASE WHEN regexp_matches(z, '^[+-]') THEN 'UTC' ELSE z END AS z, CASE WHEN o = 'Z' THEN 0 ELSE (CASE WHEN o[1] = '-' THEN -1 ELSE 1 END) * (o[2:3]::BIGINT * 60 + right(o, 2)::BIGINT) * 60000000 END AS fo FROM offsets),
near AS (SELECT *, epoch_us(timezone(z, timezone('UTC', make_timestamp(l - 86400000000)))) - (l - 86400000000) AS o1, epoch_us(timezone(z, timezone('UTC', make_timestamp(l + 86400000000)))) - (l + 86400000000) AS o2 FROM fixed),
fits AS (SELECT *, epoch_us(timezone(z, timezone('UTC', make_timestamp(l - o1)))) = l AS k1, epoch_us(timezone(z, timezone('UTC', make_timestamp(l - o2)))) = l AS k2 FROM near),
told AS (SELECT tbl, row_key, grain, CASE WHEN epoch IS NULL AND l IS NULL THEN 'invalid' WHEN epoch IS NULL AND fo IS NULL AND zone IS NULL THEN 'unzoned' WHEN epoch IS NULL AND fo IS NULL AND k1 AND k2 AND o1 <> o2 THEN 'ambiguous' WHEN epoch IS NULL AND fo IS NULL AND NOT k1 AND NOT k2 THEN 'nonexistent' END AS problem,
  coalesce(epoch, l - fo, l - CASE WHEN k1 THEN o1 ELSE o2 END) AS u FROM fits)
"""
ORACLE = {
    "p2_found": _EVENTS + "SELECT event_id, outcome FROM judged WHERE outcome <> 'on_time'",
    "p2_daily_counts": _EVENTS + """
SELECT source_id, day AS period_us, count(*) FILTER (WHERE outcome = 'on_time') AS n_on_time, count(*) FILTER (WHERE outcome = 'correction') AS n_corrections,
  count(*) FILTER (WHERE outcome = 'too_late') AS n_too_late, count(*) FILTER (WHERE outcome <> 'too_late') AS n_total FROM judged GROUP BY 1, 2""",
    "p3_found": _TIMES + "SELECT tbl, row_key, coalesce(problem, strftime(make_timestamp(u), '%Y-%m-%dT%H:%M:%S.%fZ')) AS utc_value FROM told",
    "p3_outcomes": _TIMES + "SELECT tbl, grain, coalesce(problem, 'decided') AS outcome, count(*) AS n FROM told GROUP BY 1, 2, 3",
    "p4_found": """
SELECT q.id AS question_id, c.event_id FROM questions q JOIN temporal_events c
  ON c.claim IS NOT NULL AND c.source_id = q.source_id AND c.scope_key = q.scope_key AND c.claim.predicate = q.predicate
  AND c.valid_from <= q.temporal.valid_at AND (c.valid_to IS NULL OR q.temporal.valid_at < c.valid_to) AND c.recorded_from <= q.temporal.known_at
WHERE q.query_mode = 'as_of'
QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY c.provider_order.ordinal DESC NULLS LAST, c.recorded_from DESC, c.event_id DESC) = 1""",
    "p4_regions": """
WITH c AS (
  SELECT source_id, scope_key, claim.predicate AS predicate, event_id, epoch_us(valid_from) AS lo, coalesce(epoch_us(valid_to), 9000000000000000000) AS hi, epoch_us(recorded_from) AS rf, provider_order.ordinal AS o
  FROM temporal_events WHERE claim IS NOT NULL AND valid_from IS NOT NULL AND recorded_from IS NOT NULL AND source_id IS NOT NULL AND scope_key IS NOT NULL AND claim.predicate IS NOT NULL
), b AS (SELECT DISTINCT source_id, scope_key, predicate, unnest([lo, hi]) AS pt FROM c WHERE lo < hi),
slabs AS (SELECT source_id, scope_key, predicate, pt, event_id FROM b LEFT JOIN c USING (source_id, scope_key, predicate) WHERE lo <= pt AND pt < hi
  QUALIFY row_number() OVER (PARTITION BY source_id, scope_key, predicate, pt ORDER BY o DESC NULLS LAST, rf DESC, event_id DESC) = 1),
line AS (SELECT b.*, event_id, lag(event_id) OVER w AS was, lead(pt) OVER w AS upto FROM b LEFT JOIN slabs USING (source_id, scope_key, predicate, pt) WINDOW w AS (PARTITION BY source_id, scope_key, predicate ORDER BY pt)),
runs AS (SELECT *, sum(CASE WHEN event_id IS DISTINCT FROM was THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, scope_key, predicate ORDER BY pt ROWS UNBOUNDED PRECEDING) AS n FROM line)
SELECT source_id, scope_key, predicate, min(pt) AS from_us, CASE WHEN max(upto) = 9000000000000000000 THEN -1 ELSE max(upto) END AS to_us, event_id FROM runs WHERE event_id IS NOT NULL GROUP BY source_id, scope_key, predicate, n, event_id""",
    "p6_found": _RUNS + "SELECT partition_key, external_id, provider_revision, policy_id FROM ends WHERE is_alive",
    "p6_outcomes": _RUNS + "SELECT partition_key, is_alive, count(*) AS n FROM ends GROUP BY 1, 2",
    "p7_found": """
WITH c AS (
  SELECT source_id, scope_key, claim.predicate AS predicate, epoch_us(valid_from) AS lo, coalesce(epoch_us(valid_to), 9000000000000000000) AS hi
  FROM temporal_events WHERE claim IS NOT NULL AND valid_from IS NOT NULL
), swept AS (
  SELECT *, max(hi) OVER (PARTITION BY source_id, scope_key, predicate ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c WHERE lo < hi
), numbered AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, scope_key, predicate ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS n FROM swept
), periods AS (SELECT source_id, scope_key, predicate, n, min(lo) AS lo, max(hi) AS hi FROM numbered GROUP BY 1, 2, 3, 4)
SELECT source_id, scope_key, predicate, 'period' AS span_kind, lo AS span_from_us, CASE WHEN hi = 9000000000000000000 THEN -1 ELSE hi END AS span_to_us FROM periods
UNION ALL
SELECT source_id, scope_key, predicate, 'gap', hi, nxt FROM (
  SELECT *, lead(lo) OVER (PARTITION BY source_id, scope_key, predicate ORDER BY n) AS nxt FROM periods) WHERE nxt IS NOT NULL""",
}
