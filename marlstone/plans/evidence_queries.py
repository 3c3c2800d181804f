"""Queries of bitemporal selection, conflicts, intake, evaluation, streams and standard analytics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.operators import asof, bitemporal, evaluation, knowledge, relations, sync
from marlstone.operators.bitemporal import Selector
from marlstone.plans.temporal_queries import ORACLE as TEMPORAL_SQL
from marlstone.plans.text_queries import TOLD
from marlstone.session import ensure_checkpoint_dir, table
from marlstone.sources import change_pages
from marlstone.streaming import feed, late_counts

_AT, _TO, _KNOWN = 1_730_000_000_000_000, 1_740_000_000_000_000, 1_745_000_000_000_000


def _observed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "observations").select(
        "id", "object_id", "evidence_class", F.unix_micros("valid_from").alias("from_us"), F.unix_micros("valid_to").alias("to_us"), F.unix_micros("recorded_from").alias("recorded_us"),
        F.unix_micros("recorded_to").alias("recorded_to_us"), F.col("temporal_precision").alias("precision"), "validity_kind",
    )


def _decisions(spark: SparkSession, d: str, s: Selector) -> DataFrame:
    return bitemporal.decide(_observed(spark, d), s).select("id", "decision", "reason")


def asof_point(spark, d):
    return _decisions(spark, d, Selector("as_of", _KNOWN, _AT))


def during_overlap(spark, d):
    return _decisions(spark, d, Selector("during", _KNOWN, _AT, _TO))


def throughout_cover(spark, d):
    return _decisions(spark, d, Selector("throughout", _KNOWN, _AT, _TO))


def atemporal_rows(spark, d):
    return _decisions(spark, d, Selector("atemporal", _KNOWN))


def changes_between(spark, d):
    return bitemporal.changes_between(_observed(spark, d), "effective", _AT, _TO, _KNOWN).select("id", "decision", "reason")


def compare_sides(spark, d):
    return bitemporal.compare_sides(_observed(spark, d), ["object_id"], "evidence_class", Selector("as_of", _KNOWN, _AT), Selector("as_of", _KNOWN, _TO))


def _claims(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "temporal_events").where("claim is not null").select(
        "source_id", "scope_key", F.col("claim.predicate").alias("predicate"), F.col("claim.object").alias("object"), F.col("event_id").alias("version_id"), F.col("provider_order.ordinal").alias("ordinal"),
        F.unix_micros("valid_from").alias("from_us"), F.unix_micros("valid_to").alias("to_us"), F.unix_micros("recorded_from").alias("recorded_us"), "provider_order",
    )


_SERIES = ["source_id", "scope_key", "predicate"]


def _ordered(spark: SparkSession, d: str) -> DataFrame:
    return _claims(spark, d).select(*_SERIES, "version_id", F.col("provider_order.adapter").alias("adapter"), F.col("provider_order.version").alias("adapter_version"), F.col("provider_order.kind").alias("kind"), "ordinal")


def same_source_current(spark, d):
    return bitemporal.current_versions(_ordered(spark, d), _SERIES).withColumn("ordinal", F.coalesce("ordinal", F.lit(-1)))


def conflict_sets(spark, d):
    rows = _claims(spark, d).where("to_us is null or from_us is null or from_us < to_us").select(*_SERIES, "object", "from_us", "to_us")
    return bitemporal.conflict_sets(rows, _SERIES).select(*_SERIES, "n_objects", "status", F.coalesce("from_us", F.lit(0)).alias("from_us"), F.coalesce("to_us", F.lit(0)).alias("to_us"))


def order_relations(spark, d):
    """How each version relates to the one before it, by id, of the same series and start."""
    c = _claims(spark, d).where("from_us is not null").select(*_SERIES, "from_us", "version_id", F.struct("provider_order.adapter", "provider_order.version", "provider_order.kind", "provider_order.ordinal").alias("b"))
    near = Window.partitionBy(*_SERIES, "from_us").orderBy("version_id")
    pairs = c.select("version_id", F.lag("version_id").over(near).alias("before_id"), F.lag("b").over(near).alias("a"), "b").where("before_id is not null")
    return bitemporal.order_relation(pairs).select("before_id", "version_id", "relation")


def replayed(spark, d):
    return bitemporal.replay(_claims(spark, d).withColumnRenamed("version_id", "id"), _KNOWN).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


def superseded_versions(spark, d):
    """Versions that a greater ordinal of their series supersedes and that are current nowhere."""
    return bitemporal.fully_superseded(*bitemporal.superseded_and_current(_ordered(spark, d), _SERIES))


def recorded_closures(spark, d):
    o = _observed(spark, d).select("id", "recorded_us", "recorded_to_us")
    closures = o.where("recorded_to_us is null").select("id")
    staged = o.where("recorded_to_us is null").select(F.concat("id", F.lit("-next")).alias("id"), F.lit(_KNOWN).alias("recorded_us"), F.lit(None).cast("bigint").alias("recorded_to_us"))
    out = bitemporal.closed_and_appended(o, closures, staged, _KNOWN)
    return out.groupBy(F.col("recorded_to_us").isNull().alias("is_open")).agg(F.count(F.lit(1)).alias("n"))


def pending_log(spark, d):
    return sync.pending_log(table(spark, d, "changes"))


def page_summary(spark, d):
    return sync.page_summary(table(spark, d, "changes"))


def inferred_deletes(spark, d):
    """Artifacts that a full scan in the second half of the feed would not have seen."""
    c = table(spark, d, "changes")
    half = c.agg(F.max("seq")).first()[0] // 2
    keys = ["partition_key", "external_id"]
    known = c.select("ref.partition_key", "ref.external_id").distinct()
    seen = c.where((F.col("seq") > half) & (F.col("operation") != "delete")).select("ref.partition_key", "ref.external_id")
    return sync.inferred_deletes(known, seen, keys, True, True)


def contract_violations(spark, d):
    return sync.contract_violations(table(spark, d, "changes"))


def reconcile_due(spark, d):
    s = table(spark, d, "sources").select("id", F.unix_micros("created_at").alias("last_us"))
    return sync.reconcile_due(s, 1_690_000_000_000_000).select("id", "due")


def interrupted_jobs(spark, d):
    s = table(spark, d, "sources").select("id", "status", F.lit(None).cast("string").alias("error"))
    return sync.recovered_jobs(s).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def store_stats(spark, d):
    out = None
    for name in ("sources", "passages", "facts", "questions", "observations", "temporal_events", "changes", "documents"):
        one = table(spark, d, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tbl"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def source_counts(spark, d):
    s = table(spark, d, "sources").select("id", "created_at")
    p = table(spark, d, "passages").groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("n_passages"))
    f = table(spark, d, "facts").groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("n_facts"))
    return s.join(p, "id", "left").join(f, "id", "left").na.fill(0, ["n_passages", "n_facts"]).orderBy(F.desc("created_at"), "id").select("id", "n_passages", "n_facts")


def _ranking(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Per question the 20 claims of its series that were recorded last; gold are the claims that hold at the asked time, an alternative per object."""
    q = table(spark, d, "questions").select(F.col("id").alias("qid"), *_SERIES, F.unix_micros("temporal.valid_at").alias("at")).where("at is not null")
    claims = _claims(spark, d).select(*_SERIES, F.col("version_id").alias("item"), F.col("object").alias("alternative"), "from_us", "to_us", "recorded_us")
    latest = relations.top(claims.select(*_SERIES, "item", "recorded_us"), [F.desc("recorded_us"), "item"], 20, _SERIES)
    rows = q.join(latest, _SERIES).select("qid", "item", "rank")
    return rows, asof.covering(q, claims, _SERIES, "at", "from_us", "to_us").select("qid", "item", "alternative")


def recall_at_k(spark, d):
    rows, gold = _ranking(spark, d)
    return evaluation.recall_at(rows, gold).select("qid", *[F.round(f"recall_{k}", 6).alias(f"recall_{k}") for k in evaluation.CUTS], "gold_rank")


def ndcg_mrr(spark, d):
    rows, gold = _ranking(spark, d)
    m = evaluation.evidence_metrics(rows, gold)
    return m.select("qid", *[F.round(c, 6).alias(c) for c in m.columns[1:]])


def _answers(spark: SparkSession, d: str) -> DataFrame:
    f = knowledge.with_fields(table(spark, d, "facts")).where("subject is not null and object is not null")
    return f.select(F.col("fact_row").alias("qid"), F.concat_ws(" ", "subject", "predicate").alias("actual"), F.explode(F.array(F.concat_ws(" ", "predicate", "object"), F.col("subject"))).alias("expected"))


def token_f1(spark, d):
    return evaluation.token_f1(_answers(spark, d)).select("qid", F.round("f1", 6).alias("f1"))


def exact_matches(spark, d):
    return evaluation.exact_match(_answers(spark, d)).groupBy("em").agg(F.count(F.lit(1)).alias("n"))


def _results(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "questions")
    lag = (F.unix_micros("temporal.known_at") - F.unix_micros("temporal.valid_at")) / 86_400_000_000
    return q.select(
        "slice", "split", F.when(F.col("expected_insufficiency"), "incorrect").when(lag > 60, "partially_correct").when(lag.isNotNull(), "correct").alias("verdict"), lag.alias("lag_days"),
        F.when(lag < 0, F.lit("time_order")).alias("error_code"), (~F.col("expected_insufficiency")).alias("has_gold"), F.floor(F.abs(lag) / 20).alias("gold_rank"),
    )


def run_summary(spark, d):
    return evaluation.run_summary(_results(spark, d), ("lag_days",))


def slice_means(spark, d):
    return evaluation.slice_means(_results(spark, d), "slice", ("lag_days",))


def compare_runs(spark, d):
    r = _results(spark, d)
    return evaluation.compare_runs(r.where("split = 'dev'"), r.where("split = 'holdout'"), "slice", ("lag_days",))


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def stream_final_state(spark, d):
    """State after the feed has come in page by page as a stream from the connector's data source."""
    change_pages.register(spark)
    at = _folder(spark)
    pages = spark.readStream.format("change_pages").option("path", f"{d}/changes.parquet").load()
    feed.start(pages, f"{at}/log", f"{at}/checkpoint").awaitTermination()
    return feed.current_state(spark, f"{at}/log")


def paged_feed(spark, d):
    """The same source read as a batch."""
    change_pages.register(spark)
    return spark.read.format("change_pages").option("path", f"{d}/changes.parquet").load().groupBy("partition_key", "operation").agg(F.count(F.lit(1)).alias("n"))


def stream_late_counts(spark, d):
    """Corrected daily counts from a stream of claims."""
    at = _folder(spark)
    reader = spark.readStream.schema(table(spark, d, "temporal_events").schema)
    file = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/temporal_events.parquet")
    if file.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(file).isFile():
        rows = reader.option("pathGlobFilter", "temporal_events.parquet").parquet(d)
    else:
        rows = reader.parquet(f"{d}/temporal_events.parquet")
    claims = rows.where("claim is not null").select("event_id", "source_id", "content_hash", "valid_from", "recorded_from")
    late_counts.start(claims, f"{at}/state", f"{at}/checkpoint").awaitTermination()
    late_counts.publish(spark, f"{at}/state", f"{at}/counts")
    return late_counts.read(spark, f"{at}/counts").select("source_id", F.unix_micros("period").alias("period_us"), "n_on_time", "n_corrections", "n_too_late", "n_total")


def price_summary(spark, d):
    l = table(spark, d, "lineitem")
    dec = lambda c: F.col(c).cast("decimal(18,4)")
    return l.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(dec("l_extendedprice") * (1 - dec("l_discount"))).cast("double"), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n")
    )


def revenue_cube(spark, d):
    o = table(spark, d, "orders")
    return o.cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double"), 2).alias("total"))


def revenue_rollup(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double"), 2).alias("balance"))


def running_totals(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.row_number().over(w).alias("nth"), F.lag("o_orderkey").over(w).alias("before_key"), F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("double"), 2).alias("running")).na.fill(0, ["before_key"])


def top_parts(spark, d):
    l = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("qty"))
    return relations.top(l, [F.desc("qty"), "l_partkey"], 3, ["l_suppkey"])


def _wall_us(column: str):
    """Microseconds since 1970 of a time without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def hourly_windows(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("value").cast("decimal(18,4)")).cast("double"), 3).alias("total")).select(_wall_us("w.start").alias("start_us"), "event_type", "n", "total")


def sessions(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", _wall_us("w.start").alias("start_us"), "n")


QUERIES = {f.__name__: f for f in (
    asof_point, during_overlap, throughout_cover, atemporal_rows, changes_between, compare_sides, same_source_current, conflict_sets, order_relations, replayed, superseded_versions, recorded_closures, pending_log, page_summary,
    inferred_deletes, contract_violations, reconcile_due, interrupted_jobs, store_stats, source_counts, recall_at_k, ndcg_mrr, token_f1, exact_matches, run_summary, slice_means, compare_runs, stream_final_state, paged_feed,
    stream_late_counts, price_summary, revenue_cube, revenue_rollup, running_totals, top_parts, hourly_windows, sessions,
)}


_OBSERVED = f"""
WITH o AS (SELECT id, object_id, evidence_class, coalesce(validity_kind, 'unknown') AS kind, epoch_us(valid_from) AS vf, epoch_us(valid_to) AS vt, coalesce(temporal_precision = 'instant', false) AS exact, epoch_us(recorded_from) AS rf, epoch_us(recorded_to) AS rt FROM observations),
k AS (SELECT *, CASE WHEN coalesce(rf > {_KNOWN}, true) THEN 'recorded_after_cutoff' WHEN rt <= {_KNOWN} THEN 'recorded_closed' END AS late FROM o)
"""


def _decide_sql(steps: list[tuple[str, str, str]]) -> str:
    """``steps``: condition, decision and reason, the first that holds decides."""
    whens = lambda part: " ".join(f"WHEN {c[0]} THEN '{c[part]}'" for c in steps)
    return _OBSERVED + f"SELECT id, CASE WHEN late IS NOT NULL THEN 'excluded' {whens(1)} END AS decision, CASE WHEN late IS NOT NULL THEN late {whens(2)} END AS reason FROM k"


def _interval_sql(held: str, timeless: bool = False) -> str:
    first = [("kind = 'atemporal'", "proven", "atemporal_match")] if timeless else []
    return _decide_sql([*first, ("kind <> 'explicit_interval' OR vf IS NULL", "contextual", "effective_unknown"), ("NOT exact", "contextual", "effective_imprecise"), (held, "proven", "effective_match"), ("true", "excluded", "effective_outside")])


_POINT = "vf <= {0} AND (vt IS NULL OR {0} < vt)"
_CLAIMS = """
c AS (SELECT source_id, scope_key, claim.predicate AS predicate, claim.object AS object, event_id AS version_id, provider_order.ordinal AS ordinal, epoch_us(valid_from) AS vf, epoch_us(valid_to) AS vt, epoch_us(recorded_from) AS rf, provider_order AS po
  FROM temporal_events WHERE claim IS NOT NULL)"""
_VERSIONS = """v AS (SELECT DISTINCT source_id, scope_key, predicate, po.adapter AS adapter, po.version AS adapter_version, version_id, CASE WHEN po.kind = 'monotonic' THEN ordinal END AS o FROM c),
k AS (SELECT *, max(o) OVER (PARTITION BY source_id, scope_key, predicate, adapter, adapter_version) AS top FROM v)"""
_RANKING = f"""
WITH {_CLAIMS},
q AS (SELECT id AS qid, source_id, scope_key, predicate, epoch_us(temporal.valid_at) AS at_us FROM questions WHERE temporal.valid_at IS NOT NULL),
l AS (SELECT source_id, scope_key, predicate, version_id AS item, row_number() OVER (PARTITION BY source_id, scope_key, predicate ORDER BY rf DESC, version_id) AS rank FROM c QUALIFY rank <= 20),
r AS (SELECT qid, item, rank FROM q JOIN l USING (source_id, scope_key, predicate)),
gr AS (SELECT DISTINCT q.qid, version_id AS item, object, rank FROM q JOIN c USING (source_id, scope_key, predicate) LEFT JOIN r ON r.qid = q.qid AND r.item = version_id WHERE vf <= at_us AND (vt IS NULL OR at_us < vt))
"""
_RESULTS = """
WITH x AS (SELECT slice, split, expected_insufficiency AS ei, (epoch_us(temporal.known_at) - epoch_us(temporal.valid_at)) / 86400000000.0 AS lag_days FROM questions),
res AS (SELECT *, CASE WHEN ei THEN 'incorrect' WHEN lag_days > 60 THEN 'partially_correct' WHEN lag_days IS NOT NULL THEN 'correct' END AS verdict, CASE WHEN lag_days < 0 THEN 'time_order' END AS error_code FROM x)
"""
_NORM = r"list_filter(string_split_regex(regexp_replace(lower({0}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the'))"
_ANSWERS = f"""
WITH {TOLD}, f AS (SELECT fact_row AS qid, concat_ws(' ', subject, predicate) AS actual, unnest([concat_ws(' ', predicate, object), subject]) AS expected FROM told WHERE subject IS NOT NULL AND object IS NOT NULL),
n AS (SELECT qid, {_NORM.format('actual')} AS a, {_NORM.format('expected')} AS e FROM f)
"""
ORACLE = {
    "asof_point": _interval_sql(_POINT.format(_AT), True),
    "during_overlap": _interval_sql(f"vf < {_TO} AND (vt IS NULL OR {_AT} < vt)"),
    "throughout_cover": _interval_sql(f"vf <= {_AT} AND (vt IS NULL OR {_TO} <= vt)"),
    "atemporal_rows": _decide_sql([("kind = 'atemporal'", "proven", "atemporal_match"), ("kind IN ('unknown', 'observed_snapshot')", "contextual", "effective_unknown"), ("true", "excluded", "effective_outside")]),
    "changes_between": _decide_sql([("kind <> 'explicit_interval' OR vf IS NULL OR NOT exact", "contextual", "change_clock_unknown"), (f"vf >= {_AT} AND vf < {_TO}", "proven", "change_match"), ("true", "excluded", "change_outside")]),
    "compare_sides": _OBSERVED + f""", p AS (SELECT * FROM k WHERE late IS NULL AND (kind = 'atemporal' OR (kind = 'explicit_interval' AND exact))),
b AS (SELECT object_id, string_agg(DISTINCT evidence_class, '|' ORDER BY evidence_class) AS before FROM p WHERE kind = 'atemporal' OR ({_POINT.format(_AT)}) GROUP BY 1), a AS (SELECT object_id, string_agg(DISTINCT evidence_class, '|' ORDER BY evidence_class) AS after FROM p WHERE kind = 'atemporal' OR ({_POINT.format(_TO)}) GROUP BY 1)
SELECT object_id, before, after, CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' WHEN before = after THEN 'same' ELSE 'changed' END AS change FROM b FULL JOIN a USING (object_id)""",
    "same_source_current": f"""WITH {_CLAIMS}, {_VERSIONS}
SELECT source_id, scope_key, predicate, adapter, adapter_version, coalesce(top, -1) AS ordinal, count(*) FILTER (WHERE o IS NULL OR o = top) AS n_versions, count(*) FILTER (WHERE o IS NULL OR o = top) > 1 AS is_ambiguous, count(*) FILTER (WHERE o < top) AS n_superseded FROM k GROUP BY 1, 2, 3, 4, 5, 6""",
    "conflict_sets": f"""WITH {_CLAIMS}, r AS (SELECT source_id, scope_key, predicate, object, vf, vt, row_number() OVER () AS i FROM c WHERE vt IS NULL OR vf IS NULL OR vf < vt),
g AS (SELECT source_id, scope_key, predicate, count(DISTINCT object) AS n_objects, max(vf) AS lo, min(vt) AS hi, count(*) FILTER (WHERE vf IS NULL) AS unknown FROM r GROUP BY 1, 2, 3 HAVING count(DISTINCT object) >= 2),
p AS (SELECT DISTINCT x.source_id, x.scope_key, x.predicate FROM r x JOIN r y ON x.source_id = y.source_id AND x.scope_key = y.scope_key AND x.predicate = y.predicate AND x.object < y.object AND (y.vt IS NULL OR x.vf < y.vt) AND (x.vt IS NULL OR y.vf < x.vt) WHERE x.vf IS NOT NULL AND y.vf IS NOT NULL),
s AS (SELECT g.*, CASE WHEN unknown = 0 AND (hi IS NULL OR lo < hi) THEN 'unresolved' WHEN unknown > 0 OR p.source_id IS NOT NULL THEN 'possible' END AS status FROM g LEFT JOIN p USING (source_id, scope_key, predicate))
SELECT source_id, scope_key, predicate, n_objects, status, CASE WHEN status = 'unresolved' THEN lo ELSE 0 END AS from_us, CASE WHEN status = 'unresolved' THEN coalesce(hi, 0) ELSE 0 END AS to_us FROM s WHERE status IS NOT NULL""",
    "order_relations": f"""WITH {_CLAIMS}, l AS (SELECT version_id, po AS y, lag(version_id) OVER w AS before_id, lag(po) OVER w AS x FROM c WHERE vf IS NOT NULL WINDOW w AS (PARTITION BY source_id, scope_key, predicate, vf ORDER BY version_id))
SELECT before_id, version_id, CASE WHEN NOT coalesce(x.adapter = y.adapter AND x.version = y.version AND x.kind = 'monotonic' AND y.kind = 'monotonic' AND x.ordinal IS NOT NULL AND y.ordinal IS NOT NULL, false) THEN 'ambiguous' WHEN x.ordinal < y.ordinal THEN 'older' WHEN x.ordinal = y.ordinal THEN 'same' ELSE 'newer' END AS relation FROM l WHERE before_id IS NOT NULL""",
    "replayed": f"WITH {_CLAIMS} SELECT source_id, count(*) AS n FROM c WHERE rf <= {_KNOWN} GROUP BY 1",
    "superseded_versions": f"WITH {_CLAIMS}, {_VERSIONS} SELECT DISTINCT version_id FROM k WHERE o < top AND version_id NOT IN (SELECT version_id FROM k WHERE o IS NULL OR o = top)",
    "recorded_closures": "SELECT false AS is_open, count(*) AS n FROM observations UNION ALL SELECT true, count(*) FROM observations WHERE recorded_to IS NULL",
    "pending_log": "SELECT ref.partition_key AS partition_key, ref.external_id AS external_id, max(seq) AS seq, arg_max(operation, seq) AS operation FROM changes GROUP BY 1, 2",
    "page_summary": "SELECT page_no, count(*) AS n_changes, min(seq) AS first_seq, max(seq) AS last_seq, count(DISTINCT ref.partition_key) AS n_partitions FROM changes GROUP BY 1",
    "inferred_deletes": "SELECT DISTINCT ref.partition_key AS partition_key, ref.external_id AS external_id FROM changes EXCEPT SELECT ref.partition_key, ref.external_id FROM changes WHERE seq > (SELECT max(seq) // 2 FROM changes) AND operation <> 'delete'",
    "contract_violations": """WITH v AS (SELECT unnest([
  {'rule': 'upsert_without_revision', 'n': count(*) FILTER (WHERE operation = 'upsert' AND ref.provider_revision IS NULL)}, {'rule': 'policy_change_without_policy', 'n': count(*) FILTER (WHERE operation = 'policy_change' AND policy_id IS NULL)},
  {'rule': 'partition_missing', 'n': count(*) FILTER (WHERE ref.partition_key IS NULL)}, {'rule': 'external_id_missing', 'n': count(*) FILTER (WHERE trim(coalesce(ref.external_id, '')) = '')},
  {'rule': 'operation_unknown', 'n': count(*) FILTER (WHERE coalesce(operation NOT IN ('upsert', 'delete', 'policy_change'), true))}, {'rule': 'ordinal_without_order', 'n': count(*) FILTER (WHERE provider_order.kind = 'monotonic' AND provider_order.ordinal IS NULL)},
  {'rule': 'order_without_ordinal', 'n': count(*) FILTER (WHERE provider_order.kind <> 'monotonic' AND provider_order.ordinal IS NOT NULL)}, {'rule': 'received_missing', 'n': count(*) FILTER (WHERE received_at IS NULL)}]) AS s FROM changes)
SELECT s.rule AS rule, s.n AS n FROM v WHERE s.n > 0""",
    "reconcile_due": "SELECT id, coalesce(1690000000000000 - epoch_us(created_at) >= 86400000000, true) AS due FROM sources",
    "interrupted_jobs": "SELECT CASE WHEN status IN ('indexing', 'running') THEN 'failed' ELSE status END AS status, count(*) AS n FROM sources GROUP BY 1",
    "store_stats": " UNION ALL ".join(f"SELECT '{t}' AS tbl, count(*) AS n FROM {t}" for t in ("sources", "passages", "facts", "questions", "observations", "temporal_events", "changes", "documents")),
    "source_counts": "SELECT id, (SELECT count(*) FROM passages p WHERE p.source_id = s.id) AS n_passages, (SELECT count(*) FROM facts f WHERE f.source_id = s.id) AS n_facts FROM sources s",
    "recall_at_k": _RANKING + "SELECT qid, " + ", ".join(f"round(count(*) FILTER (WHERE rank <= {k}) / count(*)::DOUBLE, 6) AS recall_{k}" for k in (1, 2, 5, 10, 20)) + ", min(rank) AS gold_rank FROM (SELECT DISTINCT qid, item, rank FROM gr) GROUP BY 1",
    "ndcg_mrr": _RANKING + """,
i AS (SELECT qid, count(*) AS n, coalesce(1.0 / min(rank), 0) AS mrr, coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE rank <= 10), 0) AS dcg, """ + ", ".join(f"max(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END) AS a{k}" for k in (5, 10, 20)) + """ FROM (SELECT DISTINCT qid, item, rank FROM gr) GROUP BY 1),
g AS (SELECT qid, object, """ + ", ".join(f"count(*) FILTER (WHERE rank <= {k}) / count(*)::DOUBLE AS e{k}" for k in (5, 10, 20)) + """ FROM gr GROUP BY 1, 2),
s AS (SELECT qid, """ + ", ".join(f"max(e{k}) AS e{k}, max(CASE WHEN e{k} = 1 THEN 1.0 ELSE 0.0 END) AS s{k}" for k in (5, 10, 20)) + """ FROM g GROUP BY 1)
SELECT qid, round(mrr::DOUBLE, 6) AS mrr, round(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda k: 1 / log2(k + 1))), 6) AS ndcg, """ + ", ".join(f"a{k}::DOUBLE AS any_hit_{k}, round(e{k}, 6) AS evidence_recall_{k}, s{k}::DOUBLE AS all_required_{k}" for k in (5, 10, 20)) + " FROM i JOIN s USING (qid)",
    "token_f1": _ANSWERS + """, k AS (SELECT qid, a, e, coalesce(list_sum(list_transform(list_distinct(a), lambda w: least(len(list_filter(a, lambda x: x = w)), len(list_filter(e, lambda x: x = w))))), 0) AS c FROM n)
SELECT qid, round(max(CASE WHEN c = 0 THEN 0.0 ELSE 2.0 * c / (len(a) + len(e)) END)::DOUBLE, 6) AS f1 FROM k GROUP BY 1""",
    "exact_matches": _ANSWERS + "SELECT em, count(*) AS n FROM (SELECT qid, max(CASE WHEN array_to_string(a, ' ') = array_to_string(e, ' ') THEN 1.0 ELSE 0.0 END)::DOUBLE AS em FROM n GROUP BY 1) GROUP BY 1",
    "run_summary": _RESULTS + "SELECT count(*) AS n, count(*) FILTER (WHERE verdict = 'correct') AS n_correct, count(*) FILTER (WHERE verdict = 'partially_correct') AS n_partial, count(*) FILTER (WHERE verdict = 'incorrect') AS n_incorrect, round(avg(CASE WHEN coalesce(floor(abs(lag_days) / 20) <= 5, false) THEN 1.0 ELSE 0.0 END) FILTER (WHERE NOT ei), 4) AS gold_in_top, round(avg(lag_days), 4) AS mean_lag_days, coalesce(string_agg(DISTINCT error_code, ',' ORDER BY error_code), '') AS error_codes FROM res",
    "slice_means": _RESULTS + "SELECT slice, round(avg(lag_days), 4) AS mean_lag_days, count(lag_days) AS n_lag_days FROM res GROUP BY 1",
    "compare_runs": _RESULTS + """, a AS (SELECT slice, round(avg(lag_days), 4) AS b FROM res WHERE split = 'dev' GROUP BY 1), o AS (SELECT slice, round(avg(lag_days), 4) AS o FROM res WHERE split = 'holdout' GROUP BY 1)
SELECT slice, b AS base_lag_days, o AS other_lag_days, round(o - b, 4) AS change_lag_days FROM a FULL JOIN o USING (slice)""",
    "stream_final_state": TEMPORAL_SQL["p6_found"],
    "paged_feed": "SELECT ref.partition_key AS partition_key, operation, count(*) AS n FROM changes GROUP BY 1, 2",
    "stream_late_counts": TEMPORAL_SQL["p2_daily_counts"],
    "price_summary": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice::DECIMAL(18,4) * (1 - l_discount::DECIMAL(18,4)))::DOUBLE, 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "revenue_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice::DECIMAL(18,2))::DOUBLE, 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "revenue_rollup": "SELECT r_name, n_name, count(*) AS n, round(sum(c_acctbal::DECIMAL(18,2))::DOUBLE, 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
    "running_totals": "SELECT o_orderkey, row_number() OVER w AS nth, coalesce(lag(o_orderkey) OVER w, 0) AS before_key, round((sum(o_totalprice::DECIMAL(18,2)) OVER w)::DOUBLE, 2) AS running FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "top_parts": "WITH q AS (SELECT l_suppkey, l_partkey, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY qty DESC, l_partkey) AS rank FROM q QUALIFY rank <= 3",
    "hourly_windows": "SELECT (epoch_us(ts) // 3600000000) * 3600000000 AS start_us, event_type, count(*) AS n, round(sum(value::DECIMAL(18,4))::DOUBLE, 3) AS total FROM events GROUP BY 1, 2",
    "sessions": """WITH l AS (SELECT user_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
s AS (SELECT user_id, t, sum(CASE WHEN p IS NULL OR t - p >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM l)
SELECT user_id, min(t) AS start_us, count(*) AS n FROM s GROUP BY user_id, g""",
}
