"""Queries of name, shape and path functions, and of filters over rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import bitemporal, graph, knowledge, relations, retrieval, sync
from marlstone.plans.text_queries import TOLD
from marlstone.session import table

_NOW = 1_720_000_000_000_000


def node_labels(spark, d):
    """Nodes by the label that their id's prefix names."""
    f = table(spark, d, "facts")
    ids = f.where("subject_id is not null").select(F.col("subject_id").alias("id")).unionAll(f.where("id is not null").select("id")).where("id like 'entity-%' or id like 'fact-%'")
    return ids.groupBy(T.label_of("id").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def displayed_sources(spark, d):
    return table(spark, d, "sources").select("id", T.display_of("kind", "name", "status").alias("shown"))


def code_words(spark, d):
    """Words of documents that look like code, and how often they stand there."""
    words = table(spark, d, "documents").where("text is not null").select(F.explode(F.regexp_extract_all("text", F.lit(r"\w+"), F.lit(0))).alias("word"))
    return words.where(retrieval.looks_like_code(F.col("word"))).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def code_lines(spark, d):
    """Lines per document that read like code."""
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count_if(retrieval.line_is_code(F.col("line"))).alias("n_code"), F.count(F.lit(1)).alias("n"))


def cleaned_triples(spark, d):
    """Triples per fact after cleaning; of two-part rows none is left."""
    f = knowledge.with_fields(table(spark, d, "facts")).where("subject is not null and predicate is not null and object is not null")
    raw = F.array(F.array("subject", "predicate", "object"), F.array("subject", "object"), F.array("subject", "predicate", "object"))
    return f.select("fact_row", F.size(T.valid_triples(raw)).alias("n_valid"), F.array_join(F.element_at(T.clean_triples(raw), 1), "|").alias("triple"))


def unique_labels(spark, d):
    return table(spark, d, "labelled_texts").select("text_id", F.array_join(T.unique_strings(F.concat(F.col("areas"), F.array(F.lit(" "), F.lit(" law "), F.lit("law")))), "|").alias("labels"))


def path_suffixes(spark, d):
    """Paths of SQL files and the shorter paths below ``schema`` or ``db`` that they end in."""
    p = table(spark, d, "documents").where("path like '%.sql'").select(F.col("path").alias("a")).distinct()
    short = p.select(F.regexp_extract("a", r"([^/]+/[^/]+)$", 1).alias("b")).where("b <> ''").distinct()
    return knowledge.path_suffix_matches(p, short, "a", "b")


def walkable_facts(spark, d):
    """Facts as edges that a path may take: by kind and confidence."""
    f = knowledge.with_fields(table(spark, d, "facts")).where("predicate is not null")
    e = f.select("fact_row", F.col("predicate").alias("kind"), (F.length("predicate") / 20.0).alias("omega"))
    return graph.walkable(e, 0.5, ("is owned by",)).select("fact_row")


def endpoint_violations(spark, d):
    """Claims whose status, given the kind of source, no claim of the first half of the year 2024 has."""
    s = table(spark, d, "sources").select(F.col("id").alias("source_id"), F.col("kind").alias("subject_kind"), F.col("status").alias("object_kind"))
    c = table(spark, d, "temporal_events").where("claim is not null").select("event_id", "source_id", F.col("claim.predicate").alias("predicate"), F.unix_micros("valid_from").alias("at")).join(s, "source_id")
    allowed = c.where("at between 1704067200000000 and 1719791999999999").select("predicate", "subject_kind", "object_kind").distinct()
    return knowledge.endpoint_violations(c.select("event_id", "predicate", "subject_kind", "object_kind"), allowed).select("event_id")


def newest_sources(spark, d):
    """The third page of the sources, newest first, ties by id."""
    return relations.page(table(spark, d, "sources").select("id", "created_at"), [F.desc("created_at"), "id"], 10, 20).select("id")


def policy_refreshes(spark, d):
    at = F.unix_micros("created_at")
    p = table(spark, d, "sources").select("id", at.alias("verified_us"), (at + 31_536_000_000_000).alias("expires_us"))
    return sync.policy_refresh_due(p, _NOW).select("id", "due")


def stale_views(spark, d):
    """Sources whose rank stands for an authorisation epoch other than 10; a missing one tells nothing."""
    return sync.stale_views(table(spark, d, "sources").select("id", F.col("min_rank").alias("authorization_epoch")), 10).select("id")


def history_gaps(spark, d):
    """Revisions in observations of which none is left open."""
    o = table(spark, d, "observations").select("revision_id", "recorded_to")
    gaps = bitemporal.history_gaps(o.select("revision_id").distinct(), o.where("recorded_to is null"), 10, 5)
    return gaps.select("revision_id", "history_unavailable")


QUERIES = {f.__name__: f for f in (
    node_labels, displayed_sources, code_words, code_lines, cleaned_triples, unique_labels, path_suffixes, walkable_facts, endpoint_violations, newest_sources, policy_refreshes, stale_views, history_gaps,
)}

_CODE_WORD = " OR ".join(f"regexp_matches(word, '{p}')" for p in (r"^[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+$", r"^[a-z]+[a-z0-9]*[A-Z]\w*$", r"^\w*[A-Za-z0-9]_[A-Za-z0-9]\w*$", r"^[A-Z][A-Z0-9]{2,}$"))
_CODE_LINE = " OR ".join(
    f"regexp_matches(line, '{p}')" for p in (r"[;{}]\s*$", r"^\s*(def|class|func|fn|import|from|return|if|for|while|public|private|const|let|var)\b.*[:({;=]", r"^\s*[\w.]+\(.*\)\s*$", r"^\s*@\w+")
)
_CLEAN = r"trim(regexp_replace(regexp_replace(replace(lower({0}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}]', ' ', 'g'), ' +', ' ', 'g'))"
ORACLE = {
    "node_labels": "WITH i AS (SELECT subject_id AS id FROM facts UNION ALL SELECT id FROM facts) SELECT CASE WHEN id LIKE 'entity-%' THEN 'Entity' ELSE 'Fact' END AS label, count(*) AS n FROM i WHERE id LIKE 'entity-%' OR id LIKE 'fact-%' GROUP BY 1",
    "displayed_sources": "SELECT id, CASE WHEN kind = 'commit' THEN left(name, 7) WHEN kind IN ('table', 'column', 'collection') THEN kind || ' ' || name WHEN coalesce(status, '') = '' THEN name ELSE status || '.' || name END AS shown FROM sources",
    "code_words": f"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\\w+')) AS word FROM documents WHERE text IS NOT NULL) WHERE {_CODE_WORD} GROUP BY 1",
    "code_lines": f"SELECT doc_id, count(*) FILTER (WHERE {_CODE_LINE}) AS n_code, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) GROUP BY 1",
    "cleaned_triples": f"""WITH {TOLD}, c AS (SELECT fact_row, {_CLEAN.format('subject')} AS s, {_CLEAN.format('predicate')} AS p, {_CLEAN.format('object')} AS o FROM told WHERE subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL)
SELECT fact_row, 1 AS n_valid, CASE WHEN s <> '' AND o <> '' THEN s || '|' || p || '|' || o END AS triple FROM c""",
    "unique_labels": "SELECT text_id, array_to_string(areas, '|') || CASE WHEN list_contains(areas, 'law') THEN '' ELSE CASE WHEN len(areas) > 0 THEN '|law' ELSE 'law' END END AS labels FROM labelled_texts",
    "path_suffixes": r"""WITH p AS (SELECT DISTINCT path AS a FROM documents WHERE path LIKE '%.sql'), b AS (SELECT DISTINCT regexp_extract(a, '([^/]+/[^/]+)$', 1) AS b FROM p)
SELECT a, b FROM p JOIN b ON b <> '' AND (suffix('/' || a, '/' || b) OR suffix('/' || b, '/' || a))""",
    "walkable_facts": f"WITH {TOLD} SELECT fact_row FROM told WHERE predicate <> 'is owned by' AND length(predicate) >= 10",
    "endpoint_violations": """WITH c AS (SELECT event_id, claim.predicate AS p, kind, status, epoch_us(valid_from) AS t FROM temporal_events JOIN sources ON sources.id = source_id WHERE claim IS NOT NULL)
SELECT event_id FROM c x WHERE NOT EXISTS (SELECT 1 FROM c y WHERE y.t BETWEEN 1704067200000000 AND 1719791999999999 AND y.p = x.p AND y.kind = x.kind AND y.status = x.status)""",
    "newest_sources": "SELECT id FROM sources ORDER BY created_at DESC, id LIMIT 10 OFFSET 20",
    "policy_refreshes": f"SELECT id, {_NOW} >= epoch_us(created_at) + 15768000000000 AS due FROM sources",
    "stale_views": "SELECT id FROM sources WHERE min_rank <> 10",
    "history_gaps": "SELECT DISTINCT revision_id, true AS history_unavailable FROM observations WHERE revision_id NOT IN (SELECT revision_id FROM observations WHERE recorded_to IS NULL AND revision_id IS NOT NULL)",
}
