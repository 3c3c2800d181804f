"""Queries of access, publication, code and merge operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import access, change_feed, codegraph, evaluation, graph, knowledge, relations, retrieval, sync
from marlstone.plans.graph_queries import _TRIPLES
from marlstone.plans.temporal_queries import ORACLE as TEMPORAL_SQL
from marlstone.plans.text_queries import TOLD
from marlstone.session import table

#: Role ladder of the test data (fixed values).
ROLES = (("reader", 0), ("operator", 10), ("admin", 20))


def _roles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ROLES), "id string, rank bigint")


def _visible(spark: SparkSession, d: str) -> DataFrame:
    return access.visible_sources(table(spark, d, "sources"), "user-001", 0)


def roles_within(spark, d):
    return access.roles_within(_roles(spark), 10)


def source_ranks(spark, d):
    return access.set_source_ranks(table(spark, d, "sources"), _roles(spark)).select("id", F.coalesce("min_rank", F.lit(-1)).alias("min_rank"))


def supported_facts(spark, d):
    """Facts with a passage of a visible source behind them."""
    f = table(spark, d, "facts").where("passage_id is not null")
    supports = f.select(F.col("id").alias("assertion_id"), F.col("passage_id").alias("group_no"), F.col("passage_id").alias("span_id")).distinct()
    spans = table(spark, d, "passages").join(_visible(spark, d).select(F.col("id").alias("source_id")), "source_id", "left_semi").select(F.col("id").alias("span_id"))
    return access.supported(supports, spans)


def evidence_counts(spark, d):
    """The closure from sources down to facts: how much of each layer a principal may see."""
    s = table(spark, d, "sources").select(F.col("id").alias("artifact_id"), F.col("access_role_id").alias("policy_id"))
    p = table(spark, d, "passages")
    f = table(spark, d, "facts").where("subject_id is not null and object_id is not null and passage_id is not null")
    grants = access.roles_within(_roles(spark), 10).select(F.col("id").alias("policy_id"), F.lit(9).cast("bigint").alias("valid_until"))
    seen = access.evidence_closure(
        s, p.select(F.col("id").alias("revision_id"), F.col("source_id").alias("artifact_id")), p.select(F.col("id").alias("span_id"), F.col("id").alias("revision_id"), F.lit("reader").alias("policy_id")),
        f.select(F.col("fact_row").alias("observation_id"), F.col("passage_id").alias("span_id"), F.explode(F.array("subject_id", "object_id")).alias("object_id")),
        f.select(F.col("id").alias("assertion_id"), "subject_id", "object_id").distinct(), f.select(F.col("id").alias("assertion_id"), F.col("passage_id").alias("group_no"), F.col("passage_id").alias("span_id")).distinct(),
        grants, s.where("artifact_id is null").select(F.col("artifact_id").alias("id")),
    )
    out = None
    for layer in ("artifacts", "revisions", "objects", "assertions"):
        one = seen[layer].agg(F.count(F.lit(1)).alias("n")).select(F.lit(layer).alias("layer"), "n")
        out = one if out is None else out.unionByName(one)
    return out


_NOW, _YEAR = 1_720_000_000_000_000, 31_536_000_000_000


def policy_decisions(spark, d):
    """Whether user-001 is admitted to each source under a policy made of the source's own fields."""
    s = table(spark, d, "sources")
    p = s.select(
        "id", F.when(F.col("kind") == "upload", "workspace").when(F.col("kind") == "connector", "provider").when(F.col("kind") == "text", "list").otherwise("legacy").alias("mode"),
        F.array("owner_id").alias("allow"), F.when(F.col("status") == "failed", F.array(F.lit("user-001"))).otherwise(F.array().cast("array<string>")).alias("deny"),
        F.unix_micros("created_at").alias("verified_us"), (F.unix_micros("created_at") + _YEAR).alias("expires_us"),
    )
    return p.select("id", access.policy_allows("user-001", F.lit(_NOW), _YEAR // 2).alias("is_allowed"))


def mapped_policies(spark, d):
    """Owners as provider names of which only some are mapped."""
    s = table(spark, d, "sources")
    p = s.select(F.col("id").alias("policy_id"), F.lit("list").alias("mode"), F.filter(F.array("owner_id", F.lit("user-001")), lambda x: x.isNotNull()).alias("allow"), F.array().cast("array<string>").alias("deny"))
    known = s.where("min_rank >= 10 and owner_id is not null").select(F.col("owner_id").alias("provider"), F.concat(F.lit("own-"), "owner_id").alias("principal")).distinct()
    return access.mapped_principals(p, known).select("policy_id", "mode", F.array_join("allow", ",").alias("allow"), "n_dropped")


def publication_problems(spark, d):
    """Artifacts of the feed that could not be published as their last state is a delete."""
    state = change_feed.artifact_states(table(spark, d, "changes")).select(F.concat_ws("/", "partition_key", "external_id").alias("id"), "is_alive")
    none = spark.createDataFrame([], "id string")
    return sync.publication_problems(state, state.where("not is_alive"), none, 1, 1)


def generation_sizes(spark, d):
    return sync.generation_counts(table(spark, d, "observations").select("evidence_class", "attributes_json"), "evidence_class", "attributes_json").select("evidence_class", "n")


def best_edges(spark, d):
    f = knowledge.with_fields(table(spark, d, "facts")).where("subject is not null and object is not null and predicate is not null")
    e = f.select(F.col("subject").alias("a"), F.col("object").alias("b"), F.col("predicate").alias("kind"), (F.length("predicate") / 100.0).alias("omega"), F.col("fact_row").alias("pos"), F.col("source_id").alias("provenance"), (F.col("fact_row") % 97).alias("line"))
    return knowledge.best_code_edges(e).select("a", "b", "kind", "omega", "provenance", F.array_join("lines", ",").alias("lines"))


def source_links(spark, d):
    """Facts between sources: entity pairs joined by facts of other sources than the one that names them first."""
    t = knowledge.triples(table(spark, d, "facts")).where("source_id is not null")
    home = t.select(F.explode(F.array("subject_id", "object_id")).alias("id"), "source_id").groupBy("id").agg(F.min("source_id").alias("grp"))
    return graph.cross_counts(t.select(F.col("subject_id").alias("src"), F.col("object_id").alias("dst")), home)


def kind_numbers(spark, d):
    return graph.numbered_communities(table(spark, d, "sources").select(F.col("kind").alias("community"), "name"))


def boosted_passages(spark, d):
    """Passages of the sources of the kind of the least source count half as much again."""
    p = table(spark, d, "passages").select(F.col("id"), F.col("chars").cast("double").alias("score"), "source_id")
    kinds = table(spark, d, "sources").select(F.col("id").alias("source_id"), "kind")
    member = p.join(kinds, "source_id").select("id", F.col("kind").alias("community"))
    seed = p.join(kinds.orderBy("source_id").limit(1).select("source_id"), "source_id", "left_semi").select("id")
    return graph.boosted(p.select("id", "score"), member, seed, 0.5).select("id", "score")


def literal_access_counts(spark, d):
    """What the text literals of Python files and the statements of SQL files do to data."""
    docs = table(spark, d, "documents").select("path", "text")
    literals = docs.where("path like '%.py'").select(F.explode(F.regexp_extract_all("text", F.lit(r'"([^"\n]*)"'), F.lit(1))).alias("literal"))
    statements = docs.where("path like '%.sql'").select(F.explode(F.split(F.regexp_replace("text", r"(?m)^\s*--.*$", ""), ";")).alias("literal"))
    every = literals.unionAll(statements).where("trim(literal) <> ''")
    return every.groupBy(F.coalesce(codegraph.literal_access(F.col("literal")), F.lit("none")).alias("access")).agg(F.count(F.lit(1)).alias("n"))


def extraction_gate(spark, d):
    gate = knowledge.extraction_gate(F.col("text"))
    return table(spark, d, "passages").groupBy(F.when(gate.isNull(), "none").when(gate == "", "empty").otherwise("text").alias("gate")).agg(F.count(F.lit(1)).alias("n"))


def passage_citations(spark, d):
    p = table(spark, d, "passages").select(F.col("id").alias("passage_id"))
    facts = table(spark, d, "facts").where("passage_id is not null").select("passage_id", F.col("id").alias("original_id"))
    return retrieval.citations(p, facts).select("passage_id", F.md5(F.array_join("originals", ",")).alias("digest"), "n")


def demoted_first(spark, d):
    """Sources in order of size, failed ones last, those being indexed after the kept ready ones."""
    s = table(spark, d, "sources").join(table(spark, d, "passages").groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("n")), "id")
    by_size = relations.ranked(s.select("id", "status", "n"), [F.desc("n"), "id"])
    return relations.reordered(by_size, F.col("status") == "ready", F.col("status") == "failed", F.lit(False)).select("id", "bucket", "rank")


def seeded_share(spark, d):
    q = table(spark, d, "questions").select((F.col("query_mode") == "as_of").alias("code_seeded"), F.when(F.col("temporal.valid_at").isNotNull(), F.lit(1.0)).alias("path_fidelity"))
    return evaluation.seeded_share(q).select(F.round("code_seeded", 6).alias("code_seeded"), "path_fidelity")


def judge_verdicts(spark, d):
    """Labels in many spellings, made of each question's own fields, as a judge might write them."""
    spelled = F.concat(F.when(F.col("query_mode") == "current", "Partially").otherwise(""), F.when(F.col("split") == "dev", " ").otherwise("-"), F.when(F.col("expected_insufficiency"), "INcorrect").otherwise("Correct"))
    label = F.when(F.col("query_mode") == "atemporal", F.col("slice")).otherwise(F.btrim(spelled, F.lit(" -")))
    v = evaluation.verdict_of(label)
    return table(spark, d, "questions").select("id", v.alias("verdict"), evaluation.verdict_score(v).alias("score"))


def rendered_edges(spark, d):
    f = knowledge.with_fields(table(spark, d, "facts")).where("subject is not null and object is not null")
    return f.select("fact_row", T.cut_argument(T.render("{s} {p} {o}.", s="subject", p="predicate", o="object")).alias("statement"))


def canonical_names(spark, d):
    q = table(spark, d, "documents").select("doc_id", T.normalise_path("path").alias("norm_path"), T.normalise_url(F.concat(F.lit("HTTP://Host.Example:80/"), "path", F.lit("/#x"))).alias("url"), T.test_stem("path").alias("stem"))
    return q


QUERIES = {f.__name__: f for f in (
    roles_within, source_ranks, supported_facts, evidence_counts, policy_decisions, mapped_policies, publication_problems, generation_sizes, best_edges, source_links, kind_numbers, boosted_passages, literal_access_counts,
    extraction_gate, passage_citations, demoted_first, seeded_share, judge_verdicts, rendered_edges, canonical_names,
)}

_RUNS = TEMPORAL_SQL["p6_found"].rsplit("SELECT", 1)[0]
_VISIBLE = "SELECT id FROM sources WHERE owner_id = 'user-001' OR coalesce(min_rank, 0) <= 0"
_STATEMENT = "subject || ' ' || coalesce(predicate, '') || ' ' || object || '.'"
ORACLE = {
    "roles_within": "SELECT id, rank FROM (VALUES ('reader', 0), ('operator', 10), ('admin', 20)) r(id, rank) WHERE rank <= 10",
    "source_ranks": "SELECT id, CASE access_role_id WHEN 'reader' THEN 0 WHEN 'operator' THEN 10 WHEN 'admin' THEN 20 ELSE coalesce(min_rank, -1) END AS min_rank FROM sources",
    "supported_facts": f"SELECT f.id AS assertion_id, bool_or(p.id IS NOT NULL) AS is_supported FROM facts f LEFT JOIN (SELECT id FROM passages WHERE source_id IN ({_VISIBLE})) p ON f.passage_id = p.id WHERE f.passage_id IS NOT NULL GROUP BY 1",
    "evidence_counts": """
WITH a AS (SELECT id FROM sources WHERE access_role_id IN ('reader', 'operator')), r AS (SELECT id FROM passages WHERE source_id IN (SELECT id FROM a)),
f AS (SELECT * FROM facts WHERE subject_id IS NOT NULL AND object_id IS NOT NULL AND passage_id IS NOT NULL), o AS (SELECT subject_id AS id FROM f WHERE passage_id IN (SELECT id FROM r) UNION SELECT object_id FROM f WHERE passage_id IN (SELECT id FROM r)),
c AS (SELECT DISTINCT id, subject_id, object_id FROM f WHERE id IN (SELECT id FROM f WHERE passage_id IN (SELECT id FROM r)) AND subject_id IN (SELECT id FROM o) AND object_id IN (SELECT id FROM o))
SELECT 'artifacts' AS layer, count(*) AS n FROM a UNION ALL SELECT 'revisions', count(*) FROM r UNION ALL SELECT 'objects', count(*) FROM o UNION ALL SELECT 'assertions', count(*) FROM c""",
    "policy_decisions": f"""
WITH p AS (SELECT id, CASE kind WHEN 'upload' THEN 'workspace' WHEN 'connector' THEN 'provider' WHEN 'text' THEN 'list' ELSE 'legacy' END AS mode, owner_id, status, epoch_us(created_at) AS v FROM sources)
SELECT id, coalesce(mode <> 'legacy' AND v <= {_NOW} AND {_NOW} < v + CASE WHEN mode = 'provider' THEN {_YEAR // 2} ELSE {_YEAR} END AND (mode = 'workspace' OR coalesce(owner_id = 'user-001', false)) AND status <> 'failed', false) AS is_allowed FROM p""",
    "mapped_policies": """
WITH m AS (SELECT DISTINCT owner_id AS o FROM sources WHERE min_rank >= 10 AND owner_id IS NOT NULL), e AS (SELECT id, unnest(list_filter([owner_id, 'user-001'], lambda x: x IS NOT NULL)) AS o FROM sources),
g AS (SELECT e.id, count(*) AS n, count(*) FILTER (WHERE m.o IS NULL) AS lost, coalesce(string_agg(DISTINCT 'own-' || m.o, ',' ORDER BY 'own-' || m.o), '') AS allow FROM e LEFT JOIN m USING (o) GROUP BY 1)
SELECT id AS policy_id, CASE WHEN lost > 0 AND lost = n THEN 'unknown' ELSE 'list' END AS mode, allow, lost AS n_dropped FROM g""",
    "publication_problems": _RUNS + "SELECT partition_key || '/' || external_id AS id, 'tombstoned' AS reason FROM ends WHERE NOT is_alive",
    "generation_sizes": "SELECT evidence_class, count(*) AS n FROM observations GROUP BY 1",
    "best_edges": f"""
WITH {TOLD}, e AS (SELECT subject AS a, object AS b, predicate AS kind, length(predicate) / 100.0 AS omega, fact_row AS pos, source_id AS provenance, fact_row % 97 AS line FROM told WHERE subject IS NOT NULL AND object IS NOT NULL AND predicate IS NOT NULL AND subject <> object),
k AS (SELECT *, row_number() OVER (PARTITION BY a, b, kind ORDER BY omega DESC, pos) AS r FROM e)
SELECT a, b, kind, max(omega)::DOUBLE AS omega, max(CASE WHEN r = 1 THEN provenance END) AS provenance, array_to_string(list_sort(list_distinct(list(line))), ',') AS lines FROM k GROUP BY a, b, kind""",
    "source_links": f"""WITH {_TRIPLES}, h AS (SELECT id, min(source_id) AS grp FROM (SELECT subject_id AS id, source_id FROM t WHERE source_id IS NOT NULL UNION ALL SELECT object_id, source_id FROM t WHERE source_id IS NOT NULL) GROUP BY 1)
SELECT least(x.grp, y.grp) AS a, greatest(x.grp, y.grp) AS b, count(*) AS n FROM t JOIN h x ON subject_id = x.id JOIN h y ON object_id = y.id WHERE source_id IS NOT NULL AND x.grp <> y.grp GROUP BY 1, 2""",
    "kind_numbers": "SELECT kind AS community, min(name) AS label, row_number() OVER (ORDER BY min(name)) - 1 AS number FROM sources GROUP BY 1",
    "boosted_passages": "SELECT p.id, chars * CASE WHEN kind = (SELECT kind FROM sources ORDER BY id LIMIT 1) AND EXISTS (SELECT 1 FROM passages q WHERE q.source_id = (SELECT min(id) FROM sources)) THEN 1.5 ELSE 1.0 END::DOUBLE AS score FROM passages p LEFT JOIN sources s ON s.id = p.source_id",
    "literal_access_counts": rf"""
WITH l AS (SELECT unnest(regexp_extract_all(text, '"([^"\n]*)"', 1)) AS t FROM documents WHERE path LIKE '%.py' UNION ALL SELECT unnest(string_split(regexp_replace(text, '(?m)^\s*--.*$', '', 'g'), ';')) FROM documents WHERE path LIKE '%.sql'),
k AS (SELECT {", ".join(f"regexp_matches(t, '{p}') AS {name}" for name, p in codegraph.LITERAL_PATTERNS.items())} FROM l WHERE trim(t, ' ') <> '')
SELECT CASE WHEN named AND clause AND graph_write THEN 'cypher_write' WHEN named AND clause THEN 'cypher_read' WHEN sql AND NOT sentence AND sql_write THEN 'sql_write' WHEN sql AND NOT sentence THEN 'sql_read' ELSE 'none' END AS access, count(*) AS n FROM k GROUP BY 1""",
    "extraction_gate": "SELECT CASE WHEN text IS NULL THEN 'none' WHEN length(trim(text)) < 80 THEN 'empty' ELSE 'text' END AS gate, count(*) AS n FROM passages GROUP BY 1",
    "passage_citations": "SELECT p.id AS passage_id, md5(coalesce(string_agg(DISTINCT f.id, ',' ORDER BY f.id), '')) AS digest, count(DISTINCT f.id) AS n FROM passages p LEFT JOIN facts f ON f.passage_id = p.id GROUP BY 1",
    "demoted_first": """WITH s AS (SELECT sources.id, status, count(*) AS n FROM sources JOIN passages ON source_id = sources.id GROUP BY 1, 2), b AS (SELECT id, n, CASE status WHEN 'failed' THEN 2 WHEN 'ready' THEN 0 ELSE 1 END AS bucket FROM s)
SELECT id, bucket, row_number() OVER (ORDER BY bucket, n DESC, id) AS rank FROM b""",
    "seeded_share": "SELECT round(avg(CASE WHEN query_mode = 'as_of' THEN 1.0 ELSE 0.0 END), 6) AS code_seeded, avg(CASE WHEN temporal.valid_at IS NOT NULL THEN 1.0 END)::DOUBLE AS path_fidelity FROM questions",
    "judge_verdicts": """
WITH l AS (SELECT id, lower(CASE WHEN query_mode = 'atemporal' THEN slice ELSE trim((CASE WHEN query_mode = 'current' THEN 'Partially' ELSE '' END) || (CASE WHEN split = 'dev' THEN ' ' ELSE '-' END) || (CASE WHEN expected_insufficiency THEN 'INcorrect' ELSE 'Correct' END), ' -') END) AS label FROM questions),
v AS (SELECT id, CASE WHEN regexp_matches(label, '^ *correct *$') THEN 'correct' WHEN regexp_matches(label, '^ *partially[ _-]correct *$') THEN 'partially_correct' ELSE 'incorrect' END AS verdict FROM l)
SELECT id, verdict, CASE verdict WHEN 'correct' THEN 1.0 WHEN 'partially_correct' THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM v""",
    "rendered_edges": f"WITH {TOLD} SELECT fact_row, CASE WHEN length({_STATEMENT}) > 60 THEN left({_STATEMENT}, 59) || '…' ELSE {_STATEMENT} END AS statement FROM told WHERE subject IS NOT NULL AND object IS NOT NULL",
    "canonical_names": r"SELECT doc_id, path AS norm_path, 'http://host.example/' || path AS url, regexp_replace(regexp_replace(regexp_replace(lower(list_extract(string_split(path, '/'), -1)), '\.[^/]*$', ''), '^tests?_', ''), '(_tests?|tests?)$', '') AS stem FROM documents",
}
