"""Queries that build, rank and walk the evidence graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.text import clean_phrase
from marlstone.functions.vector import majority_length
from marlstone.operators import access, codegraph, graph, knowledge, relations, retrieval
from marlstone.plans.text_queries import CLEAN, SPLIT, TOLD
from marlstone.session import table

#: Rounds of plain power iteration that the SQL unrolls.
SQL_ROUNDS = 60
#: Rounds of the query at least: what is left then, 0.27 ** 20, is far below the nine digits shown.
WALK_ROUNDS = 20


def _triples(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.triples(table(spark, d, "facts"))


def entity_ids(spark, d):
    return knowledge.entities(_triples(spark, d))


def fact_statements(spark, d):
    return _triples(spark, d).groupBy("fact_id").agg(F.count(F.lit(1)).alias("n_passages"))


def fact_edges(spark, d):
    return knowledge.fact_edges(_triples(spark, d))


def node_specificity(spark, d):
    return knowledge.node_specificity(knowledge.mentions(_triples(spark, d)))


def orphans(spark, d):
    t = _triples(spark, d)
    return knowledge.orphans(knowledge.entities(t), knowledge.mentions(t))


def new_ids(spark, d):
    """Entities that facts recorded from 2025 on add to those from before."""
    f = table(spark, d, "facts")
    late = F.col("created_at") >= F.timestamp_micros(F.lit(1_735_689_600_000_000))
    return relations.new_rows(knowledge.entities(knowledge.triples(f.where(late))), knowledge.entities(knowledge.triples(f.where(~late))), ["id"])


def upserted_entities(spark, d):
    e = knowledge.entities(_triples(spark, d))
    return relations.upsert(e, e, ["id"]).agg(F.count(F.lit(1)).alias("n"))


def best_pairs(spark, d):
    pairs = _triples(spark, d).select(F.col("subject_id").alias("a"), F.col("object_id").alias("b"), (F.length("predicate") / 32.0).alias("score"), (F.col("predicate") == "replaces").alias("manual"))
    return relations.best_pairs(pairs)


def _edge_terms(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = _triples(spark, d)
    facts = knowledge.fact_edges(t).select("a", "b", F.lit("fact").alias("kind"), F.col("fact_count").cast("double").alias("value"))
    mentions = knowledge.mentions(t).select(F.col("passage_id").alias("a"), F.col("id").alias("b"), F.lit("mention").alias("kind"), F.lit(1.0).alias("value"))
    tuned = knowledge.fact_edges(t).where("substring(a, 8, 1) in ('0', 'f')").select("a", "b", F.when(F.substring("a", 8, 1) == "0", 0.0).otherwise(2.5).alias("weight"))
    return facts.unionByName(mentions), tuned


def edge_merge(spark, d):
    terms, tuned = _edge_terms(spark, d)
    return knowledge.merged_edges(terms, tuned).select("a", "b", "weight", F.array_join("kinds", ",").alias("kinds"))


def edge_edits(spark, d):
    terms, tuned = _edge_terms(spark, d)
    merged = knowledge.merged_edges(terms, tuned)
    edits = merged.where("weight >= 2").select("a", "b", (F.col("weight") / 2).alias("weight"), F.lit(0).alias("pos")).unionByName(merged.where("weight >= 4").select("a", "b", F.lit(0.0).alias("weight"), F.lit(1).alias("pos")))
    return graph.edited(merged, edits)


def _walk(spark: SparkSession, d: str) -> DataFrame:
    terms, tuned = _edge_terms(spark, d)
    return graph.mirrored(knowledge.merged_edges(terms, tuned))


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    """Entities that are both owned and managed by something, as a small stated seed set."""
    t = _triples(spark, d)
    return t.where("predicate = 'is owned by'").select(F.col("subject_id").alias("id")).distinct().join(t.where("predicate = 'is managed by'").select(F.col("subject_id").alias("id")).distinct(), "id", "left_semi")


def ppr_rank(spark, d):
    reset = graph.reset_vector(_seeds(spark, d).withColumn("value", F.lit(1.0)))
    return graph.personalized_pagerank(_walk(spark, d), reset, rounds=WALK_ROUNDS, whole=True).select("id", F.round("score", 9).alias("score"))


def bfs_hops(spark, d):
    return graph.bfs(_triples(spark, d).select(F.col("subject_id").alias("src"), F.col("object_id").alias("dst")).distinct(), _seeds(spark, d), 3)


def neighborhood(spark, d):
    return graph.neighbourhood(_walk(spark, d), _seeds(spark, d), 1, 100).select("id", "hops", "weight")


def blast_radius(spark, d):
    e = _triples(spark, d).where("predicate = 'depends on'").select(F.col("subject_id").alias("src"), F.col("object_id").alias("dst")).distinct()
    return graph.blast_radius(e, _seeds(spark, d))


def shortest_path(spark, d):
    """A way between the two entities with the least and the greatest id."""
    e = _triples(spark, d).select(F.col("subject_id").alias("src"), F.col("object_id").alias("dst"), F.col("predicate").alias("kind")).distinct()
    ends = e.agg(F.min("src"), F.max("dst")).first()
    found = graph.shortest_path(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind")), *ends)
    return found.select((F.size("path") - 1).alias("n_hops"))


def community_sizes(spark, d):
    c = graph.label_communities(_walk(spark, d))
    return c.groupBy("community").agg(F.count(F.lit(1)).alias("n"))


def display_subset(spark, d):
    return graph.by_degree(_walk(spark, d), 40)


def name_index(spark, d):
    return knowledge.name_index(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("path").alias("name")))


def ambiguous_tokens(spark, d):
    tokens = table(spark, d, "documents").where("title is not null").select(F.explode(F.split(clean_phrase("title"), " ")).alias("token"), F.col("doc_id").alias("id")).distinct()
    return knowledge.ambiguous_tokens(tokens)


def ngram_refs(spark, d):
    """Names that title some document, where documents refer to them."""
    docs = table(spark, d, "documents").where("text is not null")
    names = docs.where("title is not null").groupBy(F.regexp_replace("title", r" \S+$", "").alias("name")).agg(F.min("doc_id").alias("id"))
    return knowledge.references(docs.select(F.col("doc_id").alias("passage_id"), "text"), names)


def shared_pairs(spark, d):
    return knowledge.shared_entity_pairs(knowledge.mentions(_triples(spark, d)))


def synonyms_topk(spark, d):
    """Exact pairs of the vector table from cosine 0.3 on, the ten best of each."""
    v = table(spark, d, "embeddings").select(F.lpad(F.col("vec_id").cast("string"), 8, "0").alias("id"), F.lit("vector").alias("name"), "embedding")
    return knowledge.synonym_pairs(v, 0.3, 10).select("a", "b", F.round("score", 5).alias("score"))


def synonyms_default(spark, d):
    """The same at the default threshold."""
    v = table(spark, d, "embeddings").select(F.lpad(F.col("vec_id").cast("string"), 8, "0").alias("id"), F.lit("vector").alias("name"), "embedding")
    return knowledge.synonym_pairs(v).select("a", "b", F.round("score", 5).alias("score"))


def vector_lengths(spark, d):
    return majority_length(table(spark, d, "passages").select("passage_no", "embedding")).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim"))


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    """The vector of the passage with the least number that has one of the common length."""
    p = table(spark, d, "passages").where("size(embedding) = 64").orderBy("passage_no").select("embedding").first()
    return [float(v) for v in p[0]]


def dense_rank(spark, d):
    p = table(spark, d, "passages").select("passage_no", "embedding")
    scored = retrieval.dense_scores(p, _query_vector(spark, d)).select("passage_no", F.round("dense", 6).alias("dense"))
    return relations.top(scored, [F.desc("dense"), "passage_no"], 200)


def seed_weights(spark, d):
    t = _triples(spark, d)
    scores = knowledge.with_fields(table(spark, d, "facts")).where("size(embedding) = 64").select("fact_row", "subject", "predicate", "object", "embedding")
    scored = retrieval.dense_scores(scores, _query_vector(spark, d))
    keyed = scored.select("fact_row", clean_phrase("subject").alias("s"), clean_phrase("predicate").alias("p"), clean_phrase("object").alias("o"), "dense").where("s <> '' and o <> '' and p is not null")
    kept = relations.top(keyed, [F.desc("dense"), "fact_row"], 5).select(F.concat(F.lit("entity-"), F.md5("s")).alias("subject_id"), F.concat(F.lit("entity-"), F.md5("o")).alias("object_id"), "dense")
    boosts = spark.createDataFrame([], "id string, boost double")
    return retrieval.seed_weights(kept, knowledge.node_specificity(knowledge.mentions(t)), boosts).select("id", F.round("weight", 6).alias("weight"))


def graph_search(spark, d):
    """The whole retrieval: passages ranked by the walk from the facts most like the query."""
    t = _triples(spark, d)
    f = knowledge.with_fields(table(spark, d, "facts")).where("size(embedding) = 64 and subject is not null and object is not null")
    facts = f.select(F.concat(F.lit("fact-"), F.col("fact_row")).alias("fact_id"), F.concat(F.lit("entity-"), F.md5(clean_phrase("subject"))).alias("subject_id"), F.concat(F.lit("entity-"), F.md5(clean_phrase("object"))).alias("object_id"), "embedding")
    p = table(spark, d, "passages").select(F.col("id").alias("passage_id"), "embedding")
    boosts = spark.createDataFrame([], "id string, boost double")
    found = retrieval.search(p, facts, _walk(spark, d), knowledge.node_specificity(knowledge.mentions(t)), boosts, _query_vector(spark, d))
    return found.select("passage_id", "rank", F.round("score", 6).alias("score"), F.round("dense", 6).alias("dense"), F.coalesce("dense_rank", F.lit(0)).alias("dense_rank"))


def trace_diff(spark, d):
    docs = table(spark, d, "documents").where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
    return relations.rank_changes(relations.top(docs, [F.desc("n"), "source"], 10), relations.top(docs, [F.desc("chars"), "source"], 10), "source").na.fill(0, ["rank_before", "rank_after"])


def round_robin(spark, d):
    items = _triples(spark, d).where("source_id is not null").groupBy("source_id", "subject_id").agg(F.count(F.lit(1)).alias("n"))
    return relations.round_robin(items, "source_id", [F.desc("n"), "subject_id"], "subject_id")


def tiered_paths(spark, d):
    e = _walk(spark, d).where("src < dst").select(F.col("src").alias("grp"), (F.lit(1.0) / F.col("weight")).alias("omega"), F.when(F.startswith("dst", F.lit("passage")), "in").otherwise("out").alias("direction"), F.col("dst").alias("name"))
    return relations.tiered_interleave(e, "grp", "omega", "direction", "name").select("grp", "name", "position")


def budget_cut(spark, d):
    p = table(spark, d, "passages").where("text is not null").select("source_id", "ordinal", "passage_no", "text")
    return relations.prefix_cut(p, ["source_id"], F.floor(F.col("ordinal") / 1000), ["ordinal", "passage_no"], "text", 2000).select("source_id", "passage_no", "running")


def greedy_budget(spark, d):
    p = table(spark, d, "passages").where("text is not null").select("source_id", "passage_no", F.length("text").alias("size"))
    return relations.greedy_fill(p, ["source_id"], ["passage_no"], "size", 400, 10)


def entity_search(spark, d):
    t = _triples(spark, d)
    return relations.substring_search(knowledge.entities(t), knowledge.mentions(t), "board").select("id", "name", "passage_count")


def relational_division(spark, d):
    m = knowledge.mentions(_triples(spark, d))
    common = knowledge.node_specificity(m).where("passage_count >= 3").select("id")
    return relations.missing_members(m, common, "passage_id", "id")


def scope_visible(spark, d):
    return access.visible_sources(table(spark, d, "sources"), "user-001", 10).select("id")


def scope_subgraph(spark, d):
    scope = access.scoped(table(spark, d, "facts"), access.visible_sources(table(spark, d, "sources"), "user-001", 10))
    return scope["edges"].join(scope["specificity"].select(F.col("id").alias("a"), F.col("passage_count").alias("a_passages")), "a", "left")


def node_tiers(spark, d):
    s = _triples(spark, d).select(F.explode(F.array("subject_id", "object_id")).alias("id"), "source_id").distinct()
    return access.node_tiers(s, table(spark, d, "sources").select(F.col("id").alias("source_id"), F.coalesce("min_rank", F.lit(0)).alias("rank")))


def ddl_tables(spark, d):
    files = table(spark, d, "documents").where("path like '%.sql'").select(F.concat_ws("#", "path", "doc_id").alias("path"), "text")
    return codegraph.ddl_tables(files).select("path", "table_name", "line")


def python_symbols(spark, d):
    return codegraph.python_symbols(_files(spark, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("doc").alias("n_documented"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("path like '%.py'").select(F.concat_ws("#", "path", "doc_id").alias("path"), "text")


def invokes(spark, d):
    f = _files(spark, d)
    return codegraph.invokes_edges(codegraph.python_symbols(f), codegraph.python_calls(f)).select("a_path", "a", "b_path", "b", "omega", "provenance")


def contains(spark, d):
    return codegraph.contains_edges(codegraph.python_symbols(_files(spark, d))).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


def innermost_symbols(spark, d):
    f = _files(spark, d)
    calls = codegraph.python_calls(f).select("path", "line").distinct()
    symbols = codegraph.python_symbols(f).withColumn("id", F.concat_ws(":", "path", "qualname"))
    return knowledge.innermost_symbol(calls, symbols).select("path", "line", "qualname")


QUERIES = {f.__name__: f for f in (
    entity_ids, fact_statements, fact_edges, node_specificity, orphans, new_ids, upserted_entities, best_pairs, edge_merge, edge_edits, ppr_rank, bfs_hops, neighborhood, blast_radius, shortest_path, community_sizes,
    display_subset, name_index, ambiguous_tokens, ngram_refs, shared_pairs, synonyms_topk, synonyms_default, vector_lengths, dense_rank, seed_weights, graph_search, trace_diff, round_robin, tiered_paths, budget_cut,
    greedy_budget, entity_search, relational_division, scope_visible, scope_subgraph, node_tiers, ddl_tables, python_symbols, invokes, contains, innermost_symbols,
)}

_TRIPLES = f"""{TOLD},
cleaned AS (SELECT DISTINCT passage_id, source_id, {CLEAN.format('subject')} AS subject, {CLEAN.format('predicate')} AS predicate, {CLEAN.format('object')} AS object FROM told),
t AS (SELECT *, 'fact-' || md5(subject || chr(9) || predicate || chr(9) || object) AS fact_id, 'entity-' || md5(subject) AS subject_id, 'entity-' || md5(object) AS object_id
  FROM cleaned WHERE subject <> '' AND object <> '' AND predicate IS NOT NULL),
ent AS (SELECT subject_id AS id, subject AS name FROM t UNION SELECT object_id, object FROM t),
men AS (SELECT passage_id, subject_id AS id FROM t WHERE passage_id IS NOT NULL UNION SELECT passage_id, object_id FROM t WHERE passage_id IS NOT NULL),
spec AS (SELECT id, count(*) AS passage_count FROM men GROUP BY 1),
fe AS (SELECT least(subject_id, object_id) AS a, greatest(subject_id, object_id) AS b, count(*) AS fact_count FROM t WHERE subject_id <> object_id AND passage_id IS NOT NULL GROUP BY 1, 2)
"""
_EDGES = _TRIPLES + """,
terms AS (SELECT a, b, 'fact' AS kind, fact_count::DOUBLE AS value FROM fe UNION ALL SELECT least(passage_id, id), greatest(passage_id, id), 'mention', 1.0 FROM men),
computed AS (SELECT a, b, max(value) AS w, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM terms GROUP BY 1, 2),
tuned AS (SELECT a, b, CASE WHEN a[8] = '0' THEN 0.0 ELSE 2.5 END AS tw FROM fe WHERE a[8] IN ('0', 'f')),
merged AS (SELECT a, b, coalesce(tw, w) AS weight, CASE WHEN tw IS NULL THEN kinds ELSE kinds || ',tuned' END AS kinds FROM computed LEFT JOIN tuned USING (a, b) WHERE coalesce(tw, w) > 0),
walk AS (SELECT a AS src, b AS dst, weight FROM merged UNION ALL SELECT b, a, weight FROM merged),
seeds AS (SELECT DISTINCT subject_id AS id FROM t WHERE predicate = 'is owned by' AND subject_id IN (SELECT subject_id FROM t WHERE predicate = 'is managed by'))
"""


_QUERY = "qv AS (SELECT embedding::DOUBLE[] AS q FROM passages WHERE len(embedding) = 64 ORDER BY passage_no LIMIT 1)"


def _rounds_sql(reset: str, rounds: int) -> str:
    """Power iteration over ``walk`` from ``reset`` (id, p), one CTE per round."""
    steps = [
        "str AS (SELECT src, sum(weight) AS total FROM walk GROUP BY 1)",
        "sh AS MATERIALIZED (SELECT src, dst, weight / total AS share FROM walk JOIN str USING (src))",
        f"p AS MATERIALIZED ({reset})",
        "lost AS (SELECT coalesce(sum(p), 0) AS l FROM p WHERE id NOT IN (SELECT src FROM str))",
        "d0 AS (SELECT l AS d FROM lost)", "r0 AS (SELECT id, p AS score FROM p)",
    ]
    for i in range(rounds):
        steps.append(f"r{i + 1} AS MATERIALIZED (SELECT id, sum(score) AS score FROM (SELECT dst AS id, share * score * 0.5 AS score FROM sh JOIN r{i} ON src = id UNION ALL SELECT id, p * (0.5 + 0.5 * (SELECT d FROM d{i})) FROM p) GROUP BY 1)")
        steps.append(f"d{i + 1} AS (SELECT (0.5 + 0.5 * d) * (SELECT l FROM lost) AS d FROM d{i})")
    return ", ".join(steps)


def _ppr_sql() -> str:
    reset = "SELECT id, 1.0 / (SELECT count(*) FROM seeds) AS p FROM seeds"
    return f"WITH {_EDGES}, {_rounds_sql(reset, SQL_ROUNDS)} SELECT id, round(score, 9) AS score FROM r{SQL_ROUNDS}"


def _search_sql(rounds: int) -> str:
    scaled = "(x - (SELECT min(x) FROM {0})) / ((SELECT max(x) FROM {0}) - (SELECT min(x) FROM {0}))"
    steps = [
        _QUERY,
        "pd AS (SELECT id, list_dot_product(embedding::DOUBLE[], q) AS x FROM passages, qv WHERE len(embedding) = 64)",
        f"dense AS MATERIALIZED (SELECT id, {scaled.format('pd')} AS d FROM pd)",
        f"fd AS (SELECT 'fact-' || fact_row AS fid, 'entity-' || md5({CLEAN.format('subject')}) AS s, 'entity-' || md5({CLEAN.format('object')}) AS o, list_dot_product(embedding::DOUBLE[], q) AS x FROM told, qv WHERE len(embedding) = 64 AND subject IS NOT NULL AND object IS NOT NULL)",
        f"best AS (SELECT s, o, {scaled.format('fd')} AS d, fid FROM fd ORDER BY d DESC, fid LIMIT 5)",
        "mean AS (SELECT id, avg(d / greatest(coalesce(passage_count, 1), 1)) AS w FROM (SELECT unnest([s, o]) AS id, d FROM best) LEFT JOIN spec USING (id) GROUP BY 1)",
        "cut AS (SELECT id, w FROM mean ORDER BY w DESC, id LIMIT 5)",
        "parts AS (SELECT id, sum(v) AS v FROM (SELECT id, w AS v FROM cut UNION ALL SELECT id, d * 0.05 FROM dense) GROUP BY 1 HAVING sum(v) > 0)",
        _rounds_sql("SELECT id, v / (SELECT sum(v) FROM parts) AS p FROM parts", rounds),
        f"scored AS (SELECT id, coalesce(score, 0) AS score, d, row_number() OVER (ORDER BY d DESC, id) AS dense_rank FROM dense LEFT JOIN r{rounds} USING (id))",
        "ranked AS (SELECT *, row_number() OVER (ORDER BY round(score, 12) DESC, id) AS rank FROM scored)",
    ]
    return f"WITH {_EDGES}, {', '.join(steps)} SELECT id AS passage_id, rank, round(score, 6) AS score, round(d, 6) AS dense, CASE WHEN dense_rank <= 200 THEN dense_rank ELSE 0 END AS dense_rank FROM ranked WHERE rank <= 200"


def _labels_sql(rounds: int) -> str:
    steps = ["own AS (SELECT src AS id, max(weight) AS weight FROM walk GROUP BY 1)", "l0 AS (SELECT id, id AS label FROM own)"]
    for i in range(rounds):
        steps.append(f"w{i} AS (SELECT id, label, round(sum(weight), 9) AS w FROM (SELECT src AS id, label, weight FROM walk JOIN l{i} ON dst = id UNION ALL SELECT id, label, weight FROM l{i} JOIN own USING (id)) GROUP BY 1, 2)")
        steps.append(f"l{i + 1} AS MATERIALIZED (SELECT id, label FROM w{i} QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC, label) = 1)")
    return f"WITH {_EDGES}, {', '.join(steps)} SELECT min(id) AS community, count(*) AS n FROM l{rounds} GROUP BY label"


def _bfs_sql(edges: str, seeds: str, depth: int) -> str:
    steps = [f"e AS ({edges})", f"v0 AS (SELECT DISTINCT id, 0 AS hops FROM ({seeds}))"]
    for i in range(depth):
        steps.append(f"v{i + 1} AS MATERIALIZED (SELECT * FROM v{i} UNION ALL SELECT DISTINCT dst, {i + 1} FROM e JOIN v{i} ON src = id WHERE hops = {i} AND dst NOT IN (SELECT id FROM v{i}))")
    return ", ".join(steps)


ORACLE = {
    "entity_ids": f"WITH {_TRIPLES} SELECT id, name FROM ent",
    "fact_statements": f"WITH {_TRIPLES} SELECT fact_id, count(*) AS n_passages FROM t GROUP BY 1",
    "fact_edges": f"WITH {_TRIPLES} SELECT a, b, fact_count FROM fe",
    "node_specificity": f"WITH {_TRIPLES} SELECT id, passage_count FROM spec",
    "orphans": f"WITH {_TRIPLES} SELECT id, name FROM ent WHERE id NOT IN (SELECT id FROM men)",
    "new_ids": f"""WITH {TOLD}, x AS (SELECT created_at >= TIMESTAMPTZ '2025-01-01 00:00:00+00' AS late, {CLEAN.format('subject')} AS s, {CLEAN.format('predicate')} AS p, {CLEAN.format('object')} AS o FROM told),
e AS (SELECT late, unnest([s, o]) AS name FROM x WHERE s <> '' AND o <> '' AND p IS NOT NULL)
SELECT DISTINCT 'entity-' || md5(name) AS id, name FROM e WHERE late AND name NOT IN (SELECT name FROM e WHERE NOT late)""",
    "upserted_entities": f"WITH {_TRIPLES} SELECT count(*) AS n FROM ent",
    "best_pairs": f"WITH {_TRIPLES} SELECT least(subject_id, object_id) AS a, greatest(subject_id, object_id) AS b, max(length(predicate) / 32.0) AS score, bool_or(predicate = 'replaces') AS manual FROM t WHERE subject_id <> object_id GROUP BY 1, 2",
    "edge_merge": f"WITH {_EDGES} SELECT a, b, weight::DOUBLE AS weight, kinds FROM merged",
    "edge_edits": f"WITH {_EDGES} SELECT a, b, (CASE WHEN weight >= 2 THEN weight / 2 ELSE weight END)::DOUBLE AS weight FROM merged WHERE weight < 4",
    "ppr_rank": _ppr_sql(),
    "graph_search": _search_sql(SQL_ROUNDS),
    "community_sizes": _labels_sql(4),
    "bfs_hops": f"WITH {_EDGES}, {_bfs_sql('SELECT DISTINCT subject_id AS src, object_id AS dst FROM t', 'SELECT id FROM seeds', 3)} SELECT id, hops FROM v3",
    "neighborhood": f"WITH {_EDGES}, {_bfs_sql('SELECT src, dst FROM walk', 'SELECT id FROM seeds', 1)} SELECT id, hops, (SELECT max(weight) FROM walk JOIN v1 s ON src = s.id AND s.hops = v.hops - 1 WHERE dst = v.id)::DOUBLE AS weight FROM v1 v ORDER BY hops, weight DESC NULLS LAST, id LIMIT 100",
    "blast_radius": f"""WITH {_EDGES}, {_bfs_sql("SELECT DISTINCT object_id AS src, subject_id AS dst FROM t WHERE predicate = 'depends on'", 'SELECT id FROM seeds', 2)}
SELECT id, hops, (SELECT count(*) FROM v2 WHERE hops > 0) > 200 AS truncated FROM v2 WHERE hops > 0 ORDER BY hops, id LIMIT 200""",
    "shortest_path": f"WITH {_TRIPLES}, {_bfs_sql('SELECT subject_id AS src, object_id AS dst FROM t UNION SELECT object_id, subject_id FROM t', 'SELECT min(subject_id) AS id FROM t', 6)} SELECT hops AS n_hops FROM v6 WHERE id = (SELECT max(object_id) FROM t)",
    "display_subset": f"WITH {_EDGES} SELECT src AS id, count(*) AS degree FROM walk GROUP BY 1 ORDER BY degree DESC, id LIMIT 40",
    "name_index": f"SELECT DISTINCT unnest({SPLIT.format('path')}) AS token, doc_id AS id FROM documents",
    "ambiguous_tokens": f"""WITH k AS (SELECT DISTINCT doc_id AS id, unnest(string_split({CLEAN.format('title')}, ' ')) AS token FROM documents WHERE title IS NOT NULL),
c AS (SELECT *, count(*) OVER (PARTITION BY token) AS n, row_number() OVER (PARTITION BY token ORDER BY id) AS r FROM k)
SELECT token, id, (1.0 / n)::DOUBLE AS share FROM c WHERE n <= 10 AND r <= 8""",
    "ngram_refs": f"""WITH ent AS (SELECT min(doc_id) AS id, regexp_replace(title, ' \\S+$', '') AS name FROM documents WHERE title IS NOT NULL GROUP BY 2),
w AS (SELECT doc_id AS passage_id, text, string_split({CLEAN.format('text')}, ' ') AS ws FROM documents WHERE text IS NOT NULL),
names AS (SELECT id, name, array_to_string({SPLIT.format('name')}, ' ') AS gram, len({SPLIT.format('name')}) AS n FROM ent),
g AS (SELECT DISTINCT passage_id, array_to_string(ws[i:i + n - 1], ' ') AS gram FROM (SELECT passage_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM names WHERE n >= 2) v)),
by_gram AS (SELECT passage_id, id, 0.60 AS omega FROM g JOIN names USING (gram) WHERE n >= 2),
by_name AS (SELECT passage_id, ent.id, 0.85 AS omega FROM (SELECT DISTINCT passage_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+(?:\\.[\\p{{L}}\\p{{N}}_]+)*')) AS word FROM w) x JOIN ent ON word = name),
best AS (SELECT passage_id, id, max(omega)::DOUBLE AS omega FROM (SELECT * FROM by_gram UNION ALL SELECT * FROM by_name) GROUP BY 1, 2)
SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY passage_id ORDER BY omega DESC, id) <= 20""",
    "shared_pairs": f"""WITH {_TRIPLES}, c AS (SELECT passage_id, id, passage_count AS n FROM men JOIN spec USING (id) WHERE passage_count BETWEEN 2 AND 5)
SELECT x.passage_id AS a, y.passage_id AS b, arg_min(x.id, (CASE WHEN x.n <= 3 THEN '0' ELSE '1' END) || x.id) AS entity_id FROM c x JOIN c y ON x.id = y.id AND x.passage_id < y.passage_id GROUP BY 1, 2""",
    "synonyms_topk": """WITH s AS (SELECT lpad(a.vec_id::VARCHAR, 8, '0') AS id, lpad(b.vec_id::VARCHAR, 8, '0') AS other, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
k AS (SELECT * FROM s WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, other) <= 10)
SELECT least(id, other) AS a, greatest(id, other) AS b, round(max(score), 5) AS score FROM k GROUP BY 1, 2""",
    "synonyms_default": """WITH s AS (SELECT lpad(a.vec_id::VARCHAR, 8, '0') AS a, lpad(b.vec_id::VARCHAR, 8, '0') AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)
SELECT a, b, round(score, 5) AS score FROM s WHERE score >= 0.8""",
    "vector_lengths": "SELECT count(*) AS n, max(len(embedding))::INT AS dim FROM passages WHERE len(embedding) = (SELECT len(embedding) FROM passages WHERE embedding IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)",
    "dense_rank": f"""WITH {_QUERY}, s AS (SELECT passage_no, list_dot_product(embedding::DOUBLE[], q) AS x FROM passages, qv WHERE len(embedding) = 64),
k AS (SELECT passage_no, round((x - (SELECT min(x) FROM s)) / ((SELECT max(x) FROM s) - (SELECT min(x) FROM s)), 6) AS dense FROM s)
SELECT passage_no, dense, row_number() OVER (ORDER BY dense DESC, passage_no) AS rank FROM k ORDER BY rank LIMIT 200""",
    "seed_weights": f"""WITH {_TRIPLES}, {_QUERY},
s AS (SELECT fact_row, {CLEAN.format('subject')} AS sb, {CLEAN.format('predicate')} AS pr, {CLEAN.format('object')} AS ob, list_dot_product(embedding::DOUBLE[], q) AS x FROM told, qv WHERE len(embedding) = 64),
k AS (SELECT *, (x - (SELECT min(x) FROM s)) / ((SELECT max(x) FROM s) - (SELECT min(x) FROM s)) AS dense FROM s),
top AS (SELECT * FROM k WHERE sb <> '' AND ob <> '' AND pr IS NOT NULL ORDER BY dense DESC, fact_row LIMIT 5),
ends AS (SELECT unnest(['entity-' || md5(sb), 'entity-' || md5(ob)]) AS id, dense FROM top)
SELECT id, round(avg(dense / greatest(coalesce(passage_count, 1), 1)), 6) AS weight FROM ends LEFT JOIN spec USING (id) GROUP BY 1""",
    "trace_diff": """WITH c AS (SELECT source, count(*) AS n, sum(n_chars) AS chars FROM documents WHERE source IS NOT NULL GROUP BY 1),
a AS (SELECT source, row_number() OVER (ORDER BY n DESC, source) AS rank_before FROM c QUALIFY rank_before <= 10), b AS (SELECT source, row_number() OVER (ORDER BY chars DESC, source) AS rank_after FROM c QUALIFY rank_after <= 10)
SELECT source, coalesce(rank_before, 0) AS rank_before, coalesce(rank_after, 0) AS rank_after, CASE WHEN rank_before IS NULL THEN 'new' WHEN rank_after IS NULL THEN 'dropped' WHEN rank_after < rank_before THEN 'up' WHEN rank_after > rank_before THEN 'down' ELSE 'same' END AS change FROM a FULL JOIN b USING (source)""",
    "round_robin": f"""WITH {_TRIPLES}, i AS (SELECT source_id, subject_id, count(*) AS n FROM t WHERE source_id IS NOT NULL GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY n DESC, subject_id) AS turn FROM i) SELECT turn, source_id, subject_id FROM k QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY turn, source_id) = 1""",
    "tiered_paths": f"""WITH {_EDGES}, e AS (SELECT src AS grp, round(1.0 / weight, 4) AS tier, CASE WHEN dst LIKE 'passage%' THEN 'in' ELSE 'out' END AS direction, dst AS name FROM walk WHERE src < dst),
k AS (SELECT *, row_number() OVER (PARTITION BY grp, tier, direction ORDER BY name) AS turn FROM e) SELECT grp, name, row_number() OVER (PARTITION BY grp ORDER BY tier DESC, turn, direction, name) AS position FROM k""",
    "budget_cut": "SELECT source_id, passage_no, running::BIGINT AS running FROM (SELECT source_id, passage_no, sum(length(text) + 1) OVER (PARTITION BY source_id ORDER BY ordinal, passage_no ROWS UNBOUNDED PRECEDING) - 1 AS running FROM passages WHERE text IS NOT NULL) WHERE running <= 2000",
    "entity_search": f"WITH {_TRIPLES} SELECT id, name, coalesce(passage_count, 0) AS passage_count FROM ent LEFT JOIN spec USING (id) WHERE contains(name, 'board') ORDER BY passage_count DESC, name, id LIMIT 25",
    "relational_division": f"WITH {_TRIPLES} SELECT passage_id, bool_and(passage_count >= 3) AS complete, count(*) FILTER (WHERE passage_count < 3) AS n_missing FROM men JOIN spec USING (id) GROUP BY 1",
    "scope_visible": "SELECT id FROM sources WHERE owner_id = 'user-001' OR coalesce(min_rank, 0) <= 10",
    "scope_subgraph": f"""WITH {_TRIPLES.replace('FROM told)', "FROM told WHERE source_id IN (SELECT id FROM sources WHERE owner_id = 'user-001' OR coalesce(min_rank, 0) <= 10))")}
SELECT a, b, fact_count, passage_count AS a_passages FROM fe LEFT JOIN spec ON a = id""",
    "node_tiers": f"WITH {_TRIPLES}, s AS (SELECT subject_id AS nid, source_id FROM t UNION SELECT object_id, source_id FROM t) SELECT nid AS id, min(coalesce(min_rank, 0)) AS tier FROM s JOIN sources ON sources.id = source_id GROUP BY 1",
    "ddl_tables": r"""WITH p AS (SELECT path || '#' || doc_id AS path, unnest(string_split(text, ';')) AS s, unnest(range(len(string_split(text, ';')))) AS n FROM documents WHERE path LIKE '%.sql'),
k AS (SELECT *, coalesce(sum(length(s) - length(replace(s, chr(10), ''))) OVER (PARTITION BY path ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, regexp_extract(s, '(?is)^(.*?)create\s+table', 1) AS lead FROM p)
SELECT path, regexp_extract(s, '(?i)create\s+table\s+(?:if\s+not\s+exists\s+)?([\w."`]+)\s*\(', 1) AS table_name, (before + length(lead) - length(replace(lead, chr(10), '')) + 1)::BIGINT AS line
FROM k WHERE regexp_extract(s, '(?i)create\s+table\s+(?:if\s+not\s+exists\s+)?([\w."`]+)\s*\(', 1) <> ''""",
}
