"""Queries of the training-data problems p1, p5, p8, p9 and p10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import duplicates, leakage, mixing, subjects, vectors
from marlstone.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    copies = duplicates.fact_copies(table(spark, d, "facts"))
    return copies.where("member <> kept").select(F.col("kept").alias("kept_row"), F.col("member").alias("copy_row"))


def p1_copy_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many groups of copies there are of each size."""
    copies = duplicates.fact_copies(table(spark, d, "facts")).where("member = kept")
    return copies.groupBy("n_copies").agg(F.count(F.lit(1)).alias("n_groups"))


def _embedded(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "facts").select(F.lit("fact").alias("collection"), F.col("fact_row").alias("id"), "embedding")
    passages = table(spark, d, "passages").select(F.lit("passage").alias("collection"), F.col("passage_no").alias("id"), "embedding")
    return facts.unionByName(passages)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    near = vectors.similar_pairs(_embedded(spark, d))
    return near.select("collection", F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def p5_search(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar vectors, near or far, of every vector whose id 50 divides, against all."""
    near = vectors.similar_pairs(_embedded(spark, d), vectors.search_spec(), F.col("id") % 50 == 0)
    return near.select("collection", "id", "other", "rank", F.round("cosine", 4).alias("cosine"))


def _shared(spark: SparkSession, d: str) -> DataFrame:
    return leakage.shared_passages(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _shared(spark, d).select("doc_id", "item_id")


def p8_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(_shared(spark, d), table(spark, d, "eval_items")).select("item_id", "split", "n_docs")


def _mix(spark: SparkSession, d: str) -> mixing.Mix:
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mixed corpus: which document stands in which slot, for every use."""
    return _mix(spark, d).uses


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The use of each source and the shares reached."""
    return _mix(spark, d).report


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    held_out = table(spark, d, "eval_items")
    model = subjects.fit_subjects(table(spark, d, "labelled_texts"), table(spark, d, "subject_areas"), held_out)
    return subjects.subject_areas(table(spark, d, "documents"), model, held_out)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", F.explode("areas").alias("area"))


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    """Make-up of the corpus by subject area."""
    return subjects.composition(_subjects(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_copy_counts, p5_found, p5_search, p8_found, p8_leaked_items, p9_mix, p9_shares, p10_found, p10_composition)}

_FACTS = r"""
WITH parts AS (
  SELECT fact_row, subject, predicate, object, raw_triple,
    list_transform(string_split_regex(raw_triple, '[;|]'), lambda x: regexp_extract(x, '(?is)^\s*(subject|predicate|object)\s*[:=](.*)$', ['k', 'v'])) AS kv
  FROM facts
), fields AS (
  SELECT fact_row,
    coalesce(subject, CASE WHEN raw_triple LIKE '{%' THEN coalesce(raw_triple ->> '$.subject', raw_triple ->> '$.Subject', raw_triple ->> '$.SUBJECT') ELSE list_filter(kv, lambda x: lower(x.k) = 'subject')[1].v END) AS s,
    coalesce(predicate, CASE WHEN raw_triple LIKE '{%' THEN coalesce(raw_triple ->> '$.predicate', raw_triple ->> '$.Predicate', raw_triple ->> '$.PREDICATE') ELSE list_filter(kv, lambda x: lower(x.k) = 'predicate')[1].v END) AS p,
    coalesce(object, CASE WHEN raw_triple LIKE '{%' THEN coalesce(raw_triple ->> '$.object', raw_triple ->> '$.Object', raw_triple ->> '$.OBJECT') ELSE list_filter(kv, lambda x: lower(x.k) = 'object')[1].v END) AS o
  FROM parts
), keys AS (
  SELECT fact_row, regexp_extract_all(replace(lower(s), 'ß', 'ss'), '[\p{L}\p{N}]+') AS s,
    regexp_extract_all(replace(lower(p), 'ß', 'ss'), '[\p{L}\p{N}]+') AS p, regexp_extract_all(replace(lower(o), 'ß', 'ss'), '[\p{L}\p{N}]+') AS o
  FROM fields WHERE s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL
), grouped AS (
  SELECT fact_row, min(fact_row) OVER w AS kept, count(*) OVER w AS n FROM keys WHERE len(s) > 0 AND len(p) > 0 AND len(o) > 0 WINDOW w AS (PARTITION BY s, p, o)
)
"""
_GRAMS = r"""
WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text <> ''),
i AS (SELECT item_id AS id, regexp_extract_all(lower(item_text), '[\p{L}\p{N}]+') AS w FROM eval_items),
dg AS (SELECT id, unnest(list_transform(range(1, len(w) - 10), lambda p: md5(array_to_string(w[p:p + 11], ' ')))) AS g FROM d WHERE len(w) >= 12),
ig AS (SELECT id, unnest(list_transform(range(1, len(w) - 10), lambda p: md5(array_to_string(w[p:p + 11], ' ')))) AS g FROM i WHERE len(w) >= 12),
found AS (SELECT DISTINCT dg.id AS doc_id, ig.id AS item_id FROM dg JOIN ig ON dg.g = ig.g)
"""
_VECTORS = """
WITH v AS (
  SELECT 'fact' AS collection, fact_row AS id, embedding::DOUBLE[] AS e FROM facts WHERE len(embedding) = 64
  UNION ALL SELECT 'passage', passage_no, embedding::DOUBLE[] FROM passages WHERE len(embedding) = 64
), u AS (SELECT * FROM v WHERE list_dot_product(e, e) > 0)
"""
ORACLE = {
    "p5_found": _VECTORS + """
, near AS (
  SELECT collection, id, other FROM (
    SELECT a.collection, a.id, b.id AS other, list_cosine_similarity(a.e, b.e) AS c FROM u a JOIN u b ON a.collection = b.collection AND a.id <> b.id
  ) WHERE c >= 0.90 QUALIFY row_number() OVER (PARTITION BY collection, id ORDER BY c DESC, other) <= 5
) SELECT DISTINCT collection, least(id, other) AS id_a, greatest(id, other) AS id_b FROM near""",
    "p1_found": _FACTS + "SELECT kept AS kept_row, fact_row AS copy_row FROM grouped WHERE fact_row <> kept",
    "p1_copy_counts": _FACTS + "SELECT n AS n_copies, count(*) AS n_groups FROM grouped WHERE fact_row = kept AND n > 1 GROUP BY 1",
    "p8_found": _GRAMS + "SELECT doc_id, item_id FROM found",
    "p8_leaked_items": _GRAMS + "SELECT item_id, split, count(*) AS n_docs FROM found JOIN eval_items USING (item_id) GROUP BY 1, 2",
}
