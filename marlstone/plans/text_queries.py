"""Queries over texts, files and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import chunking, knowledge, relations
from marlstone.session import table
from marlstone.sources import readers

#: The reference's limit of characters a source.
MAX_TEXT_CHARS = 20_000_000


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "path", "source", "title")


def clean_phrase_distinct(spark, d):
    return knowledge.with_fields(table(spark, d, "facts")).where("subject is not null").groupBy(T.clean_phrase("subject").alias("phrase")).agg(F.count(F.lit(1)).alias("n"))


def identifier_tokens(spark, d):
    return _docs(spark, d).select(F.explode(T.split_identifier("path")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def name_texts(spark, d):
    return table(spark, d, "sources").select("id", T.name_text("name").alias("name_text"), T.is_meaningful_phrase("name").alias("is_meaningful"))


def answer_normalize(spark, d):
    return table(spark, d, "eval_items").select("item_id", T.normalize_answer("item_text").alias("answer"))


def module_names(spark, d):
    return _docs(spark, d).select("doc_id", T.module_qualname("path").alias("module"), T.package_of(T.module_qualname("path")).alias("package"), T.path_key("path").alias("key"), T.is_test_path("path").alias("is_test"))


def answer_split(spark, d):
    thought, answer = T.split_answer(F.concat_ws("", F.col("title"), F.lit(" Answer: "), F.col("text")))
    return table(spark, d, "passages").select("passage_no", thought.alias("thought"), answer.alias("answer"))


def canonical_digests(spark, d):
    return table(spark, d, "sources").select("id", F.sha2(F.concat_ws("\t", "kind", "name", "status"), 256).alias("digest"), T.preview("name", 8).alias("preview"))


def sentences(spark, d):
    return _docs(spark, d).select("doc_id", F.size(chunking.sentences(F.col("text"))).alias("n_sentences"))


def paragraphs(spark, d):
    p = chunking.paragraphs(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(p).alias("n_paragraphs"), F.md5(F.array_join(p, "|")).alias("digest"))


def sections(spark, d):
    return chunking.sections(_docs(spark, d)).select("doc_id", "section", "level", "heading", F.md5("body").alias("body_digest"))


def document_titles(spark, d):
    return _docs(spark, d).select("doc_id", chunking.document_title(F.col("text"), F.col("path")).alias("doc_title"))


def chunk_pack(spark, d):
    return chunking.packed_passages(_docs(spark, d)).groupBy("doc_id").agg(F.max("n_parts").alias("n_parts"), F.max(F.length("text")).alias("longest"), F.sum(F.length("text")).alias("n_chars"))


def code_windows(spark, d):
    files = _docs(spark, d).where("path like '%.py' or path like '%.sql'")
    return chunking.code_windows(files, "doc_id", "text", 600).select("doc_id", "window", "line_start", "line_end", F.length("text").alias("n_chars"))


def mapped_chunks(spark, d):
    return chunking.mapped_chunks(_docs(spark, d), "doc_id", "text", 800)


def passage_ordinals(spark, d):
    return chunking.with_ordinals(table(spark, d, "passages").select("passage_no", "source_id", "created_at"), "source_id", F.to_date("created_at"), "created_at", "passage_no").select("passage_no", "source_id", "ordinal")


def nonblank_passages(spark, d):
    return table(spark, d, "passages").where(F.trim(F.coalesce("text", F.lit(""))) != "").groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"))


def html_to_text(spark, d):
    pages = _docs(spark, d).where("path like '%.html'")
    return readers.html_text(pages.withColumnRenamed("text", "html"), "html").select("doc_id", "text")


def html_text_plain(spark, d):
    return _docs(spark, d).where("path like '%.html'").select("doc_id", readers.html_text_sql(F.col("text")).alias("plain"))


def file_kinds(spark, d):
    return _docs(spark, d).groupBy(readers.file_kind(F.col("path")).alias("kind"), readers.language_of(F.col("path")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


def classify_counts(spark, d):
    return _docs(spark, d).groupBy(readers.classify_content(F.col("path"), F.col("text")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


def partition_families(spark, d):
    c = _docs(spark, d).where("source is not null").select("source", readers.classify_content(F.col("path"), F.col("text")).alias("family"))
    return readers.family_of_partition(c, "source")


def text_budget(spark, d):
    """Documents taken from each source; a source whose text is too long fails as a whole, with 0."""
    docs = _docs(spark, d).where("source is not null").select("source", "text")
    taken = readers.within_text_budget(docs, "source", "text", MAX_TEXT_CHARS).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return docs.select("source").distinct().join(taken, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("n"))


def raw_store(spark, d):
    files = _docs(spark, d).select(F.encode("text", "UTF-8").alias("content"))
    return readers.raw_store(files).select("digest", "n_bytes", "n_copies")


def binary_sniff(spark, d):
    return _docs(spark, d).groupBy(readers.is_binary(F.encode("text", "UTF-8")).alias("is_binary")).agg(F.count(F.lit(1)).alias("n"))


def cached_vectors(spark, d):
    """Vectors of all passages: the first source's from a cache, each missing text embedded once."""
    p = table(spark, d, "passages").where("text is not null").select(F.col("passage_no").alias("pos"), "text", "source_id")
    embed = readers.hashed_embedding()
    cache = embed(p.where("source_id = 'src-000-wajanora'").select(F.sha2("text", 256).alias("digest"), "text").dropDuplicates(["digest"]))
    got, _ = readers.with_cached_vectors(p.select("pos", "text"), cache, embed)
    return got.select("pos", F.size("embedding").alias("dim"))


def lookup_in_order(spark, d):
    return relations.lookup_in_order(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey", [7, 3, 99, 12, 3])


def page_limit_offset(spark, d):
    return relations.page(table(spark, d, "passages").select("source_id", "ordinal", "passage_no"), ["source_id", "ordinal", "passage_no"], 50, 100)


def first_seen_texts(spark, d):
    rows = _docs(spark, d).select(F.md5("text").alias("digest"), "doc_id", "path")
    return relations.first_seen(rows, ["digest"], ["doc_id"])


def merged_bundles(spark, d):
    return relations.merged_bundles(knowledge.with_fields(table(spark, d, "facts")).where("subject is not null").select("passage_id", "subject"), "passage_id", "subject")


QUERIES = {f.__name__: f for f in (
    clean_phrase_distinct, identifier_tokens, name_texts, answer_normalize, module_names, answer_split, canonical_digests, sentences, paragraphs, sections, document_titles, chunk_pack, code_windows,
    mapped_chunks, passage_ordinals, nonblank_passages, html_to_text, html_text_plain, file_kinds, classify_counts, partition_families, text_budget, raw_store, binary_sniff, cached_vectors, lookup_in_order,
    page_limit_offset, first_seen_texts, merged_bundles,
)}

#: Facts with the fields that stand in ``raw_triple`` filled in, as ``told``; begins the SQL of every query over facts.
TOLD = r"""told_parts AS (
  SELECT *, list_transform(string_split(regexp_replace(raw_triple, '[;|]\s*(subject|predicate|object)\s*([:=])', chr(1) || '\1\2', 'gi'), chr(1)),
    lambda x: regexp_extract(x, '(?is)^\s*(subject|predicate|object)\s*[:=](.*)$', ['k', 'v'])) AS kv FROM facts
), told AS (SELECT * REPLACE (
    coalesce(subject, CASE WHEN raw_triple LIKE '{%' THEN coalesce(raw_triple ->> '$.subject', raw_triple ->> '$.Subject', raw_triple ->> '$.SUBJECT') ELSE trim(list_filter(kv, lambda x: lower(x.k) = 'subject')[1].v, ' ') END) AS subject,
    coalesce(predicate, CASE WHEN raw_triple LIKE '{%' THEN coalesce(raw_triple ->> '$.predicate', raw_triple ->> '$.Predicate', raw_triple ->> '$.PREDICATE') ELSE trim(list_filter(kv, lambda x: lower(x.k) = 'predicate')[1].v, ' ') END) AS predicate,
    coalesce(object, CASE WHEN raw_triple LIKE '{%' THEN coalesce(raw_triple ->> '$.object', raw_triple ->> '$.Object', raw_triple ->> '$.OBJECT') ELSE trim(list_filter(kv, lambda x: lower(x.k) = 'object')[1].v, ' ') END) AS object
  ) FROM told_parts)"""
CLEAN = r"trim(regexp_replace(regexp_replace(replace(lower({0}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}]', ' ', 'g'), ' +', ' ', 'g'))"
_SPLIT = r"list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'), '(\p{{Lu}}+)(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g'), '([\p{{Ll}}])(\p{{Lu}})', '\1 \2', 'g'), '(\p{{L}})(\p{{N}})', '\1 \2', 'g'), '(\p{{N}})(\p{{L}})', '\1 \2', 'g')), ' '), lambda t: t <> '')"
SPLIT = _SPLIT
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_MODULE = r"replace(trim(regexp_replace(regexp_replace(path, '\.[A-Za-z0-9]+$', ''), '(^|/)(__init__|index|mod)$', ''), '/'), '/', '.')"
_SUFFIX = r"lower(regexp_extract(path, '\.([A-Za-z0-9]+)$', 1))"
_FAMILY = r"""
CASE WHEN regexp_matches(head, '(?i)\bcreate\s+table\b') THEN 'schema'
  WHEN regexp_matches(head, '(?m)^\s*"?(openapi|swagger)"?\s*:') THEN 'api'
  WHEN regexp_matches(head, '(?m)^apiVersion:') AND regexp_matches(head, '(?m)^kind:') THEN 'deployment'
  WHEN regexp_matches(head, '(?m)^(services|components):') THEN 'catalog'
  WHEN list_contains(hs, 'context') AND list_contains(hs, 'decision') THEN 'decision'
  WHEN regexp_matches(l1, '^\{.*\}$') AND (l2 = '' OR regexp_matches(l2, '^\{.*\}$')) THEN 'rows_ndjson'
  WHEN regexp_matches(body, '^\[\s*\{') THEN 'rows_json'
  WHEN regexp_matches(body, '^\{') THEN 'object_json'
  WHEN c1 >= 1 AND c1 = c2 AND NOT regexp_matches(l1, '[.!?]\s') THEN 'rows_csv'
  WHEN regexp_matches(list_extract(string_split(path, '/'), -1), '(?i)^(readme|changelog|license)') THEN 'notes'
  ELSE 'unclassified' END"""
_CLASSIFIED = rf"""
WITH a AS (SELECT source, path, text AS head, {_STRIP.format('text')} AS body FROM documents),
b AS (SELECT *, regexp_extract(body, '^([^\n]*)', 1) AS l1, regexp_extract(body, '^[^\n]*\n([^\n]*)', 1) AS l2,
  list_transform(regexp_extract_all(head, '(?m)^#+\s+(.+)$', 1), lambda h: lower(h)) AS hs FROM a),
c AS (SELECT *, length(l1) - length(replace(l1, ',', '')) AS c1, length(l2) - length(replace(l2, ',', '')) AS c2 FROM b),
k AS (SELECT source, {_FAMILY} AS family FROM c)
"""
ORACLE = {
    "clean_phrase_distinct": f"WITH {TOLD} SELECT {CLEAN.format('subject')} AS phrase, count(*) AS n FROM told WHERE subject IS NOT NULL GROUP BY 1",
    "identifier_tokens": f"SELECT token, count(*) AS n FROM (SELECT unnest({_SPLIT.format('path')}) AS token FROM documents) GROUP BY 1",
    "name_texts": rf"SELECT id, CASE WHEN array_to_string({_SPLIT.format('name')}, ' ') = name THEN name ELSE array_to_string({_SPLIT.format('name')}, ' ') || ' ' || name END AS name_text, length(regexp_replace(name, '[^\p{{L}}\p{{N}}]', '', 'g')) >= 3 AS is_meaningful FROM sources",
    "answer_normalize": r"SELECT item_id, array_to_string(list_filter(string_split_regex(regexp_replace(lower(item_text), '[!-/:-@\[-`{-~]', '', 'g'), '\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ') AS answer FROM eval_items",
    "module_names": rf"SELECT doc_id, {_MODULE} AS module, CASE WHEN contains({_MODULE}, '.') THEN regexp_replace({_MODULE}, '\.[^.]*$', '') ELSE '' END AS package, list_extract(string_split(path, '/'), -1) AS key, regexp_matches(lower(path), '(^|/)(tests?|__tests__|spec)/') OR regexp_matches(list_extract(string_split(lower(path), '/'), -1), '^test_|_test\.|\.test\.|\.spec\.|tests?\.cs$') AS is_test FROM documents",
    "answer_split": r"SELECT passage_no, trim(coalesce(title, '')) AS thought, trim(coalesce(text, '')) AS answer FROM passages",
    "canonical_digests": "SELECT id, sha256(concat_ws(chr(9), kind, name, status)) AS digest, left(name, 8) AS preview FROM sources",
    "sentences": r"SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')) AS n_sentences FROM documents",
    "paragraphs": rf"SELECT doc_id, len(p) AS n_paragraphs, md5(array_to_string(p, '|')) AS digest FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS p FROM documents)",
    "sections": rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
f AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^\s*```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS fences FROM l),
h AS (SELECT *, regexp_matches(line, '^#{{1,6}}\s+\S') AND fences % 2 = 0 AS is_h FROM f),
s AS (SELECT *, sum(CASE WHEN is_h THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM h),
g AS (SELECT doc_id, section, max(CASE WHEN is_h THEN line END) AS head, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT is_h), '') AS body FROM s GROUP BY 1, 2)
SELECT doc_id, section::BIGINT AS section, coalesce(length(regexp_extract(head, '^(#+)', 1)), 0) AS level, trim(regexp_replace(coalesce(head, ''), '^#+\s+', '')) AS heading, md5({_STRIP.format('body')}) AS body_digest
FROM g WHERE {_STRIP.format('body')} <> ''""",
    "document_titles": r"SELECT doc_id, CASE WHEN regexp_matches(trim(regexp_extract(text, '^\s*([^\n]*)', 1)), '^#\s+\S') THEN trim(regexp_replace(trim(regexp_extract(text, '^\s*([^\n]*)', 1)), '^#\s+', '')) ELSE path END AS doc_title FROM documents",
    "passage_ordinals": "SELECT passage_no, source_id, row_number() OVER (PARTITION BY source_id ORDER BY created_at, passage_no) - 1 AS ordinal FROM passages",
    "nonblank_passages": "SELECT source_id, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM passages WHERE trim(coalesce(text, '')) <> '' GROUP BY 1",
    "html_text_plain": r"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
  '(?is)<(?:script|style|noscript|template|head|svg)\b.*?</(?:script|style|noscript|template|head|svg)\s*>|<!--.*?-->', '', 'g'),
  '(?i)<h([1-6])\b[^>]*>', chr(10) || chr(10) || '# ', 'g'), '(?i)</?(p|div|li|ul|ol|tr|table|br|h[1-6]|section|article|body|html)\b[^>]*>', chr(10) || chr(10), 'g'),
  '<[^>]+>', '', 'g'), '[ \t]+', ' ', 'g'), ' ?\n\s*\n\s*', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS plain FROM documents WHERE path LIKE '%.html'""",
    "file_kinds": f"""
SELECT CASE WHEN s IN ('txt', 'md', 'markdown', 'rst', 'text') THEN 'prose' WHEN s IN ('pdf', 'docx', 'epub', 'html', 'htm') THEN 'rich'
  WHEN s IN ('py', 'ts', 'tsx', 'js', 'jsx', 'go', 'cs', 'rs', 'sql') THEN 'code' ELSE 'other' END AS kind,
  CASE s WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'go' THEN 'go' WHEN 'cs' THEN 'csharp' WHEN 'rs' THEN 'rust' WHEN 'sql' THEN 'sql' END AS language,
  count(*) AS n FROM (SELECT {_SUFFIX} AS s FROM documents) GROUP BY 1, 2""",
    "classify_counts": _CLASSIFIED + "SELECT family, count(*) AS n FROM k GROUP BY 1",
    "partition_families": _CLASSIFIED + """
SELECT source, CASE WHEN count(DISTINCT CASE WHEN family <> 'unclassified' THEN family END) = 1 THEN max(CASE WHEN family <> 'unclassified' THEN family END) ELSE 'mixed' END AS family,
  count(*) FILTER (WHERE family <> 'unclassified') AS n_classified, count(*) FILTER (WHERE family = 'unclassified') AS n_unclassified FROM k WHERE source IS NOT NULL GROUP BY 1""",
    "text_budget": f"SELECT source, CASE WHEN coalesce(sum(length(text)), 0) <= {MAX_TEXT_CHARS} THEN count(*) ELSE 0 END AS n FROM documents WHERE source IS NOT NULL GROUP BY 1",
    "raw_store": "SELECT sha256(text) AS digest, strlen(text) AS n_bytes, count(*) AS n_copies FROM documents WHERE text IS NOT NULL GROUP BY 1, 2",
    "binary_sniff": "SELECT false AS is_binary, count(*) AS n FROM documents",
    "cached_vectors": "SELECT passage_no AS pos, 64 AS dim FROM passages WHERE text IS NOT NULL",
    "lookup_in_order": "SELECT pos, n_nationkey, n_name FROM (VALUES (0, 7), (1, 3), (2, 99), (3, 12), (4, 3)) a(pos, k) JOIN nation ON n_nationkey = k",
    "page_limit_offset": "SELECT source_id, ordinal, passage_no FROM passages ORDER BY source_id, ordinal, passage_no LIMIT 50 OFFSET 100",
    "first_seen_texts": "SELECT digest, doc_id, path FROM (SELECT md5(text) AS digest, doc_id, path FROM documents) QUALIFY row_number() OVER (PARTITION BY digest ORDER BY doc_id) = 1",
    "merged_bundles": f"WITH {TOLD} SELECT passage_id, min(subject) AS subject, count(DISTINCT subject) > 1 AS in_conflict, count(*) AS n_bundles FROM told WHERE subject IS NOT NULL GROUP BY 1",
}
