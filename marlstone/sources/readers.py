"""Readers of files and archives, format sniffing, and stores of raw bytes and vectors."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of files by suffix (fixed values).
PROSE = ("txt", "md", "markdown", "rst", "text")
RICH = ("pdf", "docx", "epub", "html", "htm")
LANGUAGES = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "go": "go", "cs": "csharp", "rs": "rust", "sql": "sql"}
#: Folders that hold no sources of their own (fixed values).
SKIPPED_FOLDERS = (".git", "node_modules", "vendor", "dist", "build", "__pycache__", ".venv", "venv", "target")
SNIFF_BYTES = 8000


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def file_kind(path: Column) -> Column:
    """prose, rich, code or other, by suffix."""
    s = suffix(path)
    return F.when(s.isin(*PROSE), "prose").when(s.isin(*RICH), "rich").when(s.isin(*LANGUAGES), "code").otherwise("other")


def language_of(path: Column) -> Column:
    """Programming language by suffix; null for other files."""
    s = suffix(path)
    out = F.lit(None).cast("string")
    for ending, language in LANGUAGES.items():
        out = F.when(s == ending, language).otherwise(out)
    return out


def is_binary(content: Column) -> Column:
    """A NUL byte, or bytes that are no UTF-8, at the beginning; a character cut by the end of the sample is no reason."""
    head = F.substring(content, 1, SNIFF_BYTES)
    cut = F.when(F.length(content) > SNIFF_BYTES, 3).otherwise(0)
    valid = F.is_valid_utf8(head) | ((cut > 0) & (F.is_valid_utf8(F.substring(content, 1, SNIFF_BYTES - 1)) | F.is_valid_utf8(F.substring(content, 1, SNIFF_BYTES - 2)) | F.is_valid_utf8(F.substring(content, 1, SNIFF_BYTES - 3))))
    return F.contains(head, F.lit(b"\x00")) | ~valid


def scan_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files below a folder: path, kind, language, content, is_binary; vendored and generated folders are skipped."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path).where(~F.col("path").rlike(rf"/({'|'.join(s.replace('.', '[.]') for s in SKIPPED_FOLDERS)})/"))
    return files.select("path", file_kind(F.col("path")).alias("kind"), language_of(F.col("path")).alias("language"), "content", is_binary(F.col("content")).alias("is_binary"))


#: Tags whose content is no text, and tags that stand apart from what is around them (fixed values).
UNREAD = ("script", "style", "noscript", "template", "head", "svg")
APART = (
    "p", "div", "section", "article", "header", "footer", "main", "aside", "nav", "blockquote", "pre", "ul", "ol", "li", "table", "thead", "tbody", "tr", "dl", "dt", "dd", "hr", "figure", "figcaption",
    "form", "fieldset", "address",
)
_UNREAD = re.compile(rf"(?is)<!--.*?(?:-->|\Z)|<({'|'.join(UNREAD)})\b[^>]*>.*?(?:</\1\s*>|\Z)")
_MARKUP = re.compile(r"(?is)<(/?)([a-z][a-z0-9:-]*)\b[^>]*>|<[!?/][^>]*>")
#: Bounds of a heading while the page is rewritten; no page holds them, as they are no characters of text.
_OPEN, _CLOSE = "\ufdd0", "\ufdd1"
#: What a tag leaves behind, at its beginning and at its end.
_LEAVES = {t: ("\n\n", "\n\n") for t in APART} | {"br": ("\n", "\n\n")} | {f"h{n}": (f"\n\n{'#' * n} {_OPEN}", f"{_CLOSE}\n\n") for n in range(1, 7)}


def page_text(html: str) -> str:
    """Readable text of one page: headings marked and on one line, blocks apart by one blank line, line breaks kept, empty headings dropped."""
    marked = _MARKUP.sub(lambda m: _LEAVES.get((m[2] or "").lower(), ("", ""))[bool(m[1])], _UNREAD.sub("", html))
    marked = re.sub(rf"(?s){_OPEN}(.*?)(?:{_CLOSE}|\Z)", lambda m: " ".join(m[1].split()), unescape(marked))
    lines = (" ".join(re.split(r"[ \t]+", line.strip())) for line in marked.replace(_CLOSE, "").splitlines())
    return re.sub(r"\n{3,}", "\n\n", "\n".join(line for line in lines if not line or line.strip("#"))).strip()


def html_text(pages: DataFrame, html_col: str, out: str = "text") -> DataFrame:
    """Adds the readable text of each page; null stays null."""
    @F.pandas_udf("string")
    def convert(html: pd.Series) -> pd.Series:
        return html.map(lambda h: None if h is None else page_text(h))

    return pages.withColumn(out, convert(F.col(html_col)))


def html_text_sql(html: Column) -> Column:
    """The same for simple pages without a parser: tags dropped by patterns; everything stays in the JVM."""
    bare = F.regexp_replace(html, r"(?is)<(?:script|style|noscript|template|head|svg)\b.*?</(?:script|style|noscript|template|head|svg)\s*>|<!--.*?-->", "")
    bare = F.regexp_replace(bare, r"(?i)<h([1-6])\b[^>]*>", "\n\n# ")
    bare = F.regexp_replace(bare, r"(?i)</?(p|div|li|ul|ol|tr|table|br|h[1-6]|section|article|body|html)\b[^>]*>", "\n\n")
    bare = F.regexp_replace(F.regexp_replace(bare, r"<[^>]+>", ""), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(bare, r" ?\n\s*\n\s*", "\n\n"), r"^\s+|\s+$", "")


def zip_members(archives: DataFrame, max_members: int = 5000, max_bytes: int = 200_000_000) -> DataFrame:
    """Members of zip archives (path, content): path, member, content, problem. Counts and unpacked sizes are checked before anything is
    unpacked; a bad or oversized archive gives one row with its problem."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        infos = [i for i in z.infolist() if not i.is_dir()]
                        if len(infos) > max_members or sum(i.file_size for i in infos) > max_bytes:
                            yield pd.DataFrame([(path, None, None, "too_large")], columns=["path", "member", "content", "problem"])
                            continue
                        for i in infos:
                            yield pd.DataFrame([(path, i.filename, z.read(i), None)], columns=["path", "member", "content", "problem"])
                except (zipfile.BadZipFile, RuntimeError, TypeError):
                    yield pd.DataFrame([(path, None, None, "unreadable")], columns=["path", "member", "content", "problem"])

    return archives.select("path", "content").mapInPandas(run, "path string, member string, content binary, problem string")


def within_text_budget(docs: DataFrame, source: str, text: str, limit: int) -> DataFrame:
    """Documents of sources whose whole text stays within ``limit`` characters; a source beyond it fails as a whole."""
    total = docs.groupBy(source).agg(F.sum(F.length(text)).alias("_total"))
    return docs.join(total.where(F.coalesce("_total", F.lit(0)) <= limit).select(source), source, "left_semi")


def raw_store(files: DataFrame, max_bytes: int = 50_000_000) -> DataFrame:
    """Content-addressed bytes: digest, n_bytes, content and n_copies; equal contents once. Of larger ones only digest and size are kept,
    with a null content, so that none vanishes."""
    held = files.where(F.col("content").isNotNull())
    kept = F.first(F.when(F.length("content") <= max_bytes, F.col("content"))).alias("content")
    return held.groupBy(F.sha2("content", 256).alias("digest")).agg(F.first(F.length("content")).alias("n_bytes"), kept, F.count(F.lit(1)).alias("n_copies"))


def with_cached_vectors(texts: DataFrame, cache: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Vectors of (pos, text) from a cache (digest, embedding); each text that is missing is embedded once.

    ``embed`` turns (digest, text) into (digest, embedding). Returns (pos, text, embedding) and the enlarged cache.
    """
    keyed = texts.withColumn("digest", F.sha2("text", 256))
    missing = keyed.select("digest", "text").dropDuplicates(["digest"]).join(cache.select("digest"), "digest", "left_anti")
    grown = cache.select("digest", "embedding").unionByName(embed(missing).select("digest", "embedding"))
    return keyed.join(grown, "digest", "left").drop("digest"), grown


def hashed_embedding(dim: int = 64) -> Callable[[DataFrame], DataFrame]:
    """A stand-in for an embedding model: signed hashed words, at unit length."""
    import numpy as np

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        for pdf in batches:
            out = []
            for text in pdf["text"]:
                v = np.zeros(dim, np.float32)
                for w in (text or "").lower().split():
                    h = zlib.crc32(w.encode())
                    v[h % dim] += 1.0 if h >> 31 else -1.0
                n = float(np.linalg.norm(v))
                out.append((v / n if n else v).tolist())
            yield pd.DataFrame({"digest": pdf["digest"], "embedding": out})

    return lambda df: df.select("digest", "text").mapInPandas(run, "digest string, embedding array<float>")


def classify_content(path: Column, content: Column) -> Column:
    """Family of an artifact; the first rule that holds decides: DDL, API description, k8s manifest, service catalogue, heading signature,
    rows (ndjson, JSON array, csv), name, else unclassified."""
    whole = F.regexp_replace(content, r"^\s+|\s+$", "")
    first = F.regexp_extract(whole, r"^([^\n]*)", 1)
    second = F.regexp_extract(whole, r"^[^\n]*\n([^\n]*)", 1)
    commas = F.length(first) - F.length(F.replace(first, F.lit(","), F.lit("")))
    commas2 = F.length(second) - F.length(F.replace(second, F.lit(","), F.lit("")))
    headings = F.transform(F.regexp_extract_all(content, F.lit(r"(?m)^#+\s+(.+)$"), F.lit(1)), F.lower)
    signature = F.size(F.array_except(F.array(F.lit("context"), F.lit("decision")), headings)) == 0
    return (
        F.when(content.rlike(r"(?i)\bcreate\s+table\b"), "schema")
        .when(content.rlike(r"(?m)^\s*\"?(openapi|swagger)\"?\s*:"), "api")
        .when(content.rlike(r"(?m)^apiVersion:") & content.rlike(r"(?m)^kind:"), "deployment")
        .when(content.rlike(r"(?m)^(services|components):"), "catalog")
        .when(signature, "decision")
        .when(first.rlike(r"^\{.*\}$") & ((second == "") | second.rlike(r"^\{.*\}$")), "rows_ndjson")
        .when(whole.rlike(r"^\[\s*\{"), "rows_json")
        .when(whole.rlike(r"^\{"), "object_json")
        .when((commas >= 1) & (commas == commas2) & ~first.rlike(r"[.!?]\s"), "rows_csv")
        .when(path_name(path).rlike(r"(?i)^(readme|changelog|license)"), "notes")
        .otherwise("unclassified")
    )


def path_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def family_of_partition(classified: DataFrame, partition: str, fallback: str = "mixed") -> DataFrame:
    """Per partition the single decided family, else the fallback; files and unclassified ones counted apart."""
    decided = F.when(F.col("family") != "unclassified", F.col("family"))
    return classified.groupBy(partition).agg(
        F.when(F.count_distinct(decided) == 1, F.max(decided)).otherwise(fallback).alias("family"),
        F.count(decided).alias("n_classified"), F.count_if(F.col("family") == "unclassified").alias("n_unclassified"),
    )
