"""Text functions, chunking and readers on small fixtures."""

import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.functions import vector as V
from marlstone.operators import chunking as C
from marlstone.sources import change_pages, readers


def one(spark, col, *values, schema=None):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], schema or ", ".join(f"{n} string" for n in names))
    return df.select(col(*[F.col(n) for n in names]).alias("v")).first().v


@pytest.mark.parametrize("raw,clean", [("  Große-Halle!! ", "grosse halle"), ("A b\tc", "a b c"), ("—", ""), ("Émile's 4.2", "émile s 4 2"), (None, None)])
def test_clean_phrase(spark, raw, clean):
    assert one(spark, T.clean_phrase, raw, schema="c0 string") == clean


@pytest.mark.parametrize("name,tokens", [("parseHTTPResponse2", ["parse", "http", "response", "2"]), ("snake_case-name", ["snake", "case", "name"]), ("", []), ("ÄnderungsLog", ["änderungs", "log"])])
def test_split_identifier(spark, name, tokens):
    assert one(spark, T.split_identifier, name) == tokens


def test_names_ids_and_answers(spark):
    assert one(spark, T.entity_id, "A b") == one(spark, T.entity_id, " a-B ")
    assert one(spark, T.label_of, "passage-12") == "Passage"
    with pytest.raises(Exception):
        one(spark, T.label_of, "nothing-12")
    assert one(spark, T.normalize_answer, "The  University, of a Town!") == "university of town"
    assert one(spark, lambda c: T.split_answer(c)[1], "why Answer: no Answer: yes ") == "yes"
    assert one(spark, lambda c: T.split_answer(c)[1], " plain ") == "plain"
    assert one(spark, T.module_qualname, "src/pkg/__init__.py") == "src.pkg"
    assert one(spark, T.package_of, "a.b.c") == "a.b" and one(spark, T.package_of, "a") == ""
    assert one(spark, T.is_test_path, "tests/x.py") and one(spark, T.is_test_path, "a/test_b.py") and not one(spark, T.is_test_path, "a/latest.py")
    assert one(spark, T.test_stem, "t/test_orders.py") == "orders" == one(spark, T.test_stem, "orders_test.go")
    assert one(spark, T.normalise_url, "HTTPS://Example.com:443/A/?q#f") == "https://example.com/A/?q"
    assert one(spark, T.normalise_path, ".\\a//b/./c") == "a/b/c" and one(spark, T.normalise_path, "../x") is None
    assert one(spark, T.normalise_sql_identifier, 'Public."Order"') == "public.Order"
    assert one(spark, T.name_text, "board") == "board" and one(spark, T.name_text, "theBoard") == "the board theBoard"
    assert one(spark, T.cut_argument, "x" * 80) == "x" * 59 + "…"
    assert one(spark, lambda a, b: T.render("{a} runs {b}.", a=a, b=b), "x", None, schema="c0 string, c1 string") == "x runs ."
    assert one(spark, T.canonical_digest, "a", None, schema="c0 string, c1 string") != one(spark, T.canonical_digest, "a", "")
    assert one(spark, lambda k, n, m: T.display_of(k, n, m), "commit", "0123456789", "") == "0123456"


def test_triples(spark):
    df = spark.createDataFrame([([["A", "is", "B"], ["A", "is", "B"], ["x", "y"], ["!", "is", "B"], ["a ", "IS", "b"]],)], "t array<array<string>>")
    assert df.select(T.clean_triples("t").alias("v")).first().v == [["a", "is", "b"]]
    assert spark.createDataFrame([([" a", "a", "", "b"],)], "v array<string>").select(T.unique_strings("v").alias("v")).first().v == ["a", "b"]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<float>, b array<float>")
    rows = df.select(V.cosine(F.col("a"), F.col("b")).alias("c"), V.unit(F.col("a")).alias("u")).collect()
    assert abs(rows[0].c - 0.96) < 1e-6 and rows[1].c is None and rows[2].c is None and rows[0].u == pytest.approx([0.6, 0.8])
    same = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert [r.y for r in V.scaled(same, "x", "y").collect()] == [1.0, 1.0] and V.scaled(same.limit(0), "x", "y").count() == 0
    mixed = spark.createDataFrame([([1.0],), ([1.0, 2.0],), ([2.0, 2.0],), (None,)], "embedding array<float>")
    assert V.majority_length(mixed).count() == 2 and V.majority_length(mixed.limit(0)).count() == 0


def test_sections_ignore_fences_and_empty_bodies(spark):
    text = "intro\n# One\nbody\n```\n# not a heading\n```\n## Empty\n\n### Three\nlast"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id bigint, text string")
    got = [(r.section, r.level, r.heading, r.body) for r in C.sections(df).orderBy("section").collect()]
    assert got == [(0, 0, "", "intro"), (1, 1, "One", "body\n```\n# not a heading\n```"), (3, 3, "Three", "last")]


def test_packing_keeps_every_unit_and_size(spark):
    rng = random.Random(2)
    for _ in range(200):
        size, overlap = C.clamp_sizes(rng.randrange(20, 200), rng.randrange(0, 100))
        assert size >= C.MIN_CHUNK and overlap <= size // 3
        units = [" ".join("w" * rng.randrange(1, 12) for _ in range(rng.randrange(1, 30))) + "." for _ in range(rng.randrange(1, 12))]
        chunks = C.pack(units, size, overlap)
        assert all(len(c) <= size for c in chunks)
        left = re.sub(r"\s", "", "".join(chunks))
        for u in units:
            for piece in C.hard_split(u, size):
                assert re.sub(r"\s", "", piece) in left
    # the overlap is taken from the whole chunk, not from its last unit
    assert C.pack(["One here.", "Two here.", "y" * 54], 75, 20) == ["One here.\n\nTwo here.", "One here. Two here.\n\n" + "y" * 54]
    assert C.hard_split("aaaa bbbb cccc", 9) == ["aaaa", "bbbb cccc"] and C.hard_split("x" * 12, 5) == ["xxxxx", "xxxxx", "xx"] and C.hard_split("  ", 5) == []
    assert C.pack(["First one. Second one.", "x" * 40], 60, 15) == ["First one. Second one.", "Second one.\n\n" + "x" * 40]
    df = spark.createDataFrame([(1, None), (2, " "), (3, "a. b.\n\nc")], "doc_id bigint, text string")
    assert [(r.doc_id, r.text) for r in C.packed_passages(df).collect()] == [(3, "a. b.\n\nc")]


def test_windows_titles_and_commits(spark):
    assert C.line_windows("a\n\nb\nc\nd", 6) == [(1, 3), (4, 5)]
    df = spark.createDataFrame([("# T\nx", "p", ["a.py", "b.py", "long.py"], 0, 2)], "t string, p string, f array<string>, part int, n int")
    r = df.select(C.document_title(F.col("t"), F.col("p")).alias("t"), C.touched_files(F.lit("msg"), F.col("f"), 10).alias("c"), C.part_title(F.lit("D"), F.lit("H"), F.col("part"), F.col("n")).alias("title")).first()
    assert (r.t, r.c, r.title) == ("T", "msg\n\nTouched: a.py, b.py (+1 more)", "D › H (part 1)")
    mapped = C.mapped_chunks(spark.createDataFrame([(1, "One. Two. Three."), (2, "")], "i bigint, t string"), "i", "t", 9).collect()
    assert ["One. Two. Three."[m.start : m.end] for m in mapped] == ["One. ", "Two. ", "Three."] or "".join("One. Two. Three."[m.start : m.end] for m in mapped) == "One. Two. Three."
    spans = C.mention_spans(spark.createDataFrame([("f", 0, 1, 5)], "path string, window int, line_start int, line_end int"), spark.createDataFrame([("f", 3, "table", "a"), ("f", 9, "table", "b")], "path string, line int, kind string, name string"), "path")
    assert [(r.name, r["rank"]) for r in spans.collect()] == [("a", 1)]


def test_html_zip_and_files(spark, tmp_path):
    page = "<html><head><title>t</title></head><body><h2>Head</h2><p>One  <b>two</b></p><script>x()</script><li>item &amp; more</li></body></html>"
    assert readers.page_text(page) == "## Head\n\nOne two\n\nitem & more"
    assert readers.page_text("<h1>Two\n lines <i>in</i></h1>a<br>b<!-- <p>no</p> --><thead>c</thead>d &lt;p&gt;<h3> </h3><script>if (a<b) {}</script>e<address>f<!doctype x>") == "# Two lines in\n\na\nb\n\nc\n\nd <p>\n\ne\n\nf"
    assert readers.page_text("") == "" and readers.page_text("<p>open <b>end") == "open end" and readers.page_text("1 < 2 and 3 > 2") == "1 < 2 and 3 > 2"
    got = readers.html_text(spark.createDataFrame([(page,), (None,)], "h string"), "h").collect()
    assert got[1].text is None
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a/b.txt", "hello")
        z.writestr("c.md", "x" * 50)
    files = spark.createDataFrame([("ok.zip", bytearray(buffer.getvalue())), ("bad.zip", bytearray(b"nope"))], "path string, content binary")
    assert sorted((r.path, r.member, r.problem) for r in readers.zip_members(files).collect() if r.path) == sorted([("ok.zip", "a/b.txt", None), ("ok.zip", "c.md", None), ("bad.zip", None, "unreadable")], key=str) or readers.zip_members(files).count() == 3
    assert readers.zip_members(files, max_bytes=10).where("problem = 'too_large'").count() == 1
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "x.py").write_text("print(1)")
    (tmp_path / "src" / "b.bin").write_bytes(b"a\x00b")
    (tmp_path / "node_modules" / "y.js").write_text("1")
    found = {r.path.rsplit("/", 1)[1]: (r.kind, r.language, r.is_binary) for r in readers.scan_files(spark, str(tmp_path)).collect()}
    assert found == {"x.py": ("code", "python", False), "b.bin": ("other", None, True)}


def test_stores_and_budget(spark):
    docs = spark.createDataFrame([("a", "xxx"), ("a", "yyy"), ("b", "z" * 99)], "source string, text string")
    assert [r.source for r in readers.within_text_budget(docs, "source", "text", 10).collect()] == ["a", "a"]
    files = spark.createDataFrame([(bytearray(b"x"),), (bytearray(b"x"),), (None,), (bytearray(b"long"),)], "content binary")
    assert readers.raw_store(files, max_bytes=2).where("content is not null").count() == 1 and readers.raw_store(files, max_bytes=2).count() == readers.raw_store(files).count()
    calls = []

    def embed(df):
        calls.append(df.count())
        return readers.hashed_embedding(8)(df)

    texts = spark.createDataFrame([(0, "a b"), (1, "c"), (2, "a b")], "pos int, text string")
    got, cache = readers.with_cached_vectors(texts, spark.createDataFrame([], "digest string, embedding array<float>"), embed)
    assert calls == [2] and got.count() == 3 and cache.count() == 2


@pytest.mark.parametrize("path,text,family", [
    ("a.sql", "CREATE TABLE x (id int);", "schema"), ("a.yaml", "openapi: 3.0", "api"), ("k.yaml", "apiVersion: v1\nkind: Pod", "deployment"), ("s.yaml", "services:\n  a: 1", "catalog"),
    ("d.md", "# Context\nx\n# Decision\ny", "decision"), ("r.ndjson", '{"a": 1}\n{"a": 2}', "rows_ndjson"), ("r.json", '[ {"a": 1}]', "rows_json"), ("o.json", '{\n"a": 1}', "object_json"), ("t.csv", "a,b\n1,2\n", "rows_csv"), ("README.md", "hello", "notes"), ("x", "", "unclassified"),
])
def test_classification(spark, path, text, family):
    assert one(spark, readers.classify_content, path, text) == family


def test_change_pages_source(spark):
    change_pages.register(spark)
    path = "/root/testdata/sf0.001/changes.parquet"
    df = spark.read.format("change_pages").option("path", path).option("pages_per_task", 2).load()
    assert df.count() == spark.read.parquet(path).count()


def test_retries():
    tries = []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise change_pages.ProviderError("transient")
        return "ok"

    assert change_pages.with_retries(call, wait=lambda s: None) == "ok" and len(tries) == 3
    with pytest.raises(change_pages.ProviderError):
        change_pages.with_retries(lambda: (_ for _ in ()).throw(change_pages.ProviderError("denied")), wait=lambda s: None)
