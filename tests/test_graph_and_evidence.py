"""Graph, retrieval, evaluation, access, intake and code operators on small fixtures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import access, bitemporal, codegraph, evaluation, graph, knowledge, relations, retrieval, sync
from marlstone.operators.bitemporal import Selector


def df(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def rows(frame, *cols):
    return sorted(tuple(r[c] for c in cols) for r in frame.collect())


def test_merged_edges_tuned_zero_and_missing(spark):
    terms = df(spark, "a string, b string, kind string, value double", ("x", "y", "fact", 3.0), ("y", "x", "synonym", 0.9), ("x", "z", "mention", 7.0), ("z", "w", "code", 0.8), ("x", "x", "fact", 9.0), ("p", "q", "fact", 1.0))
    tuned = df(spark, "a string, b string, weight double", ("y", "x", 0.5), ("p", "q", 0.0), ("n", "m", 2.0))
    got = {(r.a, r.b): (r.weight, r.kinds) for r in knowledge.merged_edges(terms, tuned, scale=0.5).collect()}
    assert got == {("x", "y"): (0.5, ["fact", "synonym", "tuned"]), ("x", "z"): (1.0, ["mention"]), ("w", "z"): (0.4, ["code"]), ("m", "n"): (2.0, ["tuned"])}


def test_pagerank_against_linear_solve(spark):
    rng = random.Random(6)
    names = [f"v{i}" for i in range(9)]  # the last two have no edges
    w = np.zeros((9, 9))
    edges = []
    for i in range(7):
        for j in range(i):
            if rng.random() < 0.5 or j == i - 1:
                w[i, j] = w[j, i] = rng.choice([0.5, 1, 3])
                edges.append((names[i], names[j], float(w[i, j])))
    p = np.array([1, 0, 2, 0, 0, 0, 0, 3, 0]) / 6
    s = w.sum(1)
    move = np.where(s[:, None] > 0, w / np.maximum(s, 1)[:, None], p[None, :])
    want = np.linalg.solve(np.eye(9) - 0.5 * move.T, 0.5 * p)
    reset = graph.reset_vector(df(spark, "id string, value double", ("v0", 1.0), ("v2", 2.0), ("v7", 3.0), ("v3", -4.0), ("v4", float("nan")), ("v5", None)))
    got = {r.id: r.score for r in graph.personalized_pagerank(graph.mirrored(df(spark, "a string, b string, weight double", *edges)), reset, rounds=30).collect()}
    from marlstone.operators.retrieval import RetrievalSettings

    few = {r.id: r.score for r in graph.personalized_pagerank(graph.mirrored(df(spark, "a string, b string, weight double", *edges)), reset, rounds=RetrievalSettings().rounds).collect()}
    assert max(abs(few[k] - got[k]) for k in got) < 0.5e-12
    hubs = {r.id: r.score for r in graph.personalized_pagerank(graph.mirrored(df(spark, "a string, b string, weight double", *edges)), reset, rounds=30, hot_rows=1).collect()}
    assert hubs.keys() == got.keys() and all(abs(hubs[k] - got[k]) < 1e-12 for k in got)  # vertices laid out in parts
    assert np.allclose([got.get(n, 0.0) for n in names], want, atol=1e-8)
    with pytest.raises(ValueError):
        graph.personalized_pagerank(graph.mirrored(df(spark, "a string, b string, weight double", *edges)), graph.reset_vector(df(spark, "id string, value double", ("v0", -1.0))))


def test_traversals(spark):
    e = df(spark, "src string, dst string, kind string, omega double, weight double", ("a", "b", "INVOKES", 0.9, 1.0), ("a", "c", "INVOKES", 0.9, 5.0), ("b", "d", "READS", 0.9, 1.0), ("c", "d", "INVOKES", 0.9, 1.0), ("d", "e", "INVOKES", 0.4, 1.0), ("a", "e", "CONTAINS", 1.0, 1.0))
    walk = graph.walkable(e, 0.5)
    assert rows(graph.bfs(walk, df(spark, "id string", ("a",)), 3), "id", "hops") == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    path = graph.shortest_path(walk, "a", "d").collect()
    assert [r.path for r in path] == [["a", "c", "d"]] and path[0].kinds == ["INVOKES", "INVOKES"]
    assert graph.shortest_path(walk, "a", "e").count() == 0 and graph.shortest_path(walk, "a", "a").first().path == ["a"]
    blast = graph.blast_radius(walk, df(spark, "id string", ("d",)), cap=2)
    assert rows(blast, "id", "hops", "truncated") == [("b", 1, True), ("c", 1, True)]
    assert [r.id for r in graph.neighbourhood(e, df(spark, "id string", ("a",)), 1, 3).collect()] == ["a", "c", "b"]
    assert rows(graph.induced_edges(e, df(spark, "id string", ("a",), ("b",))), "src", "dst") == [("a", "b")]
    assert [r.id for r in graph.by_degree(e, 1).collect()][0] == "a"
    s = df(spark, "id string, name string, qualname string, display string", ("1", "run", "m.run", "m.run"), ("2", "run", "n.run", "n.run"), ("3", "go", "m.A.go", "m.A.go"))
    assert graph.resolve_symbol(s, "run").first().ambiguous and graph.resolve_symbol(s, "A.go").first().ids == ["3"] and graph.resolve_symbol(s, "none").count() == 0


def test_communities_and_edits(spark):
    tri = [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("x", "y", 1.0), ("y", "z", 1.0), ("x", "z", 1.0), ("c", "x", 0.1)]
    c = {r.id: r.community for r in graph.label_communities(graph.mirrored(df(spark, "a string, b string, weight double", *tri))).collect()}
    assert {c[v] for v in "abc"} == {"a"} and {c[v] for v in "xyz"} == {"x"}
    edits = df(spark, "a string, b string, weight double, pos int", ("b", "a", 5.0, 0), ("a", "b", 0.0, 1), ("q", "r", 2.0, 0))
    got = {(r.a, r.b): r.weight for r in graph.edited(df(spark, "a string, b string, weight double", *tri), edits).collect()}
    assert ("a", "b") not in got and got["q", "r"] == 2.0 and len(got) == 7
    counts = graph.cross_counts(df(spark, "src string, dst string", ("1", "2"), ("2", "1"), ("1", "3")), df(spark, "id string, grp string", ("1", "m"), ("2", "n"), ("3", "m")))
    assert rows(counts, "a", "b", "n") == [("m", "n", 2)]
    named = graph.numbered_communities(df(spark, "community string, name string", ("c1", "zeta"), ("c1", "beta"), ("c2", "alpha")))
    assert rows(named, "number", "label") == [(0, "alpha"), (1, "beta")]
    boosted = graph.boosted(df(spark, "id string, score double", ("p", 1.0), ("q", 1.0)), df(spark, "id string, community string", ("p", "c"), ("s", "c"), ("q", "d")), df(spark, "id string", ("s",)), 0.5)
    assert rows(boosted, "id", "score") == [("p", 1.5), ("q", 1.0)]


def test_budgets_and_orders(spark):
    lines = df(spark, "g string, pos int, text string", ("a", 0, "xxxx"), ("a", 1, "yyyyyy"), ("a", 2, "z"))
    assert rows(relations.prefix_cut(lines, ["g"], F.floor(F.col("pos") / 2), ["pos"], "text", 6), "pos") == [(0,)]
    sized = lines.withColumn("size", F.length("text"))
    assert rows(relations.greedy_fill(sized, ["g"], ["pos"], "size", 6, 9), "pos") == [(0,), (2,)]
    assert relations.greedy_fill(sized.limit(0), ["g"], ["pos"], "size", 6, 9).count() == 0
    rr = relations.round_robin(df(spark, "seed string, item string", ("s", "a"), ("s", "b"), ("t", "a"), ("t", "c")), "seed", ["item"], "item")
    assert rows(rr, "turn", "seed", "item") == [(1, "s", "a"), (2, "s", "b"), (2, "t", "c")]
    ti = relations.tiered_interleave(df(spark, "g string, omega double, direction string, name string", ("g", 0.9, "out", "a"), ("g", 0.9, "in", "z"), ("g", 0.90001, "in", "y"), ("g", 0.95, "out", "q")), "g", "omega", "direction", "name")
    assert [r.name for r in ti.orderBy("position").collect()] == ["q", "y", "a", "z"]
    moved = relations.reordered(df(spark, "id string, rank int", ("a", 1), ("b", 2), ("c", 3), ("d", 4)), F.col("id") == "c", F.col("id") == "a", F.col("id") == "b")
    assert [r.id for r in moved.orderBy("rank").collect()] == ["c", "d", "a", "b"]
    assert relations.select_width(3) == 8 and relations.select_width(10) == 20
    assert rows(relations.best_pairs(df(spark, "a string, b string, score double, manual boolean", ("y", "x", 0.5, False), ("x", "y", 0.8, True), ("x", "x", 1.0, True))), "a", "b", "score", "manual") == [("x", "y", 0.8, True)]


def test_code_edges_refs_and_ranges(spark):
    e = df(spark, "a string, b string, kind string, omega double, pos int, provenance string, line int", ("f", "g", "INVOKES", 0.9, 1, "late", 7), ("f", "g", "INVOKES", 0.9, 0, "first", 3), ("f", "f", "INVOKES", 1.0, 2, "x", 1))
    assert [(r.provenance, r.lines) for r in knowledge.best_code_edges(e).collect()] == [("first", [3, 7])]
    assert rows(knowledge.code_specificity(df(spark, "a string, b string, kind string", ("x", "t", "READS"), ("y", "t", "WRITES"), ("z", "t", "CONTAINS"))), "id", "specificity") == [("t", 3)]
    s = df(spark, "path string, id string, qualname string, line_start int, line_end int, kind string", ("f", "A", "A", 1, 10, "class"), ("f", "A.m", "A.m", 3, 6, "method"), ("f", "M", "", 1, 20, "module"))
    assert rows(knowledge.innermost_symbol(df(spark, "path string, line int", ("f", 4), ("f", 8), ("f", 30)), s), "line", "id") == [(4, "A.m"), (8, "A")]
    own = knowledge.own_lines(s)
    assert rows(own.groupBy("id").count(), "id", "count") == [("A", 6), ("A.m", 4), ("M", 10)]
    hunks = df(spark, "sha string, path string, first int, last int, pos int", ("c", "f", 5, 8, 0))
    assert rows(codegraph.modified_symbols(hunks, own), "id", "churn") == [("A", 2), ("A.m", 2)]
    assert rows(retrieval.overlapping_symbols(df(spark, "path string, first int, last int", ("f", 4, 4)), s), "id") == [("A.m",)]
    assert rows(knowledge.path_suffix_matches(df(spark, "l string", ("src/a/b.py",), ("xb.py",)), df(spark, "r string", ("a/b.py",), ("b.py",)), "l", "r"), "l", "r") == [("src/a/b.py", "a/b.py"), ("src/a/b.py", "b.py")]
    assert rows(knowledge.endpoint_violations(df(spark, "predicate string, subject_kind string, object_kind string", ("P", "a", "b"), ("P", "b", "a")), df(spark, "predicate string, subject_kind string, object_kind string", ("P", "a", "b"))), "subject_kind") == [("b",)]
    refs = knowledge.references(df(spark, "passage_id string, text string", ("p", "The parse tree calls parseTree and x."), ("q", "")), df(spark, "id string, name string", ("1", "parseTree"), ("2", "x"), ("3", "other_name"), ("4", "the_parse_tree_calls_parse_tree_and_x")))
    assert rows(refs, "passage_id", "id", "omega") == [("p", "1", 0.85), ("p", "2", 0.85)]
    long = knowledge.references(df(spark, "passage_id string, text string", ("p", "One two three four five six.")), df(spark, "id string, name string", ("1", "one_two_three_four_five_six"), ("2", "two_three")))
    assert rows(long, "id", "omega") == [("1", 0.6), ("2", 0.6)]


PY = '''"""Doc."""
class Base:
    def run(self):
        raise KeyError("x")
class Child(Base):
    def run(self):
        return helper(1)
def helper(n):
    """Helps a lot."""
    if n:
        raise Oops
    return other.compute_total(n)
class Oops(Exception):
    pass
'''


def test_code_extraction(spark):
    files = df(spark, "path string, text string", ("pkg/a.py", PY), ("pkg/b.py", "def compute_total(n):\n    return n\n"), ("tests/test_a.py", "from pkg.a import helper\ndef test_it():\n    helper(2)\n    compute_total(1)\n"), ("bad.py", "def ("), ("none.py", None))
    s, c = codegraph.python_symbols(files).cache(), codegraph.python_calls(files).cache()
    assert rows(s.where("path = 'pkg/a.py'"), "qualname", "kind") == [("", "module"), ("Base", "class"), ("Base.run", "method"), ("Child", "class"), ("Child.run", "method"), ("Oops", "class"), ("helper", "function")]
    calls = rows(codegraph.invokes_edges(s, c), "a", "b", "omega", "provenance")
    assert ("Child.run", "helper", 1.0, "same_file") in calls and ("helper", "compute_total", 0.5, "unique_name") in calls and ("test_it", "helper", 0.5, "unique_name") in calls
    edges, loose = codegraph.raises_edges(s)
    assert rows(edges, "a", "b") == [("helper", "Oops")] and rows(loose, "a") == [("Base.run",)]
    assert ("Base", "Base.run") in rows(codegraph.contains_edges(s), "a", "b")
    over = codegraph.overrides(df(spark, "cls string, name string", ("Base", "run"), ("Child", "run")), df(spark, "cls string, base string, pos int", ("Child", "Base", 0)))
    assert rows(over, "cls", "name", "overrides") == [("Child", "run", "Base")]
    assert rows(codegraph.tested_by(s, c), "a_path", "b_path", "omega") == [("pkg/a.py", "tests/test_a.py", 0.75), ("pkg/b.py", "tests/test_a.py", 0.6)]
    chain = codegraph.resolve_chain(df(spark, "name string, target string", ("a", "b"), ("b", "c"), ("x", "x")), 5)
    assert rows(chain, "name", "target", "hops") == [("a", "c", 2), ("b", "c", 1)]
    assert rows(codegraph.renamed_paths(df(spark, "name string, target string", ("old", "mid"), ("mid", "new")), df(spark, "path string", ("old",), ("same",))), "path", "present") == [("old", "new"), ("same", "same")]
    assert rows(codegraph.commit_order(df(spark, "repo string, sha string, ordinal int", ("r", "n", 0), ("r", "m", 3))), "a", "b") == [("m", "n")]
    ddl = codegraph.ddl_tables(df(spark, "path string, text string", ("s.sql", "-- c\nCREATE TABLE a.b (\n id INT,\n price DECIMAL(10,2),\n PRIMARY KEY (id)\n);\nCREATE TABLE IF NOT EXISTS c (x TEXT);")))
    assert rows(ddl, "table_name", "line", "columns") == [("a.b", 2, ["id", "price"]), ("c", 7, ["x"])]


def test_unread_files_are_listed(spark):
    files = df(spark, "path string, text string", ("a.py", "x = 1"), ("b.py", "def ("), ("c.py", ""), ("d.py", None), ("e.py", "é" * (codegraph.MAX_BYTES // 2 + 1)))
    assert rows(codegraph.unread_files(files), "path", "reason") == [("b.py", "unparsable"), ("c.py", "empty"), ("d.py", "empty"), ("e.py", "too_large")]


@pytest.mark.parametrize("literal,kind", [("SELECT a FROM t", "sql_read"), ("insert into t values (1)", "sql_write"), ("Select one from the list.", None), ("MATCH (n:User)-[:OWNS]->(m) RETURN n", "cypher_read"), ("MATCH (n:User)-[:OWNS]->(m) SET n.x = 1", "cypher_write"), ("hello", None), ("drop table x", "sql_write"), ("match (n:User) return n", None), ("WITH a AS (SELECT 1) SELECT * FROM a", "sql_read"), ("Merge (x)", None)])
def test_literals(spark, literal, kind):
    assert df(spark, "t string", (literal,)).select(codegraph.literal_access(F.col("t")).alias("k")).first().k == kind


def test_question_anchors(spark):
    q = 'Why?\n```py\nfoo()\n```\nTraceback:\n  File "a.py", line 3, in main\n  File "b.py", line 9, in load\nValueError: bad\n'
    t = df(spark, "id int, q string", (1, q), (2, "Unhandled exception. My.CustomException\n at X.Run(Int32) in /src/a.cs:line 12"), (3, "plain"))
    got = rows(retrieval.frames(t, "id", "q"), "id", "runtime", "k", "path", "line", "function")
    assert got == [(1, "python", 0, "b.py", 9, "load"), (1, "python", 1, "a.py", 3, "main"), (2, "dotnet", 0, "/src/a.cs", 12, "X.Run")]
    assert [r.e for r in t.orderBy("id").select(retrieval.exception_name(F.col("q")).alias("e")).collect()] == ["ValueError", "My.CustomException", None]
    prose, code = retrieval.prose_and_code(F.col("q"))
    r = t.where("id = 1").select(prose.alias("p"), code.alias("c")).first()
    assert "foo()" not in r.p and r.c.strip() == "foo()"
    h = df(spark, "d string", ("@@ -1,2 +5,3 @@ x\n+a\n@@ -9 +20 @@",)).select(retrieval.diff_hunks(F.col("d")).alias("h")).first().h
    assert [(x.first, x.last) for x in h] == [(5, 7), (20, 20)]
    words = df(spark, "w string", ("getUser",), ("HttpClient",), ("snake_case",), ("MAX",), ("word",), ("Word",))
    assert {r.w for r in words.where(retrieval.looks_like_code(F.col("w"))).collect()} == {"getUser", "HttpClient", "snake_case", "MAX"}
    lines = df(spark, "l string", ("x = 1;",), ("def f(a):",), ("call(me)",), ("This is prose.",))
    assert lines.where(retrieval.line_is_code(F.col("l"))).count() == 3


def test_seeds_fallback_and_settings(spark):
    kept = df(spark, "subject_id string, object_id string, dense double", ("a", "b", 1.0), ("a", "c", 0.5))
    w = retrieval.seed_weights(kept, df(spark, "id string, passage_count bigint", ("a", 2), ("b", 0)), df(spark, "id string, boost double", ("c", 0.0)))
    assert rows(w, "id", "weight") == [("a", 0.375), ("b", 1.0), ("c", 0.0)]
    assert rows(retrieval.cut_seeds(w, 1), "id", "weight") == [("a", 0.0), ("b", 1.0), ("c", 0.0)]
    assert retrieval.decide_fallback(0, 0, 1.0) == "dense" and retrieval.decide_fallback(1, 0, 0.0) == "dense" and retrieval.decide_fallback(0, 1, 1.0) == "graph"
    for bad in ({"damping": 2.0}, {"rounds": True}, {"rounds": 1.5}, {"passages": "x"}):
        with pytest.raises(ValueError):
            retrieval.RetrievalSettings(**bad)
    settings, over = retrieval.apply_changeset({"damping": 0.5}, [{"op": "set_setting", "key": "damping", "value": 0.3}, {"op": "set_edge_weight", "a": "y", "b": "x", "weight": 0}, {"op": "set_node_boost", "id": "n", "boost": 0}])
    assert settings == {"damping": 0.3} and over["tuned"] == [("x", "y", 0.0, 1)] and over["boosts"] == [("n", 0.0, 2)]
    m = retrieval.closest_triples(df(spark, "qid int, text string", (1, "a owns b"), (1, "c own d"), (1, "zzz")), df(spark, "qid int, fact_id string, text string", (1, "f1", "a owns b"), (1, "f2", "c owns d")))
    assert rows(m, "asked", "fact_id") == [("a owns b", "f1"), ("c own d", "f2")]
    cites = retrieval.citations(df(spark, "passage_id string", ("p",), ("q",)), df(spark, "passage_id string, original_id string", ("p", "o2"), ("p", "o1")))
    assert rows(cites, "passage_id", "originals", "n") == [("p", ["o1", "o2"], 2), ("q", [], 0)]
    a = df(spark, "x int, y string", (1, "a"), (2, "b"))
    assert retrieval.view_fingerprint(a, ["x", "y"]).first() == retrieval.view_fingerprint(a.orderBy(F.desc("x")), ["x", "y"]).first() != retrieval.view_fingerprint(a.limit(1), ["x", "y"]).first()


def test_search_falls_back_and_ranks(spark):
    p = df(spark, "passage_id string, embedding array<float>", ("p1", [1.0, 0.0]), ("p2", [0.0, 1.0]), ("p3", [0.6, 0.8]))
    f = df(spark, "fact_id string, subject_id string, object_id string, embedding array<float>", ("f1", "e1", "e2", [1.0, 0.0]))
    edges = graph.mirrored(df(spark, "a string, b string, weight double", ("e1", "p2", 1.0), ("e2", "p2", 1.0)))
    spec = df(spark, "id string, passage_count bigint", ("e1", 1), ("e2", 1))
    none = df(spark, "id string, boost double")
    ranked = [r.passage_id for r in retrieval.search(p, f, edges, spec, none, [1.0, 0.0]).orderBy("rank").collect()]
    assert ranked[0] == "p2"  # the graph leads there
    dense = [r.passage_id for r in retrieval.search(p, f.limit(0), edges, spec, none, [1.0, 0.0]).orderBy("rank").collect()]
    assert dense == ["p1", "p3", "p2"]


def test_metrics(spark):
    a = df(spark, "qid int, actual string, expected string", (1, "University of Southampton", "Southampton University"), (2, "the cat", "cat"), (2, "the cat", "dog"), (3, "x", "y"), (4, "a a b", "a b b"))
    f1 = {r.qid: round(r.f1, 4) for r in evaluation.token_f1(a).collect()}
    assert f1 == {1: 0.8, 2: 1.0, 3: 0.0, 4: 0.6667} or f1[1] == 0.8 and f1[2] == 1.0 and f1[3] == 0.0
    assert rows(evaluation.exact_match(a), "qid", "em")[1] == (2, 1.0)
    ranked = df(spark, "qid int, item string, rank int", (1, "a", 1), (1, "b", 2), (1, "c", 3), (1, "a", 9))
    r = evaluation.recall_at(ranked, df(spark, "qid int, item string", (1, "b"), (1, "z"))).first()
    assert (r.recall_1, r.recall_2, r.recall_20, r.gold_rank) == (0.0, 0.5, 0.5, 2)
    m = evaluation.evidence_metrics(ranked, df(spark, "qid int, alternative int, item string", (1, 0, "b"), (1, 0, "z"), (1, 1, "c"))).first()
    dcg, ideal = 1 / np.log2(3) + 1 / np.log2(4), 1 + 1 / np.log2(3) + 1 / np.log2(4)
    assert m.mrr == 0.5 and abs(m.ndcg - dcg / ideal) < 1e-9 and m.any_hit_5 == 1.0 and m.evidence_recall_5 == 1.0 and m.all_required_5 == 1.0
    half = evaluation.evidence_metrics(ranked, df(spark, "qid int, alternative int, item string", (1, 0, "b"), (1, 0, "z"), (1, 1, "y"), (1, 1, "x"), (1, 1, "z")), (1, 5)).first()
    assert (half.evidence_recall_1, half.any_hit_1, half.evidence_recall_5, half.all_required_5) == (0.0, 0.0, 0.5, 0.0)  # of the better alternative
    res = df(spark, "verdict string, f1 double, error_code string, has_gold boolean, gold_rank int", ("correct", 1.0, None, True, 5), ("incorrect", None, "e2", True, None), ("incorrect", 0.0, "e1", False, 1), ("partially_correct", 0.5, None, True, 6))
    s = evaluation.run_summary(res, ("f1",)).first()
    assert (s.n, s.n_correct, s.n_partial, s.n_incorrect, s.mean_f1, s.error_codes, s.gold_in_top) == (4, 1, 1, 2, 0.5, "e1,e2", 0.3333)
    told = df(spark, "t string", ("Partially Correct",), (" correct ",), ("partially-correct",), ("It is Correct!",), ("??",), (None,)).select(evaluation.verdict_of(F.col("t")).alias("v"))
    assert [r.v for r in told.collect()] == ["partially_correct", "correct", "partially_correct", "incorrect", "incorrect", "incorrect"]
    symbols = df(spark, "id int, kind string, qualname string, doc string", (1, "function", "m.f", "d" * 80), (2, "function", "m.b", ""), (3, "method", "m.a", ""), (4, "class", "m.C", "d" * 90))
    edges = df(spark, "a int, b int, kind string, omega double", (1, 2, "INVOKES", 0.9), (1, 3, "INVOKES", 0.9), (1, 4, "INVOKES", 0.4), (4, 2, "INVOKES", 0.9))
    assert [tuple(r) for r in evaluation.code_questions(symbols, edges).collect()] == [(1, "m.f", 3, ["m.a", "m.b"])]


def test_bitemporal(spark):
    explicit = "explicit_interval"
    o = df(
        spark, "id int, from_us bigint, to_us bigint, recorded_us bigint, recorded_to_us bigint, precision string, validity_kind string",
        (1, 0, 10, 0, None, "instant", explicit), (2, 0, None, 0, 5, "instant", explicit), (3, None, None, 0, None, "instant", "unknown"), (4, 0, 10, 0, None, "day", explicit), (5, 10, 20, 0, None, "instant", explicit),
        (6, 30, 40, 0, None, "day", explicit), (7, None, None, 0, None, None, "atemporal"), (8, 0, 10, 8, None, "instant", explicit), (9, 0, 10, 0, None, "instant", "observed_snapshot"), (10, 0, 10, None, None, "instant", None),
    )
    got = dict(rows(bitemporal.decide(o, Selector("as_of", 7, 9)), "id", "reason"))
    assert got == {
        1: "effective_match", 2: "recorded_closed", 3: "effective_unknown", 4: "effective_imprecise", 5: "effective_outside", 6: "effective_imprecise", 7: "atemporal_match", 8: "recorded_after_cutoff",
        9: "effective_unknown", 10: "recorded_after_cutoff",
    }
    during = dict(rows(bitemporal.decide(o, Selector("during", 7, 9, 12)), "id", "decision"))
    assert during[5] == "proven" and during[7] == "contextual"
    assert dict(rows(bitemporal.decide(o, Selector("throughout", 7, 2, 10)), "id", "decision"))[1] == "proven"
    assert dict(rows(bitemporal.decide(o, Selector("current", 7)), "id", "decision"))[5] == "excluded"
    timeless = dict(rows(bitemporal.decide(o, Selector("atemporal", 7)), "id", "decision"))
    assert (timeless[1], timeless[3], timeless[7], timeless[9]) == ("excluded", "contextual", "proven", "contextual")
    change = dict(rows(bitemporal.changes_between(o, "effective", 0, 10, 7), "id", "reason"))
    assert (change[1], change[5], change[4], change[3]) == ("change_match", "change_outside", "change_clock_unknown", "change_clock_unknown")
    published = o.withColumn("published_us", F.when(F.col("id") == 1, 5)).withColumn("recorded_is_publication", F.col("id") == 3)
    change = dict(rows(bitemporal.changes_between(published, "published", 0, 10, 7), "id", "decision"))
    assert (change[1], change[3], change[4]) == ("proven", "proven", "contextual")
    with pytest.raises(ValueError):
        bitemporal.decide(o, Selector("never", 1))
    assert bitemporal.resolve_selector(None, None, 9).mode == "current"
    c = df(spark, "k string, object string, from_us bigint, to_us bigint", ("a", "x", 0, 10), ("a", "y", 5, 20), ("b", "x", 0, 5), ("b", "y", 5, 9), ("c", "x", 0, 5), ("c", "x", 3, 9), ("c", "y", 20, None), ("c", "z", 25, 26), ("d", "x", None, None), ("d", "y", 0, 1), ("e", "x", 0, 100), ("e", "x", 1, 90), ("e", "y", 2, 3), ("e", "y", 95, 99))
    assert rows(bitemporal.conflict_sets(c, ["k"]), "k", "status") == [("a", "unresolved"), ("c", "possible"), ("d", "possible"), ("e", "possible")]
    contract = "adapter string, adapter_version string, kind string"
    m = ("wiki", "v1", "monotonic")
    v = df(spark, f"version_id int, ordinal bigint, s string, {contract}", (1, 1, "s", *m), (2, 2, "s", *m), (3, 2, "s", *m), (4, None, "s", "wiki", "v1", "unknown"), (5, 9, "s", "wiki", "v2", "monotonic"), (1, 1, "t", *m), (6, 7, "u", "wiki", "v1", "equality_only"), (2, 2, "s", *m))
    r = {(x.s, x.adapter_version): (x.ordinal, x.n_versions, x.is_ambiguous, x.n_superseded) for x in bitemporal.current_versions(v, ["s"]).collect()}
    assert r == {("s", "v1"): (2, 3, True, 1), ("s", "v2"): (9, 1, False, 0), ("t", "v1"): (1, 1, False, 0), ("u", "v1"): (None, 1, False, 0)}
    assert bitemporal.fully_superseded(*bitemporal.superseded_and_current(v, ["s"])).count() == 0  # the older one is current in another series
    assert rows(bitemporal.superseded_and_current(v, ["s"])[0], "version_id") == [(1,)]
    closed = bitemporal.closed_and_appended(df(spark, "id string, recorded_to_us bigint", ("a", None), ("b", 3)), df(spark, "id string", ("a",)), df(spark, "id string, recorded_to_us bigint", ("c", None)), 9)
    assert sorted(map(tuple, closed.collect()), key=str) == [("a", 9), ("b", 3), ("c", None)]
    with pytest.raises(Exception):
        bitemporal.closed_and_appended(df(spark, "id string, recorded_to_us bigint", ("a", None)), df(spark, "id string", ("a",)), df(spark, "id string, recorded_to_us bigint", ("a", None)), 9).collect()


def test_access(spark):
    s = df(spark, "id string, owner_id string, min_rank bigint, access_role_id string", ("a", "u", 99, "r"), ("b", None, None, "none"), ("c", "v", 20, None), ("d", "v", 10, None))
    assert rows(access.visible_sources(s, "u", 10), "id") == [("a",), ("b",), ("d",)] and access.visible_sources(s, None, 0, True).count() == 4
    assert dict(rows(access.set_source_ranks(s, df(spark, "id string, rank bigint", ("r", 5))), "id", "min_rank"))["a"] == 5
    sup = df(spark, "assertion_id int, group_no int, span_id string", (1, 0, "s1"), (1, 0, "s9"), (1, 1, "s2"), (2, 0, "s1"), (2, 0, "s9"))
    assert rows(access.supported(sup, df(spark, "span_id string", ("s1",), ("s2",))), "assertion_id", "is_supported") == [(1, True), (2, False)]
    p = df(spark, "policy_id int, mode string, allow array<string>, deny array<string>", (1, "list", ["x", "gone"], []), (2, "list", ["gone"], []), (3, "list", ["x"], ["gone"]), (4, "workspace", [], []))
    got = {r.policy_id: (r["mode"], r.allow, r.n_dropped) for r in access.mapped_principals(p, df(spark, "provider string, principal string", ("x", "me"))).collect()}
    assert got == {1: ("list", ["me"], 1), 2: ("unknown", [], 1), 3: ("unknown", ["me"], 0), 4: ("workspace", [], 0)}
    q = df(spark, "id int, mode string, allow array<string>, deny array<string>, verified_us bigint, expires_us bigint", (1, "list", ["me"], [], 0, 100), (2, "list", ["me"], ["me"], 0, 100), (3, "workspace", [], [], 0, 100), (4, "provider", ["me"], [], 0, 100), (5, "odd", ["me"], [], 0, 100), (6, "list", ["me"], [], 60, 100), (7, "list", ["me"], [], 0, None), (8, "list", ["me"], [], 0, 50))
    assert [r.id for r in q.where(access.policy_allows("me", F.lit(50), 40)).collect()] == [1, 3]
    closure = access.evidence_closure(
        df(spark, "artifact_id string, policy_id string", ("a", "ok"), ("b", "no"), ("s", "ok")), df(spark, "revision_id string, artifact_id string", ("ra", "a"), ("rb", "b"), ("rs", "s")),
        df(spark, "span_id string, revision_id string, policy_id string", ("x", "ra", "ok"), ("y", "ra", "no"), ("z", "rs", "ok")), df(spark, "observation_id string, span_id string, object_id string", ("o1", "x", "p"), ("o2", "x", "q"), ("o3", "y", "r")),
        df(spark, "assertion_id string, subject_id string, object_id string", ("t", "p", "q"), ("u", "p", "r")), df(spark, "assertion_id string, group_no int, span_id string", ("t", 0, "x"), ("u", 0, "x")),
        df(spark, "policy_id string, valid_until bigint", ("ok", 9)), df(spark, "id string", ("s",)))
    assert rows(closure["assertions"], "assertion_id") == [("t",)] and rows(closure["spans"], "span_id", "until") == [("x", 9)] and rows(closure["objects"], "object_id") == [("p",), ("q",)]


def test_intake(spark):
    known, seen = df(spark, "k string", ("a",), ("b",)), df(spark, "k string", ("a",))
    assert rows(sync.inferred_deletes(known, seen, ["k"], True, True), "k") == [("b",)]
    assert sync.inferred_deletes(known, seen, ["k"], False, True).count() == sync.inferred_deletes(known, seen, ["k"], True, False).count() == 0
    assert rows(sync.publication_problems(known.withColumnRenamed("k", "id"), df(spark, "id string", ("a",)), df(spark, "id string", ("b",), ("c",)), 1, 2), "reason") == [("epoch_moved",), ("suppressed",), ("tombstoned",)]
    assert [sync.publish_outcome(*x) for x in (("h", "h", 1, set()), ("h", "g", 1, {"g"}), ("h", "g", 0, set()), (None, "g", 2, set()))] == ["already_current", "already_published", "no_changes", "published"]
    due = sync.policy_refresh_due(df(spark, "id int, verified_us bigint, expires_us bigint", (1, 0, 100), (2, 40, 100)), 50)
    assert dict(rows(due, "id", "due")) == {1: True, 2: False}
    assert rows(sync.stale_views(df(spark, "id int, authorization_epoch int", (1, 1), (2, 2)), 2), "id") == [(1,)]


def test_synonyms_are_exact(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(60, 8)).astype(np.float32)
    keys = df(spark, "id string, name string, embedding array<float>", *[(f"k{i:02d}", "phrase" if i else "ab", x.tolist()) for i, x in enumerate(v)])
    got = rows(knowledge.synonym_pairs(keys, 0.5, 3, block_rows=16), "a", "b")
    u = v[1:] / np.linalg.norm(v[1:], axis=1, keepdims=True)
    s = u @ u.T
    want = set()
    for i in range(59):
        for j in sorted((j for j in range(59) if j != i and s[i, j] >= 0.5), key=lambda j: (-s[i, j], j))[:3]:
            want.add((f"k{min(i, j) + 1:02d}", f"k{max(i, j) + 1:02d}"))
    assert got == sorted(want)
    assert knowledge.synonym_pairs(keys.limit(0)).count() == 0
