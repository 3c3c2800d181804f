"""Operators do the whole job: rows, rounds, shards and hours that used to be left out."""

import random

import numpy as np

from marlstone.operators import asof, graph, knowledge, relations, retrieval
from marlstone.plans import admin_queries, evidence_queries, graph_queries, text_queries

FACTS = "fact_row bigint, subject string, predicate string, object string, raw_triple string, passage_id string, source_id string"


def facts(spark):
    return spark.createDataFrame([
        (1, "Ada Desk", "depends on", "Bo Gate", None, "p1", "s"),
        (2, None, None, None, '{"Object":"Cy Hall","SUBJECT":"Ada  desk","predicate":"is part of"}', "p2", "s"),
        (3, None, None, None, "Object = Bo Gate | subject: Dee Team|PREDICATE=reads from", "p3", "t"),
        (4, None, None, None, "subject: alone", "p4", "t"), (5, "Eve", "owns", None, None, "p5", "t"), (6, None, None, None, None, "p6", "t"),
    ], FACTS)


def test_triples_read_raw_fields(spark):
    got = {(r.passage_id, r.subject, r.predicate, r.object) for r in knowledge.triples(facts(spark)).collect()}
    assert got == {("p1", "ada desk", "depends on", "bo gate"), ("p2", "ada desk", "is part of", "cy hall"), ("p3", "dee team", "reads from", "bo gate")}


def test_direct_queries_read_raw_fields(spark, tmp_path):
    facts(spark).write.parquet(f"{tmp_path}/facts.parquet")
    d = str(tmp_path)
    assert {(r.phrase, r.n) for r in text_queries.clean_phrase_distinct(spark, d).collect()} == {("ada desk", 2), ("dee team", 1), ("alone", 1), ("eve", 1)}
    assert {r.passage_id for r in text_queries.merged_bundles(spark, d).collect()} == {"p1", "p2", "p3", "p4", "p5"}
    assert {r.qid for r in evidence_queries.token_f1(spark, d).collect()} == {1, 2, 3}
    assert sum(r.n for r in evidence_queries.exact_matches(spark, d).collect()) == 3
    assert {(r.a, r.kind, r.b) for r in admin_queries.best_edges(spark, d).collect()} == {("Ada Desk", "depends on", "Bo Gate"), ("Ada  desk", "is part of", "Cy Hall"), ("Dee Team", "reads from", "Bo Gate")}
    assert {r.statement for r in admin_queries.rendered_edges(spark, d).collect()} == {"Ada Desk depends on Bo Gate.", "Ada  desk is part of Cy Hall.", "Dee Team reads from Bo Gate."}
    assert graph_queries.fact_edges(spark, d).count() == 3


def test_walk_goes_on_until_scores_stand(spark, monkeypatch):
    n = 60
    line = [(f"v{i:02}", f"v{i + 1:02}", 1.0) for i in range(n)]
    walk = graph.mirrored(spark.createDataFrame(line, "a string, b string, weight double"))
    monkeypatch.setattr(graph_queries, "_walk", lambda *_: walk)
    monkeypatch.setattr(graph_queries, "_seeds", lambda s, d: s.createDataFrame([("v00",)], "id string"))
    got = {r.id: r.score for r in graph_queries.ppr_rank(spark, "").collect()}
    move = np.zeros((n + 1, n + 1))
    for i in range(n):
        move[i, i + 1] = move[i + 1, i] = 1.0
    move /= move.sum(1)[:, None]
    want = np.linalg.solve(np.eye(n + 1) - 0.5 * move.T, 0.5 * np.eye(n + 1)[0])
    assert len(got) == n + 1 and all(abs(got[f"v{i:02}"] - want[i]) < 1.01e-9 for i in range(n + 1))


def test_search_rounds_reach_the_ranked_digits():
    settings = retrieval.RetrievalSettings()
    # what Chebyshev's rounds leave; the walk itself is measured against a linear solve in the graph tests
    left = settings.damping / (1 + (1 - settings.damping**2) ** 0.5)
    assert 2 * left**settings.rounds < 0.5e-12


def test_greedy_budget_takes_all_passages(spark, tmp_path):
    rows = [("a", i, "x" * n, e) for i, (n, e) in enumerate([(300, None), (150, "late"), (90, None), (20, None), (10, "late")])] + [(None, 9, "y" * 7, None)]
    spark.createDataFrame(rows, "source_id string, passage_no bigint, text string, extraction_error string").write.parquet(f"{tmp_path}/passages.parquet")
    got = {(r.source_id, r.passage_no, r.size) for r in graph_queries.greedy_budget(spark, str(tmp_path)).collect()}
    assert got == {("a", 0, 300), ("a", 2, 90), ("a", 4, 10), (None, 9, 7)}


def test_greedy_fill_streams_a_large_group(spark):
    big = spark.range(50_000).selectExpr("id % 2 as g", "id as pos", "(id * 7) % 50 as size")
    plan = relations.greedy_fill(big, ["g"], ["pos"], "size", 400, 10)
    assert "collect_list" not in plan._jdf.queryExecution().toString()
    want = []
    for g in range(2):
        used = n = 0
        for i in range(g, 50_000, 2):
            if n < 10 and used + (i * 7) % 50 <= 400:
                used, n = used + (i * 7) % 50, n + 1
                want.append((g, i))
    assert sorted((r.g, r.pos) for r in plan.collect()) == want


def test_text_budget_lists_every_source(spark, tmp_path):
    rows = [(1, "x" * 70_000, "a"), (2, "y", "a"), (3, "z" * 12_000_000, "b"), (4, "z" * 9_000_000, "b")]
    spark.createDataFrame([(*r, "p", "t") for r in rows], "doc_id bigint, text string, source string, path string, title string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {(r.source, r.n) for r in text_queries.text_budget(spark, str(tmp_path)).collect()} == {("a", 2), ("b", 0)}


def test_regions_hold_claims_shorter_than_an_hour(spark):
    rng, h = random.Random(3), asof.HOUR_US
    rows = []
    for i in range(40):
        lo = rng.randrange(-2 * h, 3 * h)
        rows.append((i, "s", lo, rng.choice([lo + rng.randrange(1, h // 2), lo + rng.randrange(h, 3 * h), None, lo]), rng.randrange(50), rng.choice([None, 1, 2])))
    rows += [(90, "s", 0, 1, 60, 9), (91, "s", 5 * h - 1, 5 * h, 61, 9)]
    claims = spark.createDataFrame(rows, "id bigint, k string, from_us bigint, to_us bigint, recorded_us bigint, ordinal bigint")
    regions = {k: asof.current_regions(claims, ["k"], k).collect() for k in (10, 70)}
    rank = {r[0]: (r[5] is not None, r[5] or 0, r[4], r[0]) for r in rows}
    points = [(v, k) for v in [0, 1, 5 * h - 1, 5 * h, *(r[2] for r in rows), *(rng.randrange(-2 * h, 6 * h) for _ in range(300))] for k in (10, 70)]
    for v, k in points:
        want = max((r[0] for r in rows if r[2] <= v and (r[3] is None or v < r[3]) and r[4] <= k), key=rank.get, default=None)
        met = [r.claim for r in regions[k] if r.from_us <= v and (r.to_us is None or v < r.to_us)]
        assert met == ([] if want is None else [want])  # one region around a point, or none
