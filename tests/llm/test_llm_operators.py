"""Training-data operators against brute force and on awkward rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import duplicates, hnsw, leakage, mixing, sentences, subjects, vectors
from marlstone.llm.words import kgram_hashes, winnow, word_hashes

D = "/root/testdata/sf0.001"


def words(t):
    return tuple(re.findall(r"[^\W_]+", t.lower().replace("ß", "ss")))


def test_duplicates_against_brute_force(spark):
    rng = random.Random(4)
    base = [("Große Halle", "is part of", "tier 4.2"), ("Vadogavo Board", "depends on", "zone B"), ("ab", "c", "d"), ("a b", "c", "d"), ("the weekly export", "x", "y"), ("export weekly the", "x", "y")]
    rows = []
    for i in range(300):
        s = [rng.choice([str.upper, str.lower, str.title, lambda v: f" -{v}! ", lambda v: v.replace(" ", " \n "), lambda v: f"«{v}»"])(f) for f in rng.choice(base)]
        if rng.random() < 0.1:
            s[rng.randrange(3)] = rng.choice([None, "", "--"])
        raw = None
        if None not in s and rng.random() < 0.3:
            order = rng.sample([0, 1, 2], 3)
            names = ["Subject", "PREDICATE", "object"]
            raw = rng.choice(["; ", "|"]).join(f"{names[j]} {rng.choice(':=')}{s[j]}" for j in order)
        rows.append((i, *([None] * 3 if raw else s), raw, "x", 0, s))
    df = spark.createDataFrame([r[:7] for r in rows], "fact_row bigint, subject string, predicate string, object string, raw_triple string, _class string, _n int")
    groups = defaultdict(list)
    for r in rows:
        key = tuple(words(f or "") for f in r[7])
        if all(key):
            groups[key].append(r[0])
    want = {(min(g), m, len(g)) for g in groups.values() if len(g) > 1 for m in g}
    got = [tuple(r) for r in duplicates.fact_copies(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    hot = duplicates.formatting_copies(duplicates.fact_fields(df), "fact_row", duplicates.FACT_FIELDS, hot_rows=5)
    assert {tuple(r) for r in hot.collect()} == want
    assert duplicates.fact_copies(df.limit(0)).count() == 0


def test_duplicates_json_and_long_text(spark):
    rows = [(1, None, None, None, '{"Object":"b","Subject":"A ","predicate":"p"}'), (2, "a", "P.", "b", None), (3, None, None, None, "{broken"), (4, "x" * 200_000, "p", "b", None), (5, "X" * 200_000, "p", "b", None), (6, None, None, None, "subject=a")]
    df = spark.createDataFrame(rows, "fact_row bigint, subject string, predicate string, object string, raw_triple string")
    assert sorted((r.kept, r.member) for r in duplicates.fact_copies(df).collect()) == [(1, 1), (1, 2), (4, 4), (4, 5)]


def shared(a, b, span):
    x, y = (re.findall(r"[^\W_]+", t.lower()) for t in (a or "", b or ""))
    runs = {tuple(y[i : i + span]) for i in range(len(y) - span + 1)}
    return any(tuple(x[i : i + span]) in runs for i in range(len(x) - span + 1))


@pytest.mark.parametrize("sent", [16_000_000, 0])
def test_leakage_against_brute_force(spark, sent):
    rng = random.Random(8)
    vocabulary = ["ab", "Émile", "straße", "x1", "日本", "z", "q", "w"]
    text = lambda n: rng.choice([" ", ", ", "\n> "]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randrange(5, 40)), "dev") for i in range(25)] + [(90, None, "dev"), (91, "", "dev"), (92, "one two", "dev")]
    docs = []
    for i in range(80):
        w = re.split(r"[ ,\n>]+", rng.choice(items[:25])[1])
        a = rng.randrange(len(w))
        docs.append((i, text(rng.randrange(0, 30)) + " " + " ".join(w[a : a + rng.randrange(8, 30)]).upper() + " " + text(5), "x"))
    docs += [(100, None, "x"), (101, "", "x"), (102, docs[0][1], "y"), (0, docs[0][1], "x")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    e = spark.createDataFrame(items, "item_id bigint, item_text string, split string")
    how = leakage.Winnowing(sent_chars=sent)
    found = leakage.shared_passages(d, e, how)
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert got == {(a[0], b[0]) for a in docs for b in items if shared(a[1], b[1], how.span)}
    assert leakage.shared_passages(d.limit(0), e, how).count() == leakage.shared_passages(d, e.limit(0), how).count() == 0
    assert leakage.leaked_items(found, e).count() == len({i for _, i in got})


def test_words_of_long_texts_are_cut_where_no_word_is():
    text = " ".join(f"w{i}é" for i in range(5000)) + " " + "a" * 3000
    whole, _ = word_hashes([text])
    parts, owner = word_hashes([None, "", text], piece_chars=997)
    assert np.array_equal(whole, parts) and set(owner) == {2}
    assert len(set(whole.tolist())) == len(whole)
    grams = kgram_hashes(whole, np.zeros(len(whole), int), 8)
    at = winnow(grams, np.zeros(len(whole), int), 8, 5)
    assert np.diff(at).max() <= 5


def test_graph_search_recall():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(1500, 64))
    v = np.concatenate([centres, centres + rng.normal(scale=0.2, size=centres.shape)]).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    q = v[:500] + rng.normal(scale=0.02, size=(500, 64)).astype(np.float32)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    ids, _ = hnsw.search(hnsw.build(v), q, 2, ef=24)
    truth = np.argsort(-(q @ v.T), axis=1)[:, :2]
    assert np.mean([len(set(a) & set(b)) / 2 for a, b in zip(ids.tolist(), truth.tolist())]) >= 0.95
    for n in (0, 1, 2, 5):
        g = hnsw.build(v[:n])
        found, _ = hnsw.search(g, q[:3], 5)
        assert sorted(x for x in found[0].tolist() if x >= 0) == list(range(n))


def brute_pairs(rows, k=5, least=0.9):
    ids = [i for i, e in rows if e is not None and len(e) == 64 and np.isfinite(np.array(e, float)).all() and any(e)]
    v = np.array([e for i, e in rows if i in set(ids)], np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    out = set()
    s = np.round(v @ v.T, 6)
    for a in range(len(ids)):
        order = sorted((b for b in range(len(ids)) if b != a and s[a, b] >= least), key=lambda b: (-s[a, b], ids[b]))[:k]
        out |= {(min(ids[a], ids[b]), max(ids[a], ids[b])) for b in order}
    return out


def test_vectors_on_hot_copies_and_awkward_rows(spark):
    rng = np.random.default_rng(2)
    one = rng.normal(size=64).tolist()
    rows = [(i, one) for i in range(60)]  # a third are exact copies
    rows += [(100 + i, rng.normal(size=64).tolist()) for i in range(90)]
    rows += [(300 + i, (np.array(rows[60 + i][1]) * 3 + rng.normal(scale=0.1, size=64)).tolist()) for i in range(30)]
    rows += [(900, None), (901, []), (902, [0.0] * 64), (903, [1.0] * 32), (904, [float("nan")] * 64)]
    df = spark.createDataFrame([("c", i, e, "x") for i, e in rows], "collection string, id bigint, embedding array<float>, vec string")
    spec = vectors.IndexSpec(shard_rows=40)
    got = {(min(r.id, r.other), max(r.id, r.other)) for r in vectors.similar_pairs(df, spec).collect()}
    assert got == brute_pairs([(i, None if e is None else np.array(e, np.float32).tolist()) for i, e in rows])
    split = vectors.IndexSpec(shard_rows=60, split_rows=16, ef=32)
    again = {(min(r.id, r.other), max(r.id, r.other)) for r in vectors.similar_pairs(df, split).collect()}
    assert len(again & got) >= 0.97 * len(got) and again <= got
    assert vectors.similar_pairs(df.limit(0)).count() == 0 and vectors.similar_pairs(df.where("id >= 900")).count() == 0


@pytest.mark.parametrize("name,key", [("facts", "fact_row"), ("passages", "passage_no")])
def test_vector_recall_on_the_tables(spark, name, key):
    d = "/root/testdata/sf0.01"
    df = spark.read.parquet(f"{d}/{name}.parquet").select(F.lit(name).alias("collection"), F.col(key).alias("id"), "embedding")
    got = {(min(r.id, r.other), max(r.id, r.other)) for r in vectors.similar_pairs(df, vectors.IndexSpec(shard_rows=128)).collect()}
    want = brute_pairs([(r.id, r.embedding) for r in df.collect()])
    assert len(got & want) >= 0.97 * len(want)


def test_search_recall_of_asked_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/passages.parquet").select(F.lit("p").alias("collection"), F.col("passage_no").alias("id"), "embedding")
    got = defaultdict(set)
    import dataclasses

    for r in vectors.similar_pairs(df, dataclasses.replace(vectors.search_spec(), shard_rows=100), F.col("id") % 5 == 0).collect():
        got[r.id].add(r.other)
    rows = [(r.id, np.array(r.embedding)) for r in df.collect() if r.embedding is not None and len(r.embedding) == 64 and any(r.embedding)]
    ids = np.array([i for i, _ in rows])
    v = np.stack([e / np.linalg.norm(e) for _, e in rows])
    hits = total = 0
    for a in np.flatnonzero(ids % 5 == 0):
        s = v @ v[a]
        s[a] = -2
        want = set(ids[np.argsort(-s)[:5]].tolist())
        hits, total = hits + len(want & got[int(ids[a])]), total + 5
    assert hits / total >= 0.9 and all(k % 5 == 0 for k in got)


def test_mixing_reaches_shares_and_respects_caps(spark):
    rng = random.Random(3)
    docs = [(i, "word " * rng.randrange(1, 200), rng.choice(["a"] * 6 + ["b", "c", None]), "z") for i in range(600)] + [(None, "x", "a", "z"), (700, None, "a", "z"), (701, "", "a", "z")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, block string")
    t = spark.createDataFrame([("a", 0.3, 3), ("b", 0.3, 4), ("c", 0.4, 1), ("none", 0.0, 2), ("b", None, None)], "source string, target_share double, max_repeats int")
    mix = mixing.mix_sources(d, t, block_tokens=64)
    report = {r.source: r for r in mix.report.collect()}
    uses = Counter((r.source, r.doc_id) for r in mix.uses.collect())
    assert all(n <= report[s].max_repeats for (s, _), n in uses.items())
    assert abs(report["a"].share_of_total - 0.3) < 0.02 and abs(report["b"].share_of_total - 0.3) < 0.03
    assert report["c"].is_capped and report["c"].tokens_used == report["c"].tokens_there and report["c"].most_uses == 1
    assert report["none"].n_uses == 0 and abs(sum(r.share_reached for r in report.values()) - 1) < 1e-9
    total = {r.doc_id: r.tokens for r in mixing.token_counts(d).collect()}
    assert sum(n * total[k[1]] for k, n in uses.items()) == sum(r.tokens_used for r in report.values())
    empty = mixing.mix_sources(d.limit(0), t)
    assert empty.uses.count() == 0 and empty.report.count() == 4
    assert mixing.mix_sources(d, t.limit(0)).report.count() == 0


def test_token_counts_are_those_of_the_tokenizer(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rows = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "source", "text")
    want = {r.doc_id: len(t.encode(r.text, add_special_tokens=False).ids) for r in rows.collect()}
    assert {r.doc_id: r.tokens for r in mixing.token_counts(rows).collect()} == want


def test_token_counts_of_very_long_texts(monkeypatch):
    e = mixing._encoding(mixing.TOKENIZER, mixing.PIECES)
    text = "Some words,  12 x\n\n \t y's  " * 50 + "naïve 日本"
    want = len(e.encode_ordinary(text))
    monkeypatch.setattr(mixing, "_LONG_RUN", 2)
    assert mixing.count_tokens(e, mixing.PIECES, text) == want
    monkeypatch.undo()
    assert mixing.count_tokens(e, mixing.PIECES, "a" + " " * 1_000_000 + "b") > 10
    assert mixing.count_tokens(e, mixing.PIECES, "a" * 1_000_000) > 10 and mixing.count_tokens(e, mixing.PIECES, None) == 0


@pytest.fixture(scope="module")
def labelled(spark):
    return [(r.item_text, list(r.areas), None) for r in spark.read.parquet(f"{D}/labelled_texts.parquet").orderBy("text_id").collect()]


def test_subjects_held_out(labelled):
    areas = sorted({a for _, own, _ in labelled for a in own})
    order = np.random.default_rng(0).permutation(len(labelled))
    test, rest = order[:100], order[100:]
    model = subjects.train([labelled[i] for i in rest], areas)
    y, _ = model.label([labelled[i][0] for i in test], [None] * len(test))
    got = [{areas[j] for j in np.flatnonzero(row)} for row in y]
    want = [set(labelled[i][1]) for i in test]
    hits = sum(len(g & w) for g, w in zip(got, want))
    assert hits / sum(map(len, got)) >= 0.85 and hits / sum(map(len, want)) >= 0.85


def test_subjects_on_awkward_rows(spark, labelled):
    areas = sorted({a for _, own, _ in labelled for a in own})
    model = subjects.train(labelled, areas, subjects.SubjectSpec(composed=800, steps=120), ignored=[labelled[1][0]])
    texts = [labelled[0][0], None, "", "x", "Content will follow. This page is a placeholder.", labelled[0][0] + " " * 600_000 + labelled[0][0], labelled[0][0]]
    df = spark.createDataFrame([(i, t, None, "c") for i, t in enumerate(texts)] + [(None, "x", None, "c")], "doc_id bigint, text string, source string, areas string")
    got = {r.doc_id: r.areas for r in subjects.subject_areas(df, model).collect()}
    assert got[0] == got[5] == got[6] == labelled[0][1] and all(got[i] == [] for i in (1, 2, 3, 4)) and None not in got
    assert subjects.subject_areas(df.limit(0), model).count() == 0
    quoted, _ = model.label([labelled[1][0]], [None])
    assert not quoted.any()
    assert subjects.composition(subjects.subject_areas(df, model)).where("area is null").first().n_docs == 4
    # a set of quoted texts too large to be sent along gives the same
    ignored = spark.createDataFrame([(labelled[0][0],), (labelled[1][0],), (None,)], "item_text string")
    sent = subjects.train(labelled, areas, subjects.SubjectSpec(composed=800, steps=120), ignored=[labelled[0][0], labelled[1][0]])
    kept = subjects.train(labelled, areas, subjects.SubjectSpec(composed=800, steps=120, sent_chars=10))
    docs = spark.createDataFrame([(i, labelled[i][0], None) for i in range(6)], "doc_id bigint, text string, source string")
    show = lambda rows: sorted((r.doc_id, tuple(r.areas)) for r in rows.collect())
    assert show(subjects.subject_areas(docs, kept, ignored)) == show(subjects.subject_areas(docs, sent)) and show(subjects.subject_areas(docs, kept, ignored))[0] == (0, ())


def test_links_learn_from_structure_source_and_fields(labelled):
    areas = sorted({a for _, own, _ in labelled for a in own})
    told = [(t, a, "src-" + a[0]) for t, a, _ in labelled]
    model = subjects.train(told, areas, subjects.SubjectSpec(composed=800, steps=120))
    assert model.with_source and all(np.isfinite(w).all() for w in model.chain.weights)
    shape = dict(zip(subjects.STRUCTURES, subjects._structure("# T\n" + "{\n" * 3)))
    assert shape["heading"] == 0.2 and shape["object"] == 0.6 and shape["code"] == 0.0


def test_sentences_are_told_from_code_and_headings():
    text = '# Heading here\n\nThe first one ends here. {"key_a": "Second has four words."}\ndef f(x_y): return x_y\nno stop in this line'
    w = sentences.read_words([text, None, "Third one is it?"])
    assert w.real.sum() == 3
    assert list(w.sentence_owner[w.real]) == [0, 0, 2]
