"""The evidence graph: triples, entities, mentions, edges and their weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import clean_phrase, fields_of_raw, is_meaningful_phrase, prefixed_id, split_identifier
from marlstone.functions.vector import dot, unit

SYNONYM_SCORE = 0.8
SYNONYM_TOP = 100
PHRASE_OMEGA, EXACT_OMEGA, REFERENCES = 0.60, 0.85, 20
FACT_FIELDS = ("subject", "predicate", "object")


def with_fields(facts: DataFrame) -> DataFrame:
    """Facts with subject, predicate and object taken from ``raw_triple`` where they stand there; all other columns stay."""
    if "raw_triple" not in facts.columns:
        return facts
    inside = fields_of_raw(F.col("raw_triple"), FACT_FIELDS)
    return facts.withColumns({n: F.coalesce(F.col(n), inside[n]) for n in FACT_FIELDS})


def triples(facts: DataFrame) -> DataFrame:
    """Cleaned triples with ids: passage_id, source_id, fact_id, subject, predicate, object, subject_id, object_id.

    Fields that stand in ``raw_triple`` count like the others. Triples that lose subject or object to cleaning, or lack a
    part, are dropped; a triple counts once per passage.
    """
    parts = with_fields(facts).select("passage_id", "source_id", *[clean_phrase(c).alias(c) for c in FACT_FIELDS])
    whole = parts.where("subject <> '' and object <> '' and predicate is not null").distinct()
    return whole.select(
        "*", prefixed_id("fact", F.concat_ws("\t", "subject", "predicate", "object")).alias("fact_id"),
        prefixed_id("entity", "subject").alias("subject_id"), prefixed_id("entity", "object").alias("object_id"),
    )


def entities(t: DataFrame) -> DataFrame:
    both = F.explode(F.array(F.struct(F.col("subject_id").alias("id"), F.col("subject").alias("name")), F.struct(F.col("object_id").alias("id"), F.col("object").alias("name"))))
    return t.select(both.alias("e")).select("e.*").distinct()


def mentions(t: DataFrame) -> DataFrame:
    """Which passage names which entity, once each."""
    return t.where("passage_id is not null").select("passage_id", F.explode(F.array("subject_id", "object_id")).alias("id")).distinct()


def node_specificity(m: DataFrame) -> DataFrame:
    """Passages per entity."""
    return m.groupBy("id").agg(F.count(F.lit(1)).alias("passage_count"))


def fact_edges(t: DataFrame) -> DataFrame:
    """Unordered entity pairs with the number of (passage, fact) statements that join them; no loops."""
    lo, hi = F.least("subject_id", "object_id"), F.greatest("subject_id", "object_id")
    return t.where("subject_id <> object_id and passage_id is not null").groupBy(lo.alias("a"), hi.alias("b")).agg(F.count(F.lit(1)).alias("fact_count"))


def orphans(nodes: DataFrame, linked: DataFrame, key: str = "id") -> DataFrame:
    """Nodes that nothing links to."""
    return nodes.join(linked.select(key), key, "left_anti")


def merged_edges(terms: DataFrame, tuned: DataFrame, scale: float = 1.0) -> DataFrame:
    """Edge weights: a, b, weight, kinds.

    ``terms`` has a, b, kind and value, where kind is fact, mention, synonym or code (``value`` is scaled for code). A pair weighs
    its greatest term; a tuned weight replaces it, and a tuned weight of 0 removes the edge, unlike a missing one. Pairs are unordered.
    """
    value = F.when(F.col("kind") == "code", F.col("value") * scale).when(F.col("kind") == "mention", F.lit(1.0)).otherwise(F.col("value"))
    lo, hi = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    merged = terms.where("a <> b").groupBy(lo, hi).agg(F.max(value.cast("double")).alias("computed"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    over = tuned.groupBy(lo, hi).agg(F.max("weight").cast("double").alias("tuned"))
    both = merged.join(over, ["a", "b"], "full")
    weight = F.coalesce("tuned", "computed")
    return both.select("a", "b", weight.alias("weight"), F.array_sort(F.concat(F.coalesce("kinds", F.array().cast("array<string>")), F.when(F.col("tuned").isNotNull(), F.array(F.lit("tuned"))).otherwise(F.array().cast("array<string>")))).alias("kinds")).where("weight > 0")


def best_code_edges(edges: DataFrame) -> DataFrame:
    """One edge per (a, b, kind): the best omega, on equal omega the first seen (pos), and all call lines; no loops."""
    best = edges.where("a <> b").groupBy("a", "b", "kind").agg(
        F.max(F.struct("omega", (-F.col("pos")).alias("first"), "provenance")).alias("_e"), F.array_sort(F.collect_set("line")).alias("lines")
    )
    return best.select("a", "b", "kind", "_e.omega", "_e.provenance", "lines")


def code_specificity(edges: DataFrame) -> DataFrame:
    """Callers, readers and writers of a symbol, plus one."""
    return edges.where(F.col("kind").isin("INVOKES", "READS", "WRITES")).groupBy(F.col("b").alias("id")).agg((F.count(F.lit(1)) + 1).alias("specificity"))


def synonym_pairs(keys: DataFrame, min_score: float = SYNONYM_SCORE, per_key: int = SYNONYM_TOP, block_rows: int = 4096) -> DataFrame:
    """Pairs of keys (id, name, embedding) whose cosine reaches ``min_score``, exactly; each key keeps its ``per_key`` best, ties by id.

    Keys fall into blocks of about ``block_rows``; a task takes the product of two blocks, each pair of blocks once. So a task holds two blocks
    however many keys there are, and work spreads over all pairs of blocks. Short phrases are no keys. Exact products grow
    with the square of the keys: for very large collections use an index over the vectors.
    """
    import numpy as np
    import pandas as pd

    usable = keys.where(is_meaningful_phrase("name") & F.col("embedding").isNotNull()).select("id", unit(F.col("embedding")).alias("v"))
    usable = usable.where(dot(F.col("v"), F.col("v")) > 0)
    blocks = max(1, -(-usable.count() // block_rows))
    placed = usable.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    tiled = placed.withColumn("other", other).select("id", "v", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
        rows, queries = (pdf[pdf["block"] == b].sort_values("id") for b in (lo, hi))
        out = [pd.DataFrame({"id": [], "other": [], "score": []}).astype({"id": object, "other": object, "score": float})]
        if len(rows) and len(queries):
            r, names = np.stack(rows["v"].to_numpy()), rows["id"].to_numpy()
            for at in range(0, len(queries), 1000):
                some = queries.iloc[at : at + 1000]
                q, ids = np.stack(some["v"].to_numpy()), some["id"].to_numpy()
                i, j = np.nonzero(q @ r.T >= min_score - 1e-12)
                score = (q[i] * r[j]).sum(1)
                out.append(pd.DataFrame({"id": ids[i], "other": names[j], "score": score}))
                if lo != hi:
                    out.append(pd.DataFrame({"id": names[j], "other": ids[i], "score": score}))
        found = pd.concat(out)
        return found[found["id"] != found["other"]]

    cells = max(1, blocks * (blocks + 1) // 2)
    found = tiled.repartition(cells, "lo", "hi").groupBy("lo", "hi").applyInPandas(product, "id string, other string, score double")
    best = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    top = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= per_key)
    return top.groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).agg(F.max("score").alias("score"))


def synonym_gate(kind: Column, name: Column) -> Column:
    """Symbols enter with at least two tokens; data objects and entities as they are."""
    return (kind != "symbol") | (F.size(split_identifier(name)) >= 2)


def extraction_gate(text: Column, least: int = 80) -> Column:
    """What of a text goes to extraction: nothing (null), an empty text or the text itself."""
    return F.when(text.isNull(), None).when(F.length(F.trim(text)) < least, "").otherwise(text)


def name_index(names: DataFrame) -> DataFrame:
    """Inverted index of identifiers (id, name): a row for each token and id that has it. Rows, not lists, as a token may be in any number of names."""
    return names.select(F.explode(F.array_distinct(split_identifier("name"))).alias("token"), "id").distinct()


def ngrams(passages: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """The distinct runs of cleaned words of each passage (passage_id, text), of each of the ``lengths``: passage_id, gram.

    A passage is one row, so its runs are made in place, in time linear in the text; nothing is shuffled."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            ids, grams = [], []
            for key, text in zip(pdf["passage_id"], pdf["words"]):
                w = text.split(" ")
                own = {" ".join(w[i : i + n]) for n in lengths for i in range(len(w) - n + 1)}
                ids += [key] * len(own)
                grams += sorted(own)
            if ids:
                yield pd.DataFrame({"passage_id": ids, "gram": grams})

    kind = passages.schema["passage_id"].dataType.simpleString()
    words = passages.select("passage_id", clean_phrase("text").alias("words")).where("words <> ''")
    return words.mapInPandas(run, f"passage_id {kind}, gram string")


def references(passages: DataFrame, names: DataFrame, per_passage: int = REFERENCES) -> DataFrame:
    """Names (id, name) that passages (passage_id, text) refer to: by their tokens in a row (two or more, however many), or by the exact spelling.

    The better of the two counts per name; the best ``per_passage`` of a passage stay, ties by id. Only the different numbers of tokens
    that names have come to the driver; runs of other lengths are not made.
    """
    keys = names.select("id", F.array_join(split_identifier("name"), " ").alias("gram"), F.size(split_identifier("name")).alias("n")).where("n >= 2")
    lengths = sorted(r[0] for r in keys.select("n").distinct().collect())
    by_gram = ngrams(passages, lengths).join(keys.drop("n"), "gram").select("passage_id", "id", F.lit(PHRASE_OMEGA).alias("omega"))
    words = passages.select("passage_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+(?:\.[\p{L}\p{N}_]+)*"), F.lit(0)))).alias("word"))
    by_name = words.join(names.select("id", F.col("name").alias("word")), "word").select("passage_id", "id", F.lit(EXACT_OMEGA).alias("omega"))
    best = by_gram.unionByName(by_name).groupBy("passage_id", "id").agg(F.max("omega").alias("omega"))
    order = Window.partitionBy("passage_id").orderBy(F.desc("omega"), "id")
    return best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_passage).drop("r")


def ambiguous_tokens(matches: DataFrame, weight: float = 1.0, most: int = 10, used: int = 8) -> DataFrame:
    """Token matches (token, id) with their share: more than ``most`` matches seed nothing, else weight / matches for the first ``used``."""
    w = Window.partitionBy("token")
    counted = matches.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("r", F.row_number().over(w.orderBy("id")))
    return counted.where((F.col("n") <= most) & (F.col("r") <= used)).select("token", "id", (F.lit(weight) / F.col("n")).alias("share"))


def innermost_symbol(lines: DataFrame, symbols: DataFrame, path: str = "path") -> DataFrame:
    """The innermost symbol (path, id, qualname, line_start, line_end) around each line (path, line)."""
    met = lines.join(symbols, path).where("line between line_start and line_end")
    return met.groupBy(path, "line").agg(F.min(F.struct((F.col("line_end") - F.col("line_start")).alias("span"), "qualname", "id")).alias("_s")).select(path, "line", "_s.id", "_s.qualname")


def own_lines(symbols: DataFrame) -> DataFrame:
    """Lines of each symbol that lie in no nested symbol."""
    every = symbols.select("path", F.explode(F.sequence("line_start", "line_end")).alias("line")).distinct()
    return innermost_symbol(every, symbols)


def path_suffix_matches(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    """Paths that are equal or of which one ends in the other, met by their file names."""
    from marlstone.functions.text import path_key

    x, y = a.select(F.col(left), path_key(left).alias("_k")), b.select(F.col(right), path_key(right).alias("_k"))
    same = F.endswith(F.concat(F.lit("/"), F.col(left)), F.concat(F.lit("/"), F.col(right))) | F.endswith(F.concat(F.lit("/"), F.col(right)), F.concat(F.lit("/"), F.col(left)))
    return x.join(y, "_k").where(same).select(left, right)


def shared_entity_pairs(m: DataFrame, low: int = 2, high: int = 5) -> DataFrame:
    """Passage pairs that share an entity of ``low`` to ``high`` passages: one row per pair, rarer entities first, then by id."""
    counted = m.join(node_specificity(m).where(f"passage_count between {low} and {high}"), "id")
    x, y = counted.alias("x"), counted.alias("y")
    pairs = x.join(y, (F.col("x.id") == F.col("y.id")) & (F.col("x.passage_id") < F.col("y.passage_id")))
    rare = F.when(F.col("x.passage_count") <= 3, 0).otherwise(1)
    best = pairs.groupBy(F.col("x.passage_id").alias("a"), F.col("y.passage_id").alias("b")).agg(F.min(F.struct(rare.alias("rare"), F.col("x.id").alias("id"))).alias("_e"))
    return best.select("a", "b", F.col("_e.id").alias("entity_id"))


def endpoint_violations(edges: DataFrame, allowed: DataFrame) -> DataFrame:
    """Edges (predicate, subject_kind, object_kind, ...) whose kinds the predicate does not allow."""
    return edges.join(allowed, ["predicate", "subject_kind", "object_kind"], "left_anti")
