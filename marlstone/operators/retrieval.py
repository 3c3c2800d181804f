"""Ranked retrieval over an evidence graph: dense scores, seeds, spreading, fall-back, selection and explanation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.vector import dot, scaled
from marlstone.operators.graph import personalized_pagerank, reset_vector
from marlstone.operators.relations import top
from marlstone.session import checkpointed


@dataclass(frozen=True)
class RetrievalSettings:
    """Knobs of a search, with the ranges they are kept in."""

    facts_to_filter: int = 5
    seed_entities: int = 5
    passage_weight: float = 0.05
    damping: float = 0.5
    #: Scores are ranked by 12 digits, and three quarters of what is left go with each round.
    rounds: int = 24
    passages: int = 200
    symbol_seeds: int = 20
    community_boost: float = 0.0

    RANGES = {"facts_to_filter": (1, 50), "seed_entities": (1, 50), "passage_weight": (0.0, 1.0), "damping": (0.05, 0.95), "rounds": (1, 100), "passages": (1, 1000), "symbol_seeds": (0, 100), "community_boost": (0.0, 5.0)}

    def __post_init__(self):
        for name, (low, high) in self.RANGES.items():
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, (int, float)) or not low <= value <= high:
                raise ValueError(f"{name} must be a number from {low} to {high}")
            if isinstance(low, int) and value != int(value):
                raise ValueError(f"{name} must be a whole number")


def dense_scores(rows: DataFrame, query: list[float], embedding: str = "embedding") -> DataFrame:
    """Adds ``dense``, the inner product with the query vector scaled to 0..1; rows with another vector length drop out."""
    q = F.array(*[F.lit(float(v)) for v in query])
    return scaled(rows.where(F.size(embedding) == len(query)).withColumn("_dot", dot(F.col(embedding), q)), "_dot", "dense").drop("_dot")


def candidate_facts(facts: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k facts (fact_id, ...) most like the query, ties by id."""
    return top(dense_scores(facts, query), [F.desc("dense"), "fact_id"], k)


def forced(kept: DataFrame, facts: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """Kept facts with some added and some taken out by id."""
    added = facts.where(F.col("fact_id").isin(include)).join(kept.select("fact_id"), "fact_id", "left_anti")
    return kept.unionByName(added.select(*kept.columns)).where(~F.col("fact_id").isin(exclude))


def seed_weights(kept: DataFrame, specificity: DataFrame, boosts: DataFrame) -> DataFrame:
    """Entity seeds of the kept facts (subject_id, object_id, dense): id, weight.

    Each occurrence counts its fact's score, divided by the passages of the entity where there are any; the mean over the
    occurrences is multiplied by the boost. A boost of 0 mutes, a missing one is 1.
    """
    ends = kept.select(F.explode(F.array("subject_id", "object_id")).alias("id"), "dense")
    joined = ends.join(specificity, "id", "left").withColumn("s", F.col("dense") / F.greatest(F.coalesce("passage_count", F.lit(1)), F.lit(1)))
    mean = joined.groupBy("id").agg(F.avg("s").alias("mean"))
    return mean.join(boosts, "id", "left").select("id", (F.col("mean") * F.coalesce("boost", F.lit(1.0))).alias("weight"))


def cut_seeds(seeds: DataFrame, k: int) -> DataFrame:
    """The k best seeds keep their weight, ties by id; the others stay with 0."""
    best = seeds.orderBy(F.desc("weight"), "id").limit(k).select("id", F.lit(True).alias("_in"))
    return seeds.join(best, "id", "left").select("id", F.when(F.col("_in"), F.col("weight")).otherwise(0.0).alias("weight"))


def decide_fallback(n_entity_seeds: int, n_code_seeds: int, reset_sum: float) -> str:
    """``dense`` where nothing was kept or the reset vector is all zero, else ``graph``."""
    return "graph" if (n_entity_seeds or n_code_seeds) and reset_sum > 0 else "dense"


def search(passages: DataFrame, facts: DataFrame, edges: DataFrame, specificity: DataFrame, boosts: DataFrame, query: list[float], settings: RetrievalSettings = RetrievalSettings()) -> DataFrame:
    """Passages by graph rank: passage_id, rank, score, dense, dense_rank.

    ``passages`` has passage_id and embedding; ``facts`` has fact_id, subject_id, object_id and embedding; ``edges`` are directed over entity and
    passage ids. The recognition of facts by a model is left out: the k most similar are kept.
    """
    dense = checkpointed(dense_scores(passages, query).select("passage_id", "dense"))
    kept = candidate_facts(facts, query, settings.facts_to_filter)
    seeds = checkpointed(cut_seeds(seed_weights(kept, specificity, boosts), settings.seed_entities))
    parts = seeds.select("id", F.col("weight").alias("value")).unionByName(dense.select(F.col("passage_id").alias("id"), (F.col("dense") * settings.passage_weight).alias("value")))
    reset = reset_vector(parts)
    if seeds.where("weight > 0").isEmpty() or reset.isEmpty():
        scored = dense.withColumn("score", F.col("dense"))
    else:
        walk = personalized_pagerank(edges, reset, settings.damping, settings.rounds)
        scored = dense.join(walk.withColumnRenamed("id", "passage_id"), "passage_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    best = top(scored, [F.desc(F.round("score", 12)), "passage_id"], settings.passages)
    by_dense = top(dense, [F.desc("dense"), "passage_id"], settings.passages, out="dense_rank").select("passage_id", "dense_rank")
    return best.join(by_dense, "passage_id", "left").select("passage_id", "rank", "score", "dense", "dense_rank")


def direct_seed_links(edges: DataFrame, seeds: DataFrame, passages: DataFrame) -> DataFrame:
    """Seeds next to each of the passages (id): passage_id, seed, weight."""
    near = edges.join(seeds.select(F.col("id").alias("src")), "src", "left_semi").join(passages.select(F.col("id").alias("dst")), "dst", "left_semi")
    return near.select(F.col("dst").alias("passage_id"), F.col("src").alias("seed"), "weight")


def citations(passages: DataFrame, originals: DataFrame) -> DataFrame:
    """Originals behind each passage, many to many: passage_id, originals (sorted), n."""
    met = passages.select("passage_id").distinct().join(originals, "passage_id", "left")
    return met.groupBy("passage_id").agg(F.array_sort(F.collect_set("original_id")).alias("originals"), F.count_distinct("original_id").alias("n"))


def view_fingerprint(df: DataFrame, cols: list[str]) -> DataFrame:
    """Digest of a table's rows whatever their order."""
    h = F.sha2(F.to_json(F.struct(*cols)), 256)
    return df.agg(F.sha2(F.concat_ws(",", F.sum(F.conv(F.substring(h, 1, 12), 16, 10).cast("decimal(38,0)")).cast("string"), F.count(F.lit(1)).cast("string")), 256).alias("fingerprint"))


FENCE = r"(?s)```[^\n]*\n.*?```"
#: Shapes of one stack frame by runtime: pattern, group of the path, of the line, of the function (0: none); fixed formats.
FRAMES = (
    ("python", r'File "([^"]+)", line (\d+), in (\S+)', 1, 2, 3),
    ("javascript", r"at (\S+) \(([^():]+):(\d+):\d+\)", 2, 3, 1),
    ("dotnet", r"at ([\w.<>`]+)\([^)]*\) in ([^:]+(?::\\[^:]+)?):line (\d+)", 2, 3, 1),
    ("go", r"(?m)^\s+(\S+\.go):(\d+)", 1, 2, 0),
    ("rust", r"at (\S+\.rs):(\d+)", 1, 2, 0),
)


def prose_and_code(question: Column) -> tuple[Column, Column]:
    """The question without its fenced blocks, and what the blocks hold."""
    code = F.array_join(F.regexp_extract_all(question, F.lit(r"(?s)```[^\n]*\n(.*?)```"), F.lit(1)), "\n")
    return F.trim(F.regexp_replace(question, FENCE, " ")), code


def looks_like_code(word: Column) -> Column:
    """Pascal or camel case humps, snake case or all capitals of some length."""
    return word.rlike(r"^[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+$") | word.rlike(r"^[a-z]+[a-z0-9]*[A-Z]\w*$") | word.rlike(r"^\w*[A-Za-z0-9]_[A-Za-z0-9]\w*$") | word.rlike(r"^[A-Z][A-Z0-9]{2,}$")


def line_is_code(line: Column) -> Column:
    """A line that ends or begins as code does."""
    return line.rlike(r"[;{}]\s*$") | line.rlike(r"^\s*(def|class|func|fn|import|from|return|if|for|while|public|private|const|let|var)\b.*[:({;=]") | line.rlike(r"^\s*[\w.]+\(.*\)\s*$") | line.rlike(r"^\s*@\w+")


def frames(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Stack frames of the first runtime whose shape matches: id, runtime, k (0 is innermost), path, line, function, weight 0.8 ** k."""
    found = []
    earlier = F.lit(False)
    for runtime, pattern, path, line, name in FRAMES:
        def parts(group: int, pattern=pattern) -> Column:
            return F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(group))

        here = F.col(text_col).rlike(pattern)
        rows = texts.where(~earlier & here).select(
            id_col, F.posexplode(F.arrays_zip(parts(path).alias("path"), parts(line).alias("line"), (parts(name) if name else parts(path)).alias("function"))).alias("at", "f"), F.size(parts(path)).alias("n")
        )
        k = F.col("n") - 1 - F.col("at") if runtime == "python" else F.col("at")
        found.append(rows.select(id_col, F.lit(runtime).alias("runtime"), k.alias("k"), "f.path", F.col("f.line").cast("int").alias("line"), (F.col("f.function") if name else F.lit(None).cast("string")).alias("function")))
        earlier = earlier | F.coalesce(here, F.lit(False))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.withColumn("weight", F.pow(F.lit(0.8), F.col("k")))


def exception_name(text: Column) -> Column:
    """Name of the exception: of a .NET header if there is one, else of the last line that begins with an error's name."""
    dotnet = F.regexp_extract(text, r"Unhandled exception\.\s+([\w.]+Exception)", 1)
    last = F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all(text, F.lit(r"(?m)^\s*([\w.]*(?:Error|Exception))\b"), F.lit(1))), -1)
    return F.nullif(F.when(dotnet != "", dotnet).otherwise(last), F.lit(""))


def diff_hunks(text: Column) -> Column:
    """New-side ranges of a unified diff: array of (first, last) lines."""
    found = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(r"(?m)^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"), F.lit(1)).alias("a"),
        F.regexp_extract_all(text, F.lit(r"(?m)^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"), F.lit(2)).alias("n"),
    )
    count = lambda h: F.when(h["n"] == "", F.lit(1)).otherwise(F.when(h["n"] != "", h["n"]).cast("int"))
    return F.transform(found, lambda h: F.struct(h["a"].cast("int").alias("first"), (h["a"].cast("int") + F.greatest(count(h), F.lit(1)) - 1).alias("last")))


def overlapping_symbols(hunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols (no modules) that overlap a hunk (path, first, last), without those that contain another match."""
    met = hunks.join(symbols.where("kind <> 'module'"), "path").where("line_start <= last and first <= line_end").select("path", "id", "line_start", "line_end").distinct()
    inner = met.select("path", F.col("id").alias("_i"), F.col("line_start").alias("_a"), F.col("line_end").alias("_b"))
    contains = (met["path"] == inner["path"]) & (F.col("id") != F.col("_i")) & (F.col("line_start") <= F.col("_a")) & (F.col("_b") <= F.col("line_end"))
    return met.join(inner, contains, "left_anti")


def explain_paths(edges: DataFrame, shown: DataFrame) -> DataFrame:
    """All edges among the shown vertices (id): the explanation's subgraph."""
    v = shown.select("id").distinct()
    return edges.join(v.withColumnRenamed("id", "a"), "a", "left_semi").join(v.withColumnRenamed("id", "b"), "b", "left_semi")


def apply_changeset(settings: dict, ops: list[dict]) -> tuple[dict, dict[str, list[tuple]]]:
    """Settings and override rows after a list of operations of the four kinds; later ones win."""
    out, rows = dict(settings), {"tuned": [], "synonyms": [], "boosts": []}
    for i, op in enumerate(ops):
        kind = op.get("op")
        if kind == "set_setting":
            out[op["key"]] = op["value"]
        elif kind == "set_edge_weight":
            rows["tuned"].append((min(op["a"], op["b"]), max(op["a"], op["b"]), float(op["weight"]), i))
        elif kind == "add_synonym":
            rows["synonyms"].append((min(op["a"], op["b"]), max(op["a"], op["b"]), float(op.get("score", 1.0)), True))
        elif kind == "set_node_boost":
            rows["boosts"].append((op["id"], float(op["boost"]), i))
        else:
            raise ValueError(f"unknown operation {kind!r}")
    return out, rows


def closest_triples(asked: DataFrame, known: DataFrame, cutoff: float = 0.6) -> DataFrame:
    """For each asked text (qid, text) the equal known fact (fact_id, text) of its question, or else the closest by matching blocks.

    ``known`` is the short candidate list of each question (qid), so the groups are small.
    """
    import difflib

    import pandas as pd

    exact = asked.join(known, ["qid", "text"]).select("qid", F.col("text").alias("asked"), "fact_id")
    open_ = asked.join(known.select("qid", "text"), ["qid", "text"], "left_anti").join(known.select("qid", F.struct("text", "fact_id").alias("k")).groupBy("qid").agg(F.collect_list("k").alias("ks")), "qid")

    def run(batches):
        for pdf in batches:
            rows = []
            for qid, text, ks in zip(pdf["qid"], pdf["text"], pdf["ks"]):
                by_text = {k["text"]: k["fact_id"] for k in sorted(ks, key=lambda k: (k["text"], k["fact_id"]), reverse=True)}
                for m in difflib.get_close_matches(text, sorted(by_text), n=1, cutoff=cutoff):
                    rows.append((qid, text, by_text[m]))
            if rows:
                yield pd.DataFrame(rows, columns=["qid", "asked", "fact_id"])

    kind = asked.schema["qid"].dataType.simpleString()
    return exact.unionByName(open_.mapInPandas(run, f"qid {kind}, asked string, fact_id string"))
