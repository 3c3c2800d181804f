"""Quality of retrieval and answers: matches, overlap, recall, rank and evidence metrics, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import normalize_answer

CUTS = (1, 2, 5, 10, 20)


def exact_match(answers: DataFrame) -> DataFrame:
    """Per question (qid) 1.0 if the answer equals one of the accepted ones (expected) after normalisation. Rows: qid, actual, expected."""
    same = F.when(normalize_answer("actual") == normalize_answer("expected"), 1.0).otherwise(0.0)
    return answers.groupBy("qid").agg(F.max(same).alias("em"))


def _tokens(text: Column) -> Column:
    return F.filter(F.split(normalize_answer(text), " "), lambda t: t != "")


def token_f1(answers: DataFrame) -> DataFrame:
    """Per question the best F1 of words as multisets over the accepted answers; 0 without common words."""
    rows = answers.select("qid", _tokens(F.col("actual")).alias("a"), _tokens(F.col("expected")).alias("e"))

    def times(words: Column, word: Column) -> Column:
        return F.size(F.filter(words, lambda x: x == word))

    common = F.aggregate(F.array_distinct(F.col("a")), F.lit(0), lambda s, w: s + F.least(times(F.col("a"), w), times(F.col("e"), w)))
    f1 = F.when(common == 0, 0.0).otherwise(2.0 * common / (F.size("a") + F.size("e")))
    return rows.groupBy("qid").agg(F.max(f1).alias("f1"))


def recall_at(ranked: DataFrame, gold: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """Per question the part of its gold items among the first k, for each k, and the best rank of a gold item. No gold, no row.

    ``ranked``: qid, item, rank; ``gold``: qid, item. An item counts at its best rank.
    """
    best = ranked.groupBy("qid", "item").agg(F.min("rank").alias("rank"))
    met = gold.select("qid", "item").distinct().join(best, ["qid", "item"], "left")
    return met.groupBy("qid").agg(*[(F.count_if(F.col("rank") <= k) / F.count(F.lit(1))).alias(f"recall_{k}") for k in cuts], F.min("rank").alias("gold_rank"))


def evidence_metrics(ranked: DataFrame, groups: DataFrame, cuts: tuple[int, ...] = (5, 10, 20), depth: int = 10) -> DataFrame:
    """Per question (qid): mrr, ndcg (at ``depth``), and for each cut k any_hit_k, evidence_recall_k and all_required_k.

    ``groups``: qid, alternative, item. Any item of any alternative is relevant for rank and nDCG; recall is that of the alternative found best,
    and an alternative found whole is success. An item counts at its best rank; questions without groups have no row.
    """
    best = ranked.groupBy("qid", "item").agg(F.min("rank").alias("rank"))
    met = groups.select("qid", "alternative", "item").distinct().join(best, ["qid", "item"], "left")
    there = {k: F.coalesce(F.col("rank") <= k, F.lit(False)) for k in {*cuts, depth}}
    sets = met.groupBy("qid", "alternative").agg(*[(F.count_if(there[k]) / F.count(F.lit(1))).alias(f"_{k}") for k in cuts])
    per_set = sets.groupBy("qid").agg(*[a for k in cuts for a in (F.max(f"_{k}").alias(f"evidence_recall_{k}"), F.max(F.when(F.col(f"_{k}") == 1, 1.0).otherwise(0.0)).alias(f"all_required_{k}"))])
    item = met.groupBy("qid", "item").agg(F.min("rank").alias("rank")).groupBy("qid").agg(
        F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("mrr"), F.coalesce(F.sum(F.when(there[depth], 1 / F.log2(F.col("rank") + 1.0))), F.lit(0.0)).alias("_dcg"), F.count(F.lit(1)).alias("_n"),
        *[F.max(F.when(there[k], 1.0).otherwise(0.0)).alias(f"any_hit_{k}") for k in cuts],
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("_n"), F.lit(depth)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    names = [f"{name}_{k}" for k in cuts for name in ("any_hit", "evidence_recall", "all_required")]
    return item.join(per_set, "qid").select("qid", "mrr", (F.col("_dcg") / ideal).alias("ndcg"), *names)


def run_summary(results: DataFrame, metrics: tuple[str, ...], top: int = 5) -> DataFrame:
    """Of one run: rows, counts by verdict, the part of questions with gold (has_gold, gold_rank) that have it among the first ``top``,
    means without missing values to 4 digits, sorted distinct error codes."""
    return results.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "correct").alias("n_correct"), F.count_if(F.col("verdict") == "partially_correct").alias("n_partial"), F.count_if(F.col("verdict") == "incorrect").alias("n_incorrect"),
        F.round(F.avg(F.when(F.col("has_gold"), F.when(F.col("gold_rank") <= top, 1.0).otherwise(0.0))), 4).alias("gold_in_top"),
        *[F.round(F.avg(m), 4).alias(f"mean_{m}") for m in metrics], F.array_join(F.array_sort(F.collect_set("error_code")), ",").alias("error_codes"),
    )


def slice_means(results: DataFrame, by: str, metrics: tuple[str, ...]) -> DataFrame:
    """Per slice the mean of each metric over the rows that have it, and how many have."""
    return results.groupBy(by).agg(*[a for m in metrics for a in (F.round(F.avg(m), 4).alias(f"mean_{m}"), F.count(m).alias(f"n_{m}"))])


def compare_runs(base: DataFrame, other: DataFrame, by: str, metrics: tuple[str, ...]) -> DataFrame:
    """Slice means of two runs and their difference."""
    a, b = slice_means(base, by, metrics), slice_means(other, by, metrics)
    for m in metrics:
        a, b = a.withColumnRenamed(f"mean_{m}", f"base_{m}").drop(f"n_{m}"), b.withColumnRenamed(f"mean_{m}", f"other_{m}").drop(f"n_{m}")
    both = a.join(b, by, "full")
    return both.select(by, *[c for m in metrics for c in (f"base_{m}", f"other_{m}", F.round(F.col(f"other_{m}") - F.col(f"base_{m}"), 4).alias(f"change_{m}"))])


def verdict_of(label: Column) -> Column:
    """Verdict of a judge's label, however it is spaced, hyphenated and capitalised; an unknown or missing one is incorrect."""
    spelled = F.replace(F.replace(F.lower(F.btrim(label)), F.lit(" "), F.lit("_")), F.lit("-"), F.lit("_"))
    return F.when(spelled.isin("correct", "partially_correct"), spelled).otherwise("incorrect")


def verdict_score(verdict: Column) -> Column:
    return F.when(verdict == "correct", 1.0).when(verdict == "partially_correct", 0.5).otherwise(0.0)


def code_questions(symbols: DataFrame, edges: DataFrame, least_doc: int = 80, least_omega: float = 0.5) -> DataFrame:
    """Questions "what does it call" from documented functions and methods (id, kind, qualname, doc): id, qualname, callee, callees.

    ``edges``: a, b, kind, omega. ``callee`` is the strongest call of at least ``least_omega``, of equal ones the first by display name;
    ``callees`` lists all of them in order of names.
    """
    told = symbols.where((F.length("doc") >= least_doc) & F.col("kind").isin("function", "method"))
    named = edges.where((F.col("kind") == "INVOKES") & (F.col("omega") >= least_omega)).select(F.col("a").alias("id"), F.col("b").alias("_b"), "omega").join(
        symbols.select(F.col("id").alias("_b"), F.col("qualname").alias("_name")), "_b"
    )
    calls = named.groupBy("id").agg(F.min(F.struct((-F.col("omega")).alias("o"), "_name", "_b")).alias("_best"), F.array_sort(F.collect_set("_name")).alias("callees"))
    return told.join(calls, "id").select("id", "qualname", F.col("_best._b").alias("callee"), "callees")


def seeded_share(results: DataFrame) -> DataFrame:
    """Part of the questions with a code seed and mean fidelity of the paths shown."""
    return results.agg(F.avg(F.when(F.col("code_seeded"), 1.0).otherwise(0.0)).alias("code_seeded"), F.avg("path_fidelity").alias("path_fidelity"))
