"""Records that differ only in white space, letter case, punctuation or field order, by progressive partition refinement.

Classes are first formed by invariants that formatting cannot change and that are cheap: the number of letters and
digits of each field and how often some letters occur. Only members of classes with several members go on to the costly key,
the sequence of words of each field. A class of one is done after the first step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators import knowledge
from marlstone.operators.knowledge import FACT_FIELDS
from marlstone.plans.skew import HOT_ROWS, salted_lookup

#: Letters counted for the histogram: frequent ones tell most classes apart. Any set gives a right result.
HISTOGRAM = "eaionrst0123456789"
_NOT_WORD = r"[^\p{L}\p{N}]+"


def fold(text: Column) -> Column:
    """Lower case with ß written as ss and one form of sigma, so that letter case never counts."""
    return F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def words_key(text: Column) -> Column:
    """The words of a text in order, divided by one space; '' for a text without words."""
    return F.btrim(F.regexp_replace(fold(text), _NOT_WORD, " "))


def stripped(text: Column) -> Column:
    return F.regexp_replace(fold(text), _NOT_WORD, "")


def _histogram(text: Column) -> Column:
    counts = [F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in HISTOGRAM]
    return F.xxhash64(*counts)


def formatting_copies(df: DataFrame, id_col: str, fields: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Membership in groups of copies: ``kept`` (the group's smallest id), ``member`` and ``n_copies``, for groups of two or more.

    Every member row has a row, the kept one too; a repeated row is a member as often as it stands there. Rows without id,
    and rows in which a field is null or has no words, belong to no group. An empty input gives an empty result. Very
    frequent records are spread over tasks; counting combines before it shuffles. Other columns are ignored.
    """
    fields = list(fields)
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), *[F.col(f).alias(f"_f{i}") for i, f in enumerate(fields)])
    names = [f"_f{i}" for i in range(len(fields))]
    bare = rows.select("*", *[stripped(F.col(n)).alias(f"_b{n}") for n in names])
    bare = bare.where(" and ".join(f"_b{n} <> ''" for n in names))
    invariant = F.xxhash64(*[F.length(f"_b{n}") for n in names], *[_histogram(F.col(f"_b{n}")) for n in names])
    classed = bare.select("_id", *names, invariant.alias("_class"))
    classes = classed.groupBy("_class").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    open_rows = salted_lookup(classed, classes, ["_class"], "_n", "_id", hot_rows)
    keyed = open_rows.select("_id", "_class", *[words_key(F.col(n)).alias(f"_k{n}") for n in names])
    keys = ["_class", *[f"_k{n}" for n in names]]
    groups = keyed.groupBy(*keys).agg(F.min("_id").alias("kept"), F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    members = salted_lookup(keyed, groups, keys, "_rows", "_id", hot_rows)
    return members.select("kept", F.col("_id").alias("member"), F.col("_rows").alias("n_copies"))


def fact_fields(facts: DataFrame) -> DataFrame:
    """fact_row with its three fields, taken from ``raw_triple`` where they stand there."""
    return knowledge.with_fields(facts).select("fact_row", *FACT_FIELDS)


def fact_copies(facts: DataFrame) -> DataFrame:
    return formatting_copies(fact_fields(facts), "fact_row", FACT_FIELDS)
