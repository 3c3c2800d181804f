"""Mixing sources to target weights by a low-discrepancy schedule over equal-token blocks.

Slot i of the mix takes the point frac(i * golden ratio) through the cumulative target weights, so every stretch of the
schedule holds the sources in about their shares. Slots are ranked per source; rank r of a source takes block r mod
(number of blocks) of its shuffled documents, in pass r div (number of blocks), up to the source's number of passes.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import checkpointed

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split of text into pieces that the vocabulary at ``TOKENIZER`` was made with (fixed value).
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Tokens of a block: about the size of some documents, so that a source's last, partial pass stays near its target.
BLOCK_TOKENS = 1024
#: Runs of a source's shuffled documents (and of slots) that are summed on their own before offsets are added.
BUCKETS = 1024
SLOT_RUN = 1 << 16
#: Strips of the unit interval by which slots find their source.
STRIPS = 4096
_GOLDEN = 0.6180339887498949
#: White space in a row from which a text takes the slower way.
_LONG_RUN = 10_000
_held: dict[tuple[str, str], object] = {}


def _encoding(path: str, pattern: str):
    if (path, pattern) not in _held:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
        _held[path, pattern] = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _held[path, pattern]


def count_tokens(encoding, pattern: str, text: str | None) -> int:
    """Number of tokens of the whole text. The library's own splitter runs out of stack on very long runs of white space;
    such texts are split by another engine with the same pattern, with the same result."""
    if not text:
        return 0
    if len(text) < _LONG_RUN or not re.search(rf"\s{{{_LONG_RUN}}}", text):
        return len(encoding.encode_ordinary(text))
    import regex

    return sum(len(encoding._core_bpe.encode_single_piece(piece.encode("utf-8", "replace"))) for piece in regex.findall(pattern, text))


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PIECES) -> DataFrame:
    """doc_id, source and the number of tokens of the whole text; null and empty texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(tokenizer, pattern)
        for pdf in batches:
            tokens = [count_tokens(encoding, pattern, t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": tokens})

    return documents.where("doc_id is not null").select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), "text").mapInPandas(run, "doc_id bigint, source string, tokens bigint")


@dataclass(frozen=True)
class Mix:
    """``uses``: one row per use of a document, with its slot; ``report``: one row per source of the targets."""

    uses: DataFrame
    report: DataFrame


def _blocks(sized: DataFrame, block_tokens: int) -> DataFrame:
    """Documents with tokens in a shuffled line per source, cut into blocks by where a document begins."""
    key = F.xxhash64("doc_id", F.lit("mix"))
    line = sized.where("tokens > 0 and source is not null").select("doc_id", "source", "tokens", key.alias("_key"), F.pmod(key, F.lit(BUCKETS)).cast("int").alias("_bucket"))
    sums = line.groupBy("source", "_bucket").agg(F.sum("tokens").alias("_sum"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_offset") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    return line.join(offsets, ["source", "_bucket"]).withColumn("block", F.floor(start / block_tokens)).select("doc_id", "source", "tokens", "block")


def mix_sources(documents: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, total_tokens: int | None = None, tokenizer: str = TOKENIZER, pattern: str = PIECES) -> Mix:
    """Each source of ``targets`` (source, target_share, max_repeats) gets its share of ``total_tokens``.

    ``total_tokens`` is by default the number of tokens of all documents. No document is used more than ``max_repeats`` times; a source
    whose cap binds falls short, which the report shows; its share is not given to others. Shares are scaled to sum 1; null
    or negative shares and caps count as 0. Sources without target, documents without source, id or tokens are not used.
    Targets without documents get nothing. Repeated document rows are as many documents. If a source is listed twice in the
    targets, the greater share and cap hold. All-zero or empty targets give an empty mix.

    Columns of ``uses``: slot, source, pass, doc_id, tokens. Columns of ``report``: source, target_share, max_repeats, n_docs, tokens_there,
    n_uses, n_docs_used, most_uses, tokens_used, share_of_total, share_reached, is_capped.
    """
    spark = documents.sparkSession
    sized = checkpointed(token_counts(documents, tokenizer, pattern))  # texts are tokenised once
    wanted = targets.where("source is not null").groupBy("source").agg(
        F.greatest(F.max(F.coalesce("target_share", F.lit(0.0))), F.lit(0.0)).alias("share"),
        F.greatest(F.max(F.coalesce("max_repeats", F.lit(0))), F.lit(0)).cast("bigint").alias("max_repeats"),
    )
    everything = Window.partitionBy(F.lit(1))
    there = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("tokens").alias("tokens_there"))
    total = total_tokens if total_tokens is not None else sized.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    n_slots = -(-total // block_tokens)
    plan = wanted.join(there, "source", "left").na.fill(0, ["n_docs", "tokens_there"]).select(
        "*", F.when(F.sum("share").over(everything) > 0, F.col("share") / F.sum("share").over(everything)).otherwise(0.0).alias("target_share")
    )
    upto = Window.partitionBy(F.lit(1)).orderBy("source").rowsBetween(Window.unboundedPreceding, 0)
    # one row per source of the targets: their number, not the corpus, bounds these windows and the join below
    plan = plan.select("*", F.sum("target_share").over(upto).alias("_to"), F.ceil(F.col("tokens_there") / block_tokens).alias("_blocks"))
    plan = plan.select("*", (F.col("_to") - F.col("target_share")).alias("_from"), F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("_to"), F.desc("target_share"))).alias("_last"))
    slots = spark.range(int(n_slots)).select(F.col("id").alias("slot"), ((F.col("id") * F.lit(_GOLDEN)) - F.floor(F.col("id") * F.lit(_GOLDEN))).alias("_x"))
    by_share = plan.where("target_share > 0").select("source", "_from", F.when(F.col("_last") == 1, 2.0).otherwise(F.col("_to")).alias("_to"), "_blocks", "max_repeats")
    # points meet their source by an equal strip of the unit interval, then by its exact bounds
    strip = lambda x: F.least(F.floor(x * STRIPS), F.lit(STRIPS - 1))
    strips = by_share.withColumn("_strip", F.explode(F.sequence(strip(F.col("_from")), strip(F.least(F.col("_to"), F.lit(1.0))))))
    drawn = slots.withColumn("_strip", strip(F.col("_x"))).join(strips, "_strip").where((F.col("_x") >= F.col("_from")) & (F.col("_x") < F.col("_to"))).withColumn("_run", F.floor(F.col("slot") / SLOT_RUN))
    counted = drawn.groupBy("source", "_run").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("source").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("source", "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    rank = F.col("_offset") + F.row_number().over(Window.partitionBy("source", "_run").orderBy("slot")) - 1
    ranked = drawn.join(offsets, ["source", "_run"]).where("_blocks > 0").withColumn("_rank", rank)
    placed = ranked.select("slot", "source", F.floor(F.col("_rank") / F.col("_blocks")).alias("pass"), F.pmod("_rank", "_blocks").alias("block"), "max_repeats")
    placed = placed.where(F.col("pass") < F.col("max_repeats")).drop("max_repeats")
    uses = placed.join(_blocks(sized, block_tokens), ["source", "block"]).select("slot", "source", "pass", "doc_id", "tokens")
    per_doc = uses.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("_uses"), F.sum("tokens").alias("_used"))
    used = per_doc.groupBy("source").agg(
        F.sum("_uses").alias("n_uses"), F.count(F.lit(1)).alias("n_docs_used"), F.max("_uses").alias("most_uses"), F.sum("_used").alias("tokens_used")
    )
    report = plan.join(used, "source", "left").na.fill(0, ["n_uses", "n_docs_used", "most_uses", "tokens_used"])
    report = report.select(
        "source", "target_share", "max_repeats", "n_docs", "tokens_there", "n_uses", "n_docs_used", "most_uses", "tokens_used",
        F.when(F.lit(total) > 0, F.col("tokens_used") / F.lit(max(int(total), 1))).otherwise(0.0).alias("share_of_total"),
        F.when(F.sum("tokens_used").over(everything) > 0, F.col("tokens_used") / F.sum("tokens_used").over(everything)).otherwise(0.0).alias("share_reached"),
        (F.col("target_share") * F.lit(int(total)) > F.col("max_repeats") * F.col("tokens_there")).alias("is_capped"),
    )
    return Mix(uses, report)
