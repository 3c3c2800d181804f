"""Evaluation texts that stand in training texts, whole or in part, by winnowing.

Both sides keep the least k-gram hash of every sliding window, training fingerprints meet evaluation fingerprints, and each
meeting is extended word by word. Any shared run of ``window + k - 1`` words is found for sure.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.words import kgram_hashes, winnow, word_hashes


@dataclass(frozen=True)
class Winnowing:
    """``k + window - 1`` is the length in words of the shared runs that count."""

    k: int = 8
    window: int = 5
    #: Evaluation characters up to which their fingerprints are sent to the tasks; a larger set is joined by shuffle.
    sent_chars: int = 16_000_000

    @property
    def span(self) -> int:
        return self.k + self.window - 1


class _Items:
    """Evaluation side: words of all items in a row, their fingerprints sorted."""

    def __init__(self, ids: np.ndarray, texts: list[str], how: Winnowing):
        self.how = how
        self.words, owners = word_hashes(texts)
        self.owner = owners
        self.ids = np.asarray(ids)
        self.grams = kgram_hashes(self.words, owners, how.k)
        at = winnow(self.grams, owners, how.k, how.window)
        order = np.argsort(self.grams[at], kind="stable")
        self.at = at[order]
        self.prints = self.grams[self.at]


def _grow(left: np.ndarray, right: np.ndarray, lo: np.ndarray, lr: np.ndarray, p: np.ndarray, q: np.ndarray, step: int) -> np.ndarray:
    """How many words from p and q on, going by step, are equal inside both texts."""
    length = np.zeros(len(p), np.int64)
    live = np.arange(len(p))
    a, b = p.copy(), q.copy()
    own_a, own_b = lo[p], lr[q]
    while len(live):
        a, b = a + step, b + step
        inside = (a >= 0) & (a < len(left)) & (b >= 0) & (b < len(right))
        ca, cb = np.where(inside, a, 0), np.where(inside, b, 0)
        same = inside & (left[ca] == right[cb]) & (lo[ca] == own_a) & (lr[cb] == own_b)
        length[live[same]] += 1
        live, a, b, own_a, own_b = live[same], a[same], b[same], own_a[same], own_b[same]
    return length


def _matches(texts: list[str], items: _Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text position, item position and length of the longest shared run, for pairs with a run of at least the span."""
    how = items.how
    words, owners = word_hashes(texts)
    grams = kgram_hashes(words, owners, how.k)
    at = winnow(grams, owners, how.k, how.window)
    prints = grams[at]
    first, last = np.searchsorted(items.prints, prints, "left"), np.searchsorted(items.prints, prints, "right")
    hit = first < last
    at, first, n = at[hit], first[hit], (last - first)[hit]
    p = np.repeat(at, n)
    q = items.at[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]
    back = _grow(words, items.words, owners, items.owner, p, q, -1)
    ahead = _grow(words, items.words, owners, items.owner, p, q, 1)
    length = back + ahead + 1
    long = length >= how.span
    return owners[p[long]], items.owner[q[long]], length[long]


def _best(docs: np.ndarray, items: np.ndarray, length: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"doc_id": docs, "item_id": items, "n_words": length}).groupby(["doc_id", "item_id"], as_index=False).max()


_OUT = "doc_id bigint, item_id bigint, n_words bigint"


def shared_passages(documents: DataFrame, eval_items: DataFrame, how: Winnowing = Winnowing()) -> DataFrame:
    """Documents and the items they contain: doc_id, item_id and n_words, the length of the longest shared run.

    ``documents`` has ``doc_id`` and ``text``, ``eval_items`` has ``item_id`` and ``item_text``; other columns are ignored. Null and empty
    texts contain nothing, rows without id are left out, a repeated row changes nothing. Whole texts of any length are
    read. The evaluation set is measured; up to ``how.sent_chars`` characters it goes to the tasks, beyond that both sides'
    fingerprints are joined by shuffle with the same result.
    """
    docs = documents.where("doc_id is not null and text is not null and text <> ''").select(F.col("doc_id").cast("bigint"), "text")
    items = eval_items.where("item_id is not null and item_text is not null").select(F.col("item_id").cast("bigint"), "item_text").distinct()
    size = items.agg(F.coalesce(F.sum(F.length("item_text")), F.lit(0))).first()[0]
    if size > how.sent_chars:
        return _joined(docs, items, how)
    held = items.orderBy("item_id").collect()
    ids, texts = np.array([r[0] for r in held], np.int64), [r[1] for r in held]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = _Items(ids, texts, how)
        for pdf in batches:
            d, i, n = _matches(pdf["text"].tolist(), ready)
            yield _best(pdf["doc_id"].to_numpy()[d], ready.ids[i] if len(i) else i, n)

    return docs.mapInPandas(run, _OUT).groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"))


def fingerprints(df: DataFrame, id_col: str, text_col: str, how: Winnowing = Winnowing()) -> DataFrame:
    """The distinct winnowed fingerprints of each text: id, print."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words, owners = word_hashes(pdf[text_col].tolist())
            grams = kgram_hashes(words, owners, how.k)
            at = winnow(grams, owners, how.k, how.window)
            yield pd.DataFrame({"id": pdf[id_col].to_numpy()[owners[at]], "print": grams[at].view(np.int64)}).drop_duplicates()

    return df.select(id_col, text_col).mapInPandas(run, "id bigint, print bigint")


def _joined(docs: DataFrame, items: DataFrame, how: Winnowing) -> DataFrame:
    left = fingerprints(docs, "doc_id", "text", how).withColumnRenamed("id", "doc_id")
    right = fingerprints(items, "item_id", "item_text", how).withColumnRenamed("id", "item_id")
    pairs = left.join(right, "print").select("doc_id", "item_id").distinct()
    both = pairs.join(docs, "doc_id").join(items, "item_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for item, rows in pdf.groupby(["item_id", "item_text"], sort=False):
                d, _, n = _matches(rows["text"].tolist(), _Items(np.array([item[0]]), [item[1]], how))
                found.append(_best(rows["doc_id"].to_numpy()[d], np.full(len(d), item[0]), n))
            if found:
                yield pd.concat(found)

    return both.mapInPandas(run, _OUT).groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"))


def leaked_items(found: DataFrame, eval_items: DataFrame) -> DataFrame:
    """Which items leaked: per leaked item its split, the number of documents with it and the longest run."""
    counted = found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("n_words").alias("longest_run"))
    return counted.join(eval_items.select("item_id", "split").distinct(), "item_id")
