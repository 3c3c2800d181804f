"""Subject areas of documents by a calibrated classifier chain over term, source and structure features.

A term model tells for each sentence which area it deals with, if any, and how strongly its terms speak for each area. A chain of
logistic models, one per area, then reads the document: how much of it the area takes, what its terms say for the area, its
structure, its source where the examples have sources, and the areas decided before, so that areas that go together are learnt. Scores are calibrated on held-out examples
and the best combination of labels is found by beam search.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.sentences import Words, read_words, term_hashes
from marlstone.llm.words import NO_HASH, kgram_hashes, word_hashes


@dataclass(frozen=True)
class SubjectSpec:
    #: Labelled texts that the models are fitted on at most, by least hash of id.
    max_examples: int = 5000
    #: Part of a document's sentences from which an area counts.
    least_share: float = 0.25
    composed: int = 4000
    folds: int = 4
    steps: int = 220
    decay: float = 2e-5
    beam: int = 4
    #: A word in so large a part of the example sentences is a function word.
    function_share: float = 0.008
    #: A word of three areas or more, none of which holds more than this part of its uses, tells nothing of the area.
    common_share: float = 0.5
    #: A sentence whose likeliest area is less probable than this counts for none.
    least_probability: float = 0.3
    #: Length in words of runs by which a sentence counts as quoted from the texts to ignore.
    quoted_words: int = 8
    #: Characters of documents whose arrays are held at once.
    piece_chars: int = 1 << 19
    #: Characters of texts to ignore up to which their runs of words are sent to the tasks.
    sent_chars: int = 16_000_000
    seed: int = 11


@dataclass
class TermModel:
    function_words: np.ndarray
    terms: np.ndarray  # sorted hashes
    weights: np.ndarray  # term x (areas + 1), already times idf
    idf: np.ndarray
    bias: np.ndarray
    strange: float  # weight of a word that no example has

    def probabilities(self, words: Words) -> np.ndarray:
        """Per segment, the probability of each area and, last, of none; a segment like no example deals with none."""
        return self.evidence(words)[0]

    def evidence(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The probabilities and, per segment and area, the weight of its terms for the area against none."""
        n = len(words.real)
        hashes, owner, single = term_hashes(words, self.function_words)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        known = self.terms[at] == hashes
        # words never seen speak for no area, so they weaken what the others say
        strange = np.bincount(owner[single & ~known], minlength=n).astype(np.float32) * self.strange**2
        foreign = np.bincount(owner[~single & known], minlength=n) == 0  # not two words together as in any example
        at, owner = at[known], owner[known]
        scores, norm = np.zeros((n, self.weights.shape[1]), np.float32), np.zeros(n, np.float32)
        if len(at):
            first = np.concatenate(([0], np.flatnonzero(owner[1:] != owner[:-1]) + 1))
            scores[owner[first]] = np.add.reduceat(self.weights[at], first, axis=0)
            norm[owner[first]] = np.add.reduceat(self.idf[at] ** 2, first)
        scores = scores / np.maximum(np.sqrt(norm + strange), 1e-6)[:, None] + self.bias
        told = scores[:, :-1] - scores[:, -1:]
        scores -= scores.max(1, keepdims=True)
        p = np.exp(scores)
        p /= p.sum(1, keepdims=True)
        p[foreign], told[foreign] = np.eye(1, p.shape[1], p.shape[1] - 1), told.min(initial=0.0)
        return p, told


def _adam(gradient, shapes: Sequence[tuple[int, ...]], steps: int, rate: float) -> list[np.ndarray]:
    values = [np.zeros(s, np.float32) for s in shapes]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for t in range(1, steps + 1):
        for v, m, s, g in zip(values, first, second, gradient(*values)):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            v -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return values


def _fit_terms(words: Words, targets: np.ndarray, function_words: np.ndarray, spec: SubjectSpec) -> TermModel:
    """Softmax regression over idf-weighted terms; ``targets`` per segment, all-zero rows are left out."""
    hashes, owner, _ = term_hashes(words, function_words)
    used = targets.sum(1) > 0
    hashes, owner = hashes[used[owner]], owner[used[owner]]
    terms, at = np.unique(hashes, return_inverse=True)
    rows = np.flatnonzero(used)
    row = (np.cumsum(used) - 1)[owner]  # non-decreasing, as terms come sorted by sentence
    many = max(len(terms), 1)
    pairs = np.unique(row * many + at)
    idf = np.log(1 + len(rows) / np.maximum(np.bincount(pairs % many, minlength=many), 1)).astype(np.float32)
    # a term seen twice in a sentence adds twice to the score and twice to the squared norm, here as when reading documents
    value = idf[at] / np.sqrt(np.maximum(np.bincount(row, weights=idf[at] ** 2, minlength=len(rows)), 1e-12))[row].astype(np.float32)
    value = value.astype(np.float32)[:, None]
    by_term = np.argsort(at, kind="stable")
    row_first = np.flatnonzero(np.diff(row, prepend=-1))
    term_first = np.flatnonzero(np.diff(at[by_term], prepend=-1))
    y = targets[rows]

    def gradient(w, b):
        z = np.tile(b, (len(rows), 1))
        if len(at):
            z[row[row_first]] += np.add.reduceat(w[at] * value, row_first, axis=0)
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        g = (p / p.sum(1, keepdims=True) - y) / max(len(rows), 1)
        slope = spec.decay * w
        if len(at):
            slope[at[by_term][term_first]] += np.add.reduceat((g[row] * value)[by_term], term_first, axis=0)
        return slope, g.sum(0)

    w, b = _adam(gradient, [(many, y.shape[1]), (y.shape[1],)], spec.steps, 0.05)
    return TermModel(function_words, terms if len(terms) else np.array([NO_HASH]), w * idf[:, None], idf, b, float(np.log(1 + len(rows))) if len(rows) else 1.0)


#: Forms of lines; a document's structure is the part of its lines that have each form.
_FORMS = {
    "object": re.compile(r"^[ \t]*[\[\]{}\"]", re.M), "markup": re.compile(r"^[ \t]*</?\w", re.M), "heading": re.compile(r"^#+ ", re.M),
    "code": re.compile(r"^(?:import|from|def|class|return|if|for|\"\"\"|@)\b|^(?: {4}|\t)\S", re.M), "table": re.compile(r"^[ \t]*(?:--|CREATE|SELECT|INSERT|ALTER|\|)", re.M), "item": re.compile(r"^[ \t]*[-*+] ", re.M),
}
STRUCTURES = tuple(_FORMS)
_SOURCE_BUCKETS = 8


def _structure(text: str) -> list[float]:
    lines = text.count("\n") + 1
    return [sum(1 for _ in form.finditer(text)) / lines for form in _FORMS.values()]


def _source_features(source: str | None) -> np.ndarray:
    out = np.zeros(_SOURCE_BUCKETS, np.float32)
    if source:
        out[sum(ord(c) * (i + 1) for i, c in enumerate(source)) % _SOURCE_BUCKETS] = 1.0
    return out


def mixed(p: np.ndarray, owner: np.ndarray, n: int, rounds: int = 6, calm: float = 0.5) -> np.ndarray:
    """Sentence probabilities in the light of their document: the weights of its areas are estimated by expectation and
    maximisation, so that doubtful sentences follow the clear ones. ``calm`` is what every area has beforehand, in sentences."""
    count = np.maximum(np.bincount(owner, minlength=n), 1)[:, None].astype(np.float32)
    q = p
    for _ in range(rounds):
        weight = np.stack([np.bincount(owner, weights=q[:, j], minlength=n) for j in range(p.shape[1])], 1).astype(np.float32)
        weight = (weight + calm) / (count + calm * p.shape[1])
        q = p * weight[owner]
        q /= q.sum(1, keepdims=True)
    return q


def _document_features(p: np.ndarray, told: np.ndarray, owner: np.ndarray, n: int, areas: int, spec: SubjectSpec) -> tuple[np.ndarray, np.ndarray]:
    """Per document: for each area its share of sentences, its mean probability, what its terms say for it; and general ones (size, none, spread)."""
    p = mixed(p, owner, n)
    count = np.bincount(owner, minlength=n).astype(np.float32)
    of = np.maximum(count, 1)[:, None]
    hard = np.zeros((n, areas + 1), np.float32)
    np.add.at(hard, (owner, np.where(p.max(1) < spec.least_probability, areas, p.argmax(1))), 1.0)
    soft = np.stack([np.bincount(owner, weights=p[:, j], minlength=n) for j in range(areas + 1)], 1).astype(np.float32)
    hard, soft = hard / of, soft / of
    terms = np.stack([np.bincount(owner, weights=np.maximum(told[:, j], 0), minlength=n) for j in range(areas)], 1).astype(np.float32) / of
    general = np.stack([np.log1p(count), (count == 0).astype(np.float32), hard[:, areas], soft[:, areas], 1 / (1 + count)], 1)
    return np.stack([hard[:, :areas], soft[:, :areas], terms], 2), general


@dataclass
class Chain:
    """Logistic link per area over its own shares and terms, the greatest other share, general features and the areas before it."""

    weights: list[np.ndarray] = field(default_factory=list)
    scale: list[tuple[float, float]] = field(default_factory=list)

    #: Places where a link may bend over its own shares; which of them count is learnt.
    KNOTS = np.linspace(0.04, 0.96, 24, dtype=np.float32)

    @classmethod
    def inputs(cls, j: int, shares: np.ndarray, general: np.ndarray, before: np.ndarray) -> np.ndarray:
        other = np.delete(shares[:, :, 0], j, 1).max(1, keepdims=True) if shares.shape[1] > 1 else np.zeros((len(shares), 1))
        own = shares[:, j, :]
        bent = [np.clip((own[:, part, None] - cls.KNOTS) * 25, 0, 2) for part in (0, 1)]
        return np.concatenate([own, *bent, other, general, before, np.ones((len(shares), 1))], 1).astype(np.float32)

    def fit(self, shares: np.ndarray, general: np.ndarray, labels: np.ndarray, held_out: np.ndarray) -> Chain:
        for j in range(labels.shape[1]):
            x, y = self.inputs(j, shares, general, labels[:, :j]), labels[:, j]

            def gradient(w, x=x[~held_out], y=y[~held_out]):
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                return (x.T @ (p - y) / len(x) + 1e-4 * w,)

            (w,) = _adam(gradient, [(x.shape[1],)], 400, 0.05)
            z = x[held_out] @ w

            def calibrate(ab, z=z, y=y[held_out]):
                p = 1 / (1 + np.exp(-np.clip((1 + ab[0]) * z + ab[1], -30, 30)))
                return (np.array([((p - y) * z).mean(), (p - y).mean()]) + 1e-3 * ab,)

            (ab,) = _adam(calibrate, [(2,)], 200, 0.02)
            self.weights.append(w)
            self.scale.append((1 + float(ab[0]), float(ab[1])))
        return self

    def decode(self, shares: np.ndarray, general: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The likeliest combination of labels of each document, among those the beam kept, and its probability."""
        n, areas = shares.shape[:2]
        paths, score = np.zeros((n, 1, 0), np.float32), np.zeros((n, 1))
        for j in range(areas):
            width = paths.shape[1]
            x = self.inputs(j, np.repeat(shares, width, 0), np.repeat(general, width, 0), paths.reshape(n * width, j))
            a, b = self.scale[j]
            z = np.clip(a * (x @ self.weights[j]) + b, -30, 30).reshape(n, width)
            yes, no = -np.log1p(np.exp(-z)), -np.log1p(np.exp(z))
            both = np.concatenate([score + yes, score + no], 1)
            keep = np.argsort(-both, axis=1, kind="stable")[:, :beam]
            score = np.take_along_axis(both, keep, 1)
            paths = np.concatenate([np.take_along_axis(paths, (keep % width)[:, :, None], 1), (keep < width)[:, :, None].astype(np.float32)], 2)
        return paths[:, 0, :], np.exp(score[:, 0])


@dataclass
class SubjectModel:
    areas: list[str]
    terms: TermModel
    chain: Chain
    spec: SubjectSpec
    with_source: bool
    ignored: np.ndarray  # sorted hashes of runs of quoted_words words

    def _general(self, general: np.ndarray, texts: Sequence[str], sources: Sequence[str | None]) -> np.ndarray:
        parts = [general, np.array([_structure(t) for t in texts], np.float32).reshape(len(texts), len(STRUCTURES))]
        if self.with_source:
            parts.append(np.stack([_source_features(s) for s in sources]) if len(texts) else np.zeros((0, _SOURCE_BUCKETS), np.float32))
        return np.concatenate(parts, 1)

    def label(self, texts: Sequence[str], sources: Sequence[str | None], ignored: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """``ignored``: sorted hashes to use instead of the model's own."""
        words = read_words(texts)
        real = words.real.copy()
        ignored = self.ignored if ignored is None else ignored
        if len(ignored) and len(words.hashes):
            grams = kgram_hashes(words.hashes, words.owner, self.spec.quoted_words)
            at = np.minimum(np.searchsorted(ignored, grams), len(ignored) - 1)
            hits = np.flatnonzero((ignored[at] == grams) & (grams != NO_HASH))
            quoted = np.zeros(len(words.hashes) + self.spec.quoted_words, bool)
            for s in range(self.spec.quoted_words):
                quoted[hits + s] = True
            part = np.bincount(words.sentence, weights=quoted[: len(words.hashes)], minlength=len(real))
            real &= part * 2 < np.bincount(words.sentence, minlength=len(real))
        p, told = self.terms.evidence(words)
        shares, general = _document_features(p[real], told[real], words.sentence_owner[real], len(texts), len(self.areas), self.spec)
        return self.chain.decode(shares, self._general(general, texts, sources), self.spec.beam)


def _function_words(words: Words, spec: SubjectSpec) -> np.ndarray:
    pairs = np.unique(np.stack([words.sentence.astype(np.uint64), words.hashes], 1), axis=0)
    h, n = np.unique(pairs[:, 1], return_counts=True)
    return h[n >= max(2, spec.function_share * len(words.real))]


def _common_words_only(words: Words, function: np.ndarray, labels: Sequence[Sequence[int]], areas: int, spec: SubjectSpec) -> np.ndarray:
    """Sentences all of whose words turn up in several areas alike: they deal with none."""
    terms, owner, single = term_hashes(words, function)
    terms, owner = terms[single], owner[single]
    area = np.array([own[0] if len(own) == 1 else -1 for own in labels], np.int64)[words.sentence_owner[owner]] if len(owner) else np.empty(0, np.int64)
    vocabulary, at = np.unique(terms, return_inverse=True)
    counts = np.zeros((len(vocabulary), areas))
    np.add.at(counts, (at[area >= 0], area[area >= 0]), 1.0)
    total = counts.sum(1)
    common = ((counts > 0).sum(1) >= 3) & (counts.max(1, initial=0) <= spec.common_share * total)
    telling = np.bincount(owner, weights=~common[at], minlength=len(words.real)) if len(owner) else np.zeros(len(words.real))
    return words.real & (telling == 0)


def train(examples: Sequence[tuple[str, Sequence[str], str | None]], areas: Sequence[str], spec: SubjectSpec = SubjectSpec(), ignored: Sequence[str] = ()) -> SubjectModel:
    """Fits both models on labelled texts (text, areas, source or None)."""
    areas = sorted(set(areas))
    index = {a: i for i, a in enumerate(areas)}
    texts = [t for t, _, _ in examples]
    labels = [sorted({index[a] for a in (own or ()) if a in index}) for _, own, _ in examples]
    words = read_words(texts)
    function = _function_words(words, spec)
    n = len(words.real)
    nothing = _common_words_only(words, function, labels, len(areas), spec)
    targets = np.zeros((n, len(areas) + 1), np.float32)
    for s in np.flatnonzero(words.real):
        own = labels[words.sentence_owner[s]]
        if nothing[s]:
            targets[s, len(areas)] = 1.0
        elif len(own) == 1:
            targets[s, own[0]] = 1.0
    model = _fit_terms(words, targets, function, spec)
    # sentences of two-area texts go to the likelier of the two
    p = model.probabilities(words)
    for s in np.flatnonzero(words.real & (targets.sum(1) == 0)):
        if own := labels[words.sentence_owner[s]]:
            targets[s, own[int(np.argmax(p[s, own]))]] = 1.0
    model = _fit_terms(words, targets, function, spec)
    # what the model says of sentences of texts it has not seen
    rng = np.random.default_rng(spec.seed)
    fold = rng.integers(0, spec.folds, len(texts))[words.sentence_owner] if len(texts) else np.empty(0, int)
    unseen, told = np.zeros((n, len(areas) + 1), np.float32), np.zeros((n, len(areas)), np.float32)
    for f in range(spec.folds):
        mine = fold == f
        if mine.any():
            p, t = _fit_terms(words, np.where(mine[:, None], 0, targets), function, spec).evidence(words)
            unseen[mine], told[mine] = p[mine], t[mine]
    with_source = any(s for _, _, s in examples)
    chain = _fit_chain(unseen, told, targets, words, texts, [s for _, _, s in examples], areas, spec, with_source, rng)
    quoted = word_hashes(list(ignored))
    grams = np.unique(kgram_hashes(*quoted, spec.quoted_words))
    return SubjectModel(areas, model, chain, spec, with_source, grams[grams != NO_HASH])


def _label_sets(targets: np.ndarray, owner: np.ndarray, n: int, areas: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the examples show of areas that go together: how many areas a text has (none and one more than any has keep a small chance),
    how frequent each is, how often each pair meets."""
    has = np.zeros((n, areas), bool)
    row, area = np.nonzero(targets[:, :areas])
    has[owner[row], area] = True
    sizes = np.append(np.bincount(has.sum(1), minlength=2), 0) + max(n, 1) * 0.04
    return sizes / sizes.sum(), has.sum(0).astype(float), has.T.astype(float) @ has.astype(float)


def _fit_chain(p: np.ndarray, told: np.ndarray, targets: np.ndarray, words: Words, texts, sources, areas, spec: SubjectSpec, with_source: bool, rng) -> Chain:
    """Documents composed of example sentences in known parts are the chain's examples, beside the examples themselves.

    How many areas a composed document deals with and which go together is drawn as the examples have it (pairs never seen keep a small
    chance); its structure and source are those of the texts its sentences come from.
    """
    real = np.flatnonzero(words.real & (targets.sum(1) > 0))
    of_area = [real[targets[real, j] == 1] for j in range(len(areas) + 1)]
    filled = np.array([j for j in range(len(areas)) if len(of_area[j])], int)
    sizes, often, together = _label_sets(targets[real], words.sentence_owner[real], len(texts), len(areas))
    picks, owner, labels, texts_of = [], [], [], []
    for _ in range(spec.composed if len(filled) else 0):
        size = int(rng.integers(3, 36))
        main: list[int] = []
        for _ in range(min(int(rng.choice(len(sizes), p=sizes)), len(filled))):
            chance = (together[main].sum(0) if main else often)[filled] + 0.5
            chance[np.isin(filled, main)] = 0
            main.append(int(rng.choice(filled, p=chance / chance.sum())))
        none = rng.uniform(0, 0.35) if len(of_area[-1]) else 0.0
        stray = rng.uniform(0, 0.15)
        weight = np.zeros(len(areas) + 1)
        if main:
            weight[main] = rng.dirichlet(np.full(len(main), 3.0)) * (1 - none - stray)
            weight[filled] += stray / len(filled)
        weight[-1] = 1 - weight.sum()
        if not len(of_area[-1]):
            weight[-1] = 0
            if not weight.sum():
                continue
        drawn = rng.choice(len(areas) + 1, size, p=weight / weight.sum())
        picks.append(np.array([of_area[a][int(rng.integers(len(of_area[a])))] for a in drawn]))
        owner.append(np.full(size, len(labels)))
        labels.append(np.bincount(drawn, minlength=len(areas) + 1)[: len(areas)] / size >= spec.least_share)
        texts_of.append(words.sentence_owner[picks[-1]])
    for t in range(len(texts)):  # the examples as they are
        mine = real[words.sentence_owner[real] == t]
        picks.append(mine)
        owner.append(np.full(len(mine), len(labels)))
        share = targets[mine, : len(areas)].sum(0) / max(len(mine), 1)
        labels.append(share >= spec.least_share)
        texts_of.append(np.array([t]))
    n = len(labels)
    if not n:
        picks, owner = [np.empty(0, int)], [np.empty(0, int)]
    at = np.concatenate(picks).astype(int)
    shares, general = _document_features(p[at], told[at], np.concatenate(owner).astype(int), n, len(areas), spec)
    forms = np.array([_structure(t) for t in texts], np.float32).reshape(len(texts), len(STRUCTURES))
    own = np.stack([_source_features(s) for s in sources]) if len(texts) else np.zeros((0, _SOURCE_BUCKETS), np.float32)
    mean = lambda values: np.array([values[t].mean(0) for t in texts_of], np.float32).reshape(n, values.shape[1])
    general = np.concatenate([general, mean(forms), mean(own)] if with_source else [general, mean(forms)], 1)
    y = np.array(labels, np.float32).reshape(n, len(areas))
    held = rng.random(n) < 0.25
    if not n:
        shares, general, y, held = np.zeros((2, len(areas), 3)), np.zeros((2, general.shape[1])), np.zeros((2, len(areas))), np.array([True, False])
    return Chain().fit(shares, general, y, held)


def fit_subjects(labelled: DataFrame, areas: DataFrame, ignored: DataFrame | None = None, spec: SubjectSpec = SubjectSpec()) -> SubjectModel:
    """The model from ``labelled`` (text_id, item_text, areas and, if there is one, source), at most ``spec.max_examples`` rows of it.

    ``areas`` (area) names the labels; a label outside it is ignored, and one that no example has cannot be learnt. ``ignored`` (item_text) holds texts whose
    quotations in documents do not count; beyond ``spec.sent_chars`` characters they stay with Spark: pass them to ``subject_areas`` then.
    """
    source = F.col("source") if "source" in labelled.columns else F.lit(None).cast("string")
    rows = labelled.where("item_text is not null").select("text_id", "item_text", "areas", source.alias("source"))
    taken = rows.orderBy(F.xxhash64("text_id"), "text_id").limit(spec.max_examples).collect()
    used = sorted({a for r in taken for a in r["areas"] or [] if a is not None})  # bounded by the examples
    names = [r[0] for r in areas.where(F.col("area").isin(used)).select("area").distinct().collect()]
    quotes = sorted(r[0] for r in _quotable(ignored).collect()) if ignored is not None and not _is_large(ignored, spec) else []
    examples = sorted(((r["text_id"], r["item_text"], r["areas"] or [], r["source"]) for r in taken), key=lambda e: (e[0] is None, e[0], e[1]))
    return train([e[1:] for e in examples], names, spec, quotes)


def _quotable(ignored: DataFrame) -> DataFrame:
    return ignored.where("item_text is not null").select("item_text")


def _is_large(ignored: DataFrame, spec: SubjectSpec) -> bool:
    return _quotable(ignored).agg(F.coalesce(F.sum(F.length("item_text")), F.lit(0))).first()[0] > spec.sent_chars


def _runs_of(texts: DataFrame, spec: SubjectSpec) -> DataFrame:
    """The distinct runs of ``spec.quoted_words`` words of each text (id, text), as hashes: id, run."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, text in zip(pdf["id"], pdf["text"]):
                grams = np.unique(kgram_hashes(*word_hashes([text]), spec.quoted_words))
                grams = grams[grams != NO_HASH]
                if len(grams):
                    yield pd.DataFrame({"id": key, "run": grams.view(np.int64)})

    return texts.mapInPandas(run, "id bigint, run bigint")


def subject_areas(documents: DataFrame, model: SubjectModel, ignored: DataFrame | None = None) -> DataFrame:
    """doc_id, areas (sorted array, empty for none), confidence (calibrated probability of the combination) and n_chars, for each row.

    Null and empty texts have no areas. Rows without id are left out; a repeated row gives its row again. Whole texts are
    read; only a text longer than ``spec.piece_chars`` takes more memory than others. Other columns are ignored. ``ignored`` (item_text) as for
    ``fit_subjects``: a set too large to be sent along is met by a join of runs of words, with the same result.
    """
    source = F.col("source").cast("string") if "source" in documents.columns else F.lit(None).cast("string")
    rows = documents.where("doc_id is not null").select(F.col("doc_id").cast("bigint"), "text", source.alias("source"))
    joined = ignored is not None and _is_large(ignored, model.spec)
    if joined:
        quoted = _runs_of(_quotable(ignored).select(F.lit(0).cast("bigint").alias("id"), F.col("item_text").alias("text")), model.spec).select("run").distinct()
        texts = rows.where("text is not null").select(F.col("doc_id").alias("id"), "text")
        met = _runs_of(texts, model.spec).join(quoted, "run", "left_semi").groupBy(F.col("id").alias("doc_id")).agg(F.collect_set("run").alias("runs"))  # a document's own quotations
        rows = rows.join(met, "doc_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = pdf["text"].fillna("").str.len().to_numpy()
            piece = np.cumsum(sizes) // model.spec.piece_chars
            for at in np.split(np.arange(len(pdf)), np.flatnonzero(piece[1:] != piece[:-1]) + 1) if len(pdf) else []:
                texts = [t or "" for t in pdf["text"].iloc[at]]
                runs = None
                if joined:
                    held = [np.asarray(r, np.int64) for r in pdf["runs"].iloc[at] if r is not None]
                    runs = np.unique(np.concatenate(held).view(np.uint64)) if held else np.empty(0, np.uint64)
                y, p = model.label(texts, [s or None for s in pdf["source"].iloc[at]], runs)
                names = [[model.areas[j] for j in np.flatnonzero(row)] for row in y]
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[at].to_numpy(), "areas": names, "confidence": p, "n_chars": sizes[at]})

    return rows.mapInPandas(run, "doc_id bigint, areas array<string>, confidence double, n_chars bigint")


def composition(labelled_docs: DataFrame) -> DataFrame:
    """Make-up of the corpus: per area (null: none) the documents and characters it takes part in."""
    return labelled_docs.select(F.explode_outer("areas").alias("area"), "n_chars").groupBy("area").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"))
