"""Words, names, code and sentence bounds of whole batches of texts, in numpy arrays."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from marlstone.llm.words import _CHAR_BASE, _WORD_BASE, _is_word_char, _mixed, _runs

_tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []


def _case_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the first plane: lower case of each character, whether it is upper case, whether it is a digit."""
    if not _tables:
        chars = [chr(c) for c in range(1 << 16)]
        lower = np.fromiter((ord(x) if len(x := c.lower()) == 1 else ord(c) for c in chars), np.uint32, 1 << 16)
        upper = np.fromiter((unicodedata.category(c) in ("Lu", "Lt") for c in chars), bool, 1 << 16)
        digit = np.fromiter((unicodedata.category(c)[0] == "N" for c in chars), bool, 1 << 16)
        _tables.append((lower, upper, digit))
    return _tables[0]


def _flags(codes: np.ndarray, chars: str) -> np.ndarray:
    table = np.zeros(1 << 8, np.int32)
    table[[ord(c) for c in chars]] = 1
    return np.where(codes < 256, table[np.minimum(codes, 255)], 0)


@dataclass
class Words:
    """All words of a batch in order. ``sentence`` numbers the segments; ``real`` says of each segment if it is a sentence."""

    hashes: np.ndarray
    owner: np.ndarray
    sentence: np.ndarray
    capital: np.ndarray  # begins in upper case and is not all upper case
    digit: np.ndarray
    sentence_owner: np.ndarray
    real: np.ndarray


def read_words(texts: Sequence[str | None], least_words: int = 3) -> Words:
    """Splits texts into segments at line ends, tags, straight quotes and full stops; a sentence is a segment that ends in
    ``.``, ``?`` or ``!``, has at least ``least_words`` words and holds no ``_``, ``=``, ``{`` or ``}`` (code, keys and headings are no sentences)."""
    texts = [t or "" for t in texts]
    lower, upper, digit = _case_tables()
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.concatenate(([False], _is_word_char(codes), [False]))
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = turns[::2], turns[1::2]
    n = len(starts)
    plane = np.minimum(codes, 0xFFFF)
    small = np.where(codes < 1 << 16, lower[plane], codes)
    hashes = _runs(_mixed(small.astype(np.uint64) + np.uint64(1)), _CHAR_BASE, starts, ends)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    owner = np.searchsorted(bounds, starts, side="right")
    if not n:
        none = np.empty(0, np.int64)
        return Words(hashes, owner, none, none.astype(bool), none.astype(bool), none, none.astype(bool))
    is_upper = np.where(codes < 1 << 16, upper[plane], False)
    ups = np.concatenate(([0], np.cumsum(is_upper)))
    length = ends - starts
    capital = is_upper[starts] & ~((ups[ends] - ups[starts] == length) & (length > 1))
    digits = digit[plane[starts]]
    count = lambda chars: np.concatenate(([0], np.cumsum(_flags(codes, chars))))
    hard, stop, code = count('\n\r<>"'), count(".?!"), count("_={}")
    after = np.append(starts[1:], len(codes))
    gap = after - ends
    last_of_text = np.append(owner[1:] != owner[:-1], True)
    stopped = (stop[after] > stop[ends]) & ((gap >= 2) | last_of_text)
    closes = stopped | (hard[after] > hard[ends]) | last_of_text
    sentence = np.concatenate(([0], np.cumsum(closes[:-1])))
    last = np.flatnonzero(closes)
    first = np.concatenate(([0], last[:-1] + 1))
    real = stopped[last] & (last - first + 1 >= least_words) & (code[starts[last]] == code[ends[first]])
    return Words(hashes, owner, sentence, capital, digits, owner[first], real)


def term_hashes(words: Words, function_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the terms (words and pairs of neighbours), their sentence numbers and whether they are words, sorted by sentence.

    Runs of two or more capitalised words that are no function words are names, and names and numbers make no terms.
    ``function_words``: sorted hashes.
    """
    h = words.hashes
    n = len(h)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, bool)
    at = np.minimum(np.searchsorted(function_words, h), max(len(function_words) - 1, 0))
    function = function_words[at] == h if len(function_words) else np.zeros(n, bool)
    named = words.capital & ~function
    together = words.sentence[1:] == words.sentence[:-1]
    pair = named[1:] & named[:-1] & together
    name = np.zeros(n, bool)
    name[1:] |= pair
    name[:-1] |= pair
    usable = ~name & ~words.digit & words.real[words.sentence]
    both = np.flatnonzero(usable[1:] & usable[:-1] & together)
    pairs = _mixed(h[both] * np.uint64(_WORD_BASE) + h[both + 1])
    single = np.flatnonzero(usable)
    terms = np.concatenate([h[single], pairs])
    owner = np.concatenate([words.sentence[single], words.sentence[both]])
    order = np.argsort(owner, kind="stable")
    return terms[order], owner[order], (np.arange(len(terms)) < len(single))[order]
