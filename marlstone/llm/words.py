"""Hashes of words and of runs of words over whole batches of texts, in numpy.

A word is an unbroken run of letters and digits of any language; letter case does not count. A run's hash is a
polynomial over 64 bits taken from prefix sums, so any number of runs costs a few array operations.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import numpy as np

#: Characters whose arrays are held at once.
PIECE_CHARS = 1 << 20
_CHAR_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93
_FIRST, _SECOND = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
NO_HASH = np.uint64(0xFFFFFFFFFFFFFFFF)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_plane: list[np.ndarray] = []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _FIRST
    x = (x ^ (x >> np.uint64(33))) * _SECOND
    return x ^ (x >> np.uint64(33))


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of an odd base and of its inverse modulo 2**64."""
    held = _powers.get(base)
    if held is None or len(held[0]) <= n:
        size = max(n + 1, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            powers = np.full(size, b, np.uint64)
            powers[0] = 1
            both.append(np.cumprod(powers, dtype=np.uint64))
        held = _powers[base] = (both[0], both[1])
    return held


def _is_word_char(codes: np.ndarray) -> np.ndarray:
    if not _plane:
        _plane.append(np.fromiter((unicodedata.category(chr(c))[0] in "LN" for c in range(1 << 16)), bool, 1 << 16))
    if len(codes) and codes.max() < 1 << 16:
        return _plane[0][codes]
    flags = _plane[0][np.minimum(codes, 0xFFFF)]
    for c in np.unique(codes[codes >= 1 << 16]):
        flags[codes == c] = unicodedata.category(chr(int(c)))[0] in "LN"
    return flags


def _runs(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed polynomial hash of values[start:end] for each pair."""
    powers, inverse = _power(base, len(values))
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers[: len(values)], dtype=np.uint64, out=prefix[1:])
    return _mixed((prefix[ends] - prefix[starts]) * inverse[starts])


def _piece(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    flags = np.concatenate(([False], _is_word_char(codes), [False]))
    turns = np.flatnonzero(flags[1:] != flags[:-1])
    starts, ends = turns[::2], turns[1::2]
    hashes = _runs(_mixed(codes.astype(np.uint64) + np.uint64(1)), _CHAR_BASE, starts, ends)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.searchsorted(bounds, starts, side="right")


def _slices(text: str, size: int):
    """Parts of a long text, cut where no word is cut."""
    at = 0
    while at < len(text):
        end = min(at + size, len(text))
        while end < len(text) and unicodedata.category(text[end - 1])[0] in "LN" and unicodedata.category(text[end])[0] in "LN":
            end += 1
        yield text[at:end]
        at = end


def word_hashes(texts: Sequence[str | None], piece_chars: int = PIECE_CHARS) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, and for each the position of its text. Null texts have no words."""
    hashes, owners, held, ids, size = [], [], [], [], 0

    def flush():
        nonlocal held, ids, size
        if held:
            h, local = _piece(held)
            hashes.append(h)
            owners.append(np.asarray(ids, np.int64)[local])
        held, ids, size = [], [], 0

    for i, text in enumerate(texts):
        if not text:
            continue
        text = text.lower()
        for part in (text,) if len(text) <= piece_chars else _slices(text, piece_chars):
            if size + len(part) > piece_chars:
                flush()
            held.append(part)
            ids.append(i)
            size += len(part)
    flush()
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def kgram_hashes(words: np.ndarray, owners: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; NO_HASH where the text ends before."""
    out = np.full(len(words), NO_HASH, np.uint64)
    n = len(words) - k + 1
    if n > 0:
        at = np.arange(n)
        h = _runs(words, _WORD_BASE, at, at + k)
        h[h == NO_HASH] = np.uint64(0)
        whole = owners[:n] == owners[k - 1 :]
        out[:n][whole] = h[whole]
    return out


def winnow(grams: np.ndarray, owners: np.ndarray, k: int, window: int) -> np.ndarray:
    """Positions of the least k-gram of every window of k-grams (the rightmost of equals).

    Two texts that share ``window + k - 1`` words in a row share a whole window, hence a chosen k-gram at the same place of it.
    """
    span = window + k - 1
    n = len(grams) - span + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best, place = grams[:n].copy(), np.zeros(n, np.int64)
    for s in range(1, window):
        less = grams[s : n + s] <= best
        best[less] = grams[s : n + s][less]
        place[less] = s
    whole = owners[:n] == owners[span - 1 :]
    chosen = np.zeros(len(grams), bool)
    chosen[(np.arange(n) + place)[whole]] = True
    return np.flatnonzero(chosen)
