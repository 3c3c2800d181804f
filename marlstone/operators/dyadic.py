"""Canonical dyadic blocks of integer intervals, as Spark columns and as a numpy kernel."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_blocks(lo: Column, hi: Column, levels: int) -> Column:
    """array<struct<level int, block bigint>> of the maximal aligned blocks that tile [lo, hi), 0 <= lo, hi <= 2**levels.

    At level ``l`` the interval holds blocks ceil(lo / 2**l) .. floor(hi / 2**l); the first is a right child and the last
    a left child exactly where the parent sticks out, so each level adds at most two blocks. Empty for lo >= hi.
    """
    def at(level: Column) -> Column:
        width = F.call_function("shiftleft", F.lit(1).cast("bigint"), level)
        first = F.call_function("shiftright", lo + width - 1, level)
        last = F.call_function("shiftright", hi, level)
        some = first < last
        left = F.when(some & (first % 2 == 1), F.struct(level.alias("level"), first.alias("block")))
        right = F.when(some & (last % 2 == 1), F.struct(level.alias("level"), (last - 1).alias("block")))
        return F.array(left, right)

    found = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at))
    return F.when(lo < hi, F.filter(found, lambda b: b.isNotNull())).otherwise(F.filter(found, lambda b: F.lit(False)))


def dyadic_union(group: np.ndarray, lo: np.ndarray, hi: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of half-open intervals per group by canonical blocks; 0 <= lo <= hi <= 2**bits, group < 2**(56 - bits).

    Decompose into blocks, drop repeats and blocks inside an ancestor, merge sibling pairs upward until none is left,
    then coalesce blocks that touch. Returns group, lo and hi of the disjoint, non-touching pieces.
    """
    group, lo, hi = (np.asarray(x, dtype=np.int64) for x in (group, lo, hi))
    codes = []
    for level in range(bits + 1):
        first, last = -((-lo) >> level), hi >> level
        some = first < last
        if not some.any():
            continue
        for pick, block in ((some & (first & 1 == 1), first), (some & (last & 1 == 1), last - 1)):
            start = (group[pick] << (bits + 1)) | (block[pick] << level)
            codes.append((start << 6) | (63 - level))
    if not codes:
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    codes = np.unique(np.concatenate(codes))  # by group, start, larger block first
    start, level = codes >> 6, 63 - (codes & 63)
    reach = np.maximum.accumulate(start + (np.int64(1) << level))
    outside = np.ones(len(start), bool)
    outside[1:] = start[1:] + (np.int64(1) << level[1:]) > reach[:-1]  # blocks nest or are disjoint
    start, level = start[outside], level[outside]
    while True:
        pair = (level[:-1] == level[1:]) & ((start[:-1] >> level[:-1]) & 1 == 0) & (start[:-1] + (np.int64(1) << level[:-1]) == start[1:])
        if not pair.any():
            break
        level[:-1][pair] += 1
        keep = np.ones(len(start), bool)
        keep[1:][pair] = False
        start, level = start[keep], level[keep]
    end = start + (np.int64(1) << level)
    opens = np.ones(len(start), bool)
    opens[1:] = start[1:] != end[:-1]
    closes = np.append(np.flatnonzero(opens)[1:] - 1, len(start) - 1)
    mask = (np.int64(1) << (bits + 1)) - 1
    group_out = start[opens] >> (bits + 1)
    return group_out, start[opens] & mask, end[closes] - (group_out << (bits + 1))
