"""A hierarchical navigable small-world graph over the unit vectors of one shard, held as flat neighbour arrays, in numpy.

Every vector draws a top layer, each layer holding about one in ``links`` of the one below. Vectors are inserted in batches: a batch descends
from the top layer by beam search, is linked in each of its layers to near but diverse ones among those found and among the batch
itself, and the vectors it links to keep their nearest links back. A search descends in the same way.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Entries handed down from a layer to the next, and the beam of layers that only lead the way.
_ENTRIES, _NARROW = 4, 4
#: Queries that walk abreast; their marks of rows met take four bytes a row of the layer each.
_ABREAST = 512
#: Products taken at once.
_AT_ONCE = 1024
#: The key of no row, that of a similarity of -2.0 and looked at; the bits of a row.
_NONE, _LOW = np.int64(0x40000000FFFFFFFF), 0x7FFFFFFF


@dataclass
class Layer:
    members: np.ndarray  # vectors of the layer, ascending; a vector's row is its place here
    vectors: np.ndarray
    links: np.ndarray  # rows linked to: the chosen ones, then links back; -1 where there is none
    back_sims: np.ndarray
    down: np.ndarray  # row of each member in the layer below


@dataclass
class Graph:
    order: np.ndarray  # position of each inserted vector in the input
    layers: list[Layer]  # from the bottom up
    wide: int


def _keys(sims: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A number for each similarity and row: the more similar, the smaller, then the smaller row. Even; odd where looked at."""
    bits = np.ascontiguousarray(sims, np.float32).view(np.int32)
    bits = ~(bits ^ ((bits >> 31) & _LOW))  # the order of floats below zero is turned
    return (bits.astype(np.int64) << 32) | (rows.astype(np.int64) << 1)


def _sims(keys: np.ndarray) -> np.ndarray:
    bits = ~(keys >> 32).astype(np.int32)
    return (bits ^ ((bits >> 31) & _LOW)).view(np.float32)


def _products(left: np.ndarray, i: np.ndarray, right: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Dot products of rows i and j, few at a time so that the rows copied stay in the processor's cache."""
    out = np.empty(len(i), np.float32)
    a, b = np.empty((_AT_ONCE, left.shape[1]), np.float32), np.empty((_AT_ONCE, left.shape[1]), np.float32)
    for at in range(0, len(i), _AT_ONCE):
        end = min(at + _AT_ONCE, len(i))
        x, y = a[: end - at], b[: end - at]
        left.take(i[at:end], axis=0, out=x, mode="clip")
        right.take(j[at:end], axis=0, out=y, mode="clip")
        np.einsum("ij,ij->i", x, y, out=out[at:end])
    return out


def _beam(layer: Layer, queries: np.ndarray, entries: np.ndarray, ef: int, expand: int, patient: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Rows and similarities of the best ``ef`` met from the entries on, best first; -1 and -2.0 where there are fewer.

    The best ``expand`` rows not looked at yet are replaced by their links, until the best ``ef`` have all been looked at or, without
    patience, a round changes nothing among them.
    """
    best = np.full((len(queries), ef), _NONE)
    for at in range(0, len(queries), _ABREAST):
        end = at + _ABREAST
        _walk(layer, queries[at:end], entries[at:end, :ef], ef, min(expand, ef), patient, best[at:end])
    return np.where(best == _NONE, -1, (best >> 1) & _LOW), _sims(best)


def _walk(layer: Layer, q: np.ndarray, entries: np.ndarray, ef: int, expand: int, patient: bool, best: np.ndarray) -> None:
    """Fills ``best``, a sorted beam of keys to each query."""
    n, width, b = len(layer.members), layer.links.shape[1], len(q)
    # rows met, by query and row; place 0 stands for missing links
    seen = np.zeros(b * (n + 1), np.min_scalar_type(expand * width))
    base = np.arange(1, b * (n + 1), n + 1)
    seen[base - 1] = 1
    seen[(base[:, None] + entries).ravel()] = 1
    sims = np.einsum("bed,bd->be", layer.vectors[entries], q)
    first = np.where(entries >= 0, _keys(sims, np.maximum(entries, 0)), _NONE)
    first.sort(axis=1)
    best[:, : first.shape[1]] = first
    marks = np.tile(np.arange(1, expand * width + 1, dtype=seen.dtype), b)
    beam, live = best.copy(), np.arange(b)
    while True:
        waiting = np.where(beam & 1, _NONE, beam)
        if expand < ef:
            waiting.partition(expand - 1, axis=1)
        waiting = waiting[:, :expand]
        moving = waiting.min(1) != _NONE
        if not moving.all():
            best[live[~moving]] = beam[~moving]
            beam, live, base, q, waiting = beam[moving], live[moving], base[moving], q[moving], waiting[moving]
        if not len(live):
            return
        beam |= beam <= waiting.max(1)[:, None]
        step = layer.links.take((waiting >> 1) & _LOW, axis=0, mode="clip")
        step[waiting == _NONE] = -1
        step = step.reshape(len(live), expand * width)
        cell = (step + base[:, None]).ravel()
        at = np.flatnonzero(seen.take(cell) == 0)
        # a row met twice in one round counts once: the mark names which of its links stands
        cell, mark = cell.take(at), marks.take(at)
        seen[cell] = mark
        at = at.compress(seen.take(cell) == mark)
        r, found = at // (expand * width), step.ravel().take(at)
        score = _products(layer.vectors, found, q, r)
        better = np.flatnonzero(score > _sims(beam[:, -1]).take(r))
        r = r.take(better)
        count = np.bincount(r, minlength=len(live))
        if len(r):
            most = int(count.max())
            place = np.arange(ef, ef + len(r)) - np.repeat(np.cumsum(count) - count, count)
            grown = np.full((len(live), ef + most), _NONE)
            grown[:, :ef] = beam
            grown.ravel()[r * (ef + most) + place] = _keys(score.take(better), found.take(better))
            grown.sort(axis=1)
            beam = grown[:, :ef].copy()
        if not patient:
            same = count == 0
            best[live[same]] = beam[same]
            beam, live, base, q = beam[~same], live[~same], base[~same], q[~same]


def _diverse(layer: Layer, found: np.ndarray, sims: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Of candidates sorted best first, m to link to: first those that are nearer to the vector than to any chosen one, then the next best."""
    v = layer.vectors[found]
    between = np.matmul(v, v.transpose(0, 2, 1))
    there = found >= 0
    chosen = np.zeros(found.shape, bool)
    for j in range(found.shape[1]):
        chosen[:, j] = there[:, j] & (chosen.sum(1) < m) & ~((between[:, j] > sims[:, j, None]) & chosen).any(1)
    order = np.argsort(np.where(there, ~chosen, 2), axis=1, kind="stable")[:, :m]
    return np.take_along_axis(np.where(there, found, -1), order, 1), np.take_along_axis(np.where(there, sims, -2.0), order, 1)


def _link_back(layer: Layer, m: int, source: np.ndarray, target: np.ndarray, sims: np.ndarray) -> None:
    """Adds links from target to source rows; a row keeps the nearest that its places for links back hold."""
    touched = np.unique(target)
    room = layer.links.shape[1] - m
    row = np.concatenate([np.repeat(touched, room), target])
    other = np.concatenate([layer.links[touched, m:].ravel(), source])
    near = np.concatenate([layer.back_sims[touched].ravel(), sims])
    row, other, near = row[other >= 0], other[other >= 0], near[other >= 0]
    order = np.lexsort((other, -near, row))
    row, other, near = row[order], other[order], near[order]
    place = np.arange(len(row)) - np.searchsorted(row, row, "left")
    kept = place < room
    layer.links[touched, m:] = -1
    layer.back_sims[touched] = -2.0
    layer.links[row[kept], m + place[kept]] = other[kept]
    layer.back_sims[row[kept], place[kept]] = near[kept]


def build(vectors: np.ndarray, links: int = 12, back: int = 12, wide: int = 32, batch: int = 1024, seed: int = 7) -> Graph:
    """Graph of a shard, by insertion in an order drawn from ``seed``."""
    n = len(vectors)
    rng = np.random.default_rng(seed)
    order = rng.permutation(n)
    v = np.ascontiguousarray(vectors[order], np.float32)
    top = max(0, int(np.log(max(n, 1)) / np.log(links)) - 1)
    level = np.minimum((-np.log(np.maximum(rng.random(n), 1e-12)) / np.log(links)).astype(int), top)
    level[:1] = top  # the vector that every descent begins at
    layers: list[Layer] = []
    for height in range(top + 1):
        members = np.flatnonzero(level >= height)
        down = np.searchsorted(layers[-1].members, members) if layers else members
        layers.append(Layer(members, v[members] if height else v, np.full((len(members), links + back), -1, np.int32), np.full((len(members), back), -2.0, np.float32), down))
    graph = Graph(order, layers, wide)
    at = 1
    while at < n:
        end = min(n, at + min(batch, max(at, 1)))
        _insert(graph, v[at:end], level[at:end], at, end, links, wide)
        at = end
    return graph


def _insert(graph: Graph, q: np.ndarray, level: np.ndarray, at: int, end: int, m: int, wide: int) -> None:
    entries = np.zeros((len(q), 1), np.int64)
    for height in range(len(graph.layers) - 1, -1, -1):
        layer = graph.layers[height]
        linked = level >= height
        lead, join = np.flatnonzero(~linked), np.flatnonzero(linked)
        below = np.full((len(q), _ENTRIES), -1, np.int64)
        if len(lead):
            below[lead] = _beam(layer, q[lead], entries[lead], _NARROW, 2, False)[0][:, :_ENTRIES]
        if len(join):
            found, sims = _beam(layer, q[join], entries[join], wide, 4)
            below[join] = found[:, :_ENTRIES]
            first = int(np.searchsorted(layer.members, at))
            mine = first + np.arange(len(join))
            among = q[join] @ q[join].T
            np.fill_diagonal(among, -2.0)
            few = min(len(join), wide)
            near = np.argpartition(-among, few - 1, axis=1)[:, :few]
            near_sims = np.take_along_axis(among, near, 1)
            found, sims = np.concatenate([found, np.where(near_sims > -2.0, mine[near], -1)], 1), np.concatenate([sims, near_sims], 1)
            best = np.argsort(-sims, axis=1, kind="stable")[:, :wide]
            chosen, chosen_sims = _diverse(layer, np.take_along_axis(found, best, 1), np.take_along_axis(sims, best, 1), m)
            layer.links[mine, : chosen.shape[1]] = chosen
            r, c = np.nonzero(chosen >= 0)
            _link_back(layer, m, mine[r], chosen[r, c].astype(np.int64), chosen_sims[r, c])
        if height:
            entries = np.where(below >= 0, layer.down[below], -1)


def search(
    graph: Graph, queries: np.ndarray, k: int, ef: int = 32, expand: int = 4, patient: bool = True, own: np.ndarray | None = None, batch: int = 512
) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the input and similarities of the k most similar vectors found for each query, best first; -1 where there are fewer.

    ``own``: positions of queries that are in the graph, or -1; they set out from their place instead of descending to it.
    """
    ids, sims = np.full((len(queries), k), -1, np.int64), np.full((len(queries), k), -2.0, np.float32)
    if not len(graph.order):
        return ids, sims
    bottom = graph.layers[0]
    place = np.empty(len(graph.order), np.int64)
    place[graph.order] = np.arange(len(graph.order))
    for at in range(0, len(queries), batch):
        q = queries[at : at + batch]
        entries = np.full((len(q), _ENTRIES), -1, np.int64)
        held = np.zeros(len(q), bool) if own is None else own[at : at + batch] >= 0
        if held.any():
            entries[held, 0] = place[own[at : at + batch][held]]
        away = np.flatnonzero(~held)
        if len(away):
            on = np.zeros((len(away), 1), np.int64)
            for layer in graph.layers[:0:-1]:
                below = _beam(layer, q[away], on, _NARROW, 2, patient)[0][:, :_ENTRIES]
                on = np.where(below >= 0, layer.down[below], -1)
            entries[away, : on.shape[1]] = on
        rows, near = _beam(bottom, q, entries, max(ef, k), expand, patient)
        ids[at : at + batch] = np.where(rows[:, :k] >= 0, graph.order[rows[:, :k]], -1)
        sims[at : at + batch] = near[:, :k]
    return ids, sims
