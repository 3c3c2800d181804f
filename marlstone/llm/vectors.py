"""The most similar vectors of the same collection for every vector, by a small-world graph per shard.

A bounded sample of vectors serves as shard centres. Every vector is held by the shard of its nearest centre and asked in
the shards whose centre is almost as near. A shard is one cell, or a grid of cells where it holds or is asked too many vectors: each
cell builds the graph of its part of the held vectors, searches it for its part of the asked ones, and the cells' results are merged.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm import hnsw


@dataclass(frozen=True)
class IndexSpec:
    """``margin`` is in cosine: a vector is asked in each shard whose centre is at most so much less similar than its own."""

    dim: int = 64
    k: int = 5
    min_cosine: float = 0.90
    #: Vectors to one centre of the sample; at most ``max_shards`` are drawn, beyond which shards grow and are split.
    shard_rows: int = 8192
    max_shards: int = 16_384
    #: Centres more similar than this are one: a dense group is few shards, split by hash, instead of very many.
    apart: float = 0.90
    #: Vectors that one cell holds and is asked at most, on average.
    split_rows: int = 32_768
    ask_rows: int = 131_072
    margin: float = 0.08
    links: int = 16
    back: int = 24
    ef: int = 16
    #: Whether a search goes on until its whole beam has been looked at, or ends with a round that betters nothing.
    patient: bool = False
    #: Beam for vectors whose whole first beam reaches ``min_cosine``: they lie in a dense group.
    dense_ef: int = 96
    expand: int = 4


def search_spec(k: int = 5, dim: int = 64) -> IndexSpec:
    """Settings for neighbours at any distance: far ones lie in many shards, so every shard within a wide margin is asked."""
    return IndexSpec(dim=dim, k=k, min_cosine=-1.0, margin=0.4, ef=64, dense_ef=64, patient=True)


def _unit_vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the usable vectors and the vectors at unit length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = np.flatnonzero(np.asarray(column.value_lengths().fill_null(-1)) == dim)
    flat = column.take(pa.array(at)).flatten()
    v = np.asarray(flat.fill_null(np.nan) if flat.null_count else flat, np.float32).reshape(len(at), dim)
    norm = np.linalg.norm(v.astype(np.float64), axis=1)
    usable = np.isfinite(norm) & (norm > 0)
    return at[usable], (v[usable] / norm[usable][:, None]).astype(np.float32)


def _packed(v: np.ndarray) -> pa.Array:
    width = v.shape[1] * 4
    offsets = np.arange(len(v) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(v))])


def _unpacked(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    parts = [np.frombuffer(b"".join(x.as_py() for x in chunk), np.float32).reshape(-1, dim) for chunk in column.chunks if len(chunk)]
    return np.concatenate(parts) if parts else np.empty((0, dim), np.float32)


def unit_rows(df: DataFrame, dim: int) -> DataFrame:
    """collection, id and the vector at unit length (packed), for vectors of ``dim`` finite numbers that are not all zero."""

    def run(batches):
        for b in batches:
            at, v = _unit_vectors(b.column(2), dim)
            rows = pa.array(at)
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), _packed(v)], ["collection", "id", "vec"])

    return df.where("id is not null and collection is not null").select(F.col("collection").cast("string"), F.col("id").cast("bigint"), "embedding").mapInArrow(run, "collection string, id bigint, vec binary")


def _nearest_shards(v: np.ndarray, centres: np.ndarray, spec: IndexSpec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, shard and whether it is the row's own, for the own shard and those within the margin."""
    rows, shards, own = [], [], []
    for at in range(0, len(v), 2048):
        sims = v[at : at + 2048] @ centres.T
        home = sims.argmax(1)
        best = sims[np.arange(len(sims)), home]
        asked = sims >= (best - spec.margin)[:, None]
        asked[np.arange(len(sims)), home] = True
        r, s = np.nonzero(asked)
        rows.append(r + at)
        shards.append(s)
        own.append(s == home[r])
    if not rows:
        empty = np.empty(0, np.int64)
        return empty, empty, np.empty(0, bool)
    return np.concatenate(rows), np.concatenate(shards), np.concatenate(own)


#: Vectors routed at once and rows sent at once: a vector may ask in many shards.
_ROUTE_ROWS, _SEND_ROWS = 1024, 65_536
_ROUTED = "cell int, collection string, own boolean, ask boolean, id bigint, vec binary"


@dataclass(frozen=True)
class _Grid:
    """Cells of the shards of one collection: shard s has ``held[s]`` times ``asked[s]`` of them from ``first[s]`` on."""

    centres: np.ndarray
    held: np.ndarray
    asked: np.ndarray
    first: np.ndarray


def _spread(ids: np.ndarray, turn: int) -> np.ndarray:
    """31 bits of each id, well mixed; different turns are independent."""
    x = ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn * 0xD6E8FEB86659FD93 % 2**64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
    return (x >> np.uint64(33)).astype(np.int64)


def _repeats(times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each position as often as ``times`` says, and its number among its repeats."""
    again = np.repeat(np.arange(len(times)), times)
    return again, np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)


def _cells_of(ids: np.ndarray, ask: np.ndarray, row: np.ndarray, shard: np.ndarray, own: np.ndarray, grid: _Grid) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, cell, whether it is held there and whether it asks there. In its own shard a vector is held by every cell of its part;
    in each shard it asks once in every part."""
    part, lane = _spread(ids[row], 1) % grid.held[shard], _spread(ids[row], 2) % grid.asked[shard]
    at = np.flatnonzero(own)
    again, k = _repeats(grid.asked[shard[at]])
    at = at[again]
    held_row, held_cell, held_ask = row[at], grid.first[shard[at]] + part[at] * grid.asked[shard[at]] + k, ask[row[at]] & (k == lane[at])
    at = np.flatnonzero(ask[row])
    again, k = _repeats(grid.held[shard[at]])
    at = at[again]
    away = ~own[at] | (k != part[at])  # where it is held it asks already
    at, k = at[away], k[away]
    asked_cell = grid.first[shard[at]] + k * grid.asked[shard[at]] + lane[at]
    return (
        np.concatenate([held_row, row[at]]), np.concatenate([held_cell, asked_cell]),
        np.concatenate([np.ones(len(held_row), bool), np.zeros(len(at), bool)]), np.concatenate([held_ask, np.ones(len(at), bool)]),
    )


def _pieces(names: np.ndarray) -> list[tuple[str, np.ndarray]]:
    """Positions of a batch by collection, few at a time."""
    return [(name, at[i : i + _ROUTE_ROWS]) for name in dict.fromkeys(names) for at in [np.flatnonzero(names == name)] for i in range(0, len(at), _ROUTE_ROWS)]


def _routed(units: DataFrame, grids: dict[str, _Grid], spec: IndexSpec) -> DataFrame:
    """Each vector in every cell that holds it or that it asks."""

    def run(batches):
        for b in batches:
            names = b.column(0).to_numpy(zero_copy_only=False)
            ids = b.column(1).to_numpy()
            v = _unpacked(pa.chunked_array([b.column(2)]), spec.dim)
            ask = b.column(3).to_numpy(zero_copy_only=False)
            for name, mine in _pieces(names):
                row, shard, own = _nearest_shards(v[mine], grids[name].centres, spec)
                row, cell, held, asks = _cells_of(ids, ask, mine[row], shard, own, grids[name])
                for i in range(0, len(row), _SEND_ROWS):
                    r, to = row[i : i + _SEND_ROWS], slice(i, i + _SEND_ROWS)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell[to], pa.int32()), pa.array(names[r], pa.string()), pa.array(held[to]), pa.array(asks[to]), pa.array(ids[r]), _packed(v[r])],
                        ["cell", "collection", "own", "ask", "id", "vec"],
                    )

    return units.mapInArrow(run, _ROUTED)


_FOUND = "collection string, id bigint, other bigint, cosine float"


def _cell_search(spec: IndexSpec):
    def run(cell: pa.Table) -> pa.Table:
        own, ask = cell.column("own").to_numpy(), cell.column("ask").to_numpy()
        ids = cell.column("id").to_numpy()
        v = _unpacked(cell.column("vec"), spec.dim)
        held = np.flatnonzero(own)
        held = held[np.argsort(ids[held], kind="stable")]  # the graph does not depend on arrival
        graph = hnsw.build(v[held], spec.links, spec.back)
        asking = np.flatnonzero(ask)
        position = np.full(len(ids), -1, np.int64)
        position[held] = np.arange(len(held))
        found, cosines = hnsw.search(graph, v[asking], max(spec.ef, spec.k + 1), spec.ef, spec.expand, spec.patient, position[asking])
        dense = np.flatnonzero(cosines[:, -1] >= spec.min_cosine) if spec.dense_ef > spec.ef else []
        found, cosines = found[:, : spec.k + 1], cosines[:, : spec.k + 1]  # a held vector finds itself too
        if len(dense):
            found[dense], cosines[dense] = hnsw.search(graph, v[asking[dense]], spec.k + 1, spec.dense_ef, spec.expand)
        r, c = np.nonzero((cosines >= spec.min_cosine) & (found >= 0))
        left, right, sims = ids[asking[r]], ids[held[found[r, c]]], cosines[r, c]
        apart = left != right
        left, right, sims = left[apart], right[apart], sims[apart]
        name = cell.column("collection")[0].as_py() if len(cell) else ""
        return pa.table([pa.array([name] * len(left), pa.string()), pa.array(left), pa.array(right), pa.array(sims, pa.float32())], ["collection", "id", "other", "cosine"])

    return run


def _centres(df: DataFrame, sizes: dict[str, int], spec: IndexSpec) -> dict[str, np.ndarray]:
    """Per collection the vectors with the least hash of id, one per ``shard_rows`` rows and at most ``max_shards``, without those close to one before."""
    out = {}
    for name, n in sizes.items():
        want = min(spec.max_shards, max(1, math.ceil(n / spec.shard_rows)))
        key = F.xxhash64("id", F.lit("centre"))
        share = min(1.0, 3.0 * (want + 30) / n)  # only so many rows need a look
        near = df.where(F.col("collection") == name).where(key <= F.lit(int(-(2**63) + share * (2**64 - 1))))
        rows = unit_rows(near, spec.dim).orderBy(F.xxhash64("id", F.lit("centre")), "id").limit(want).select("vec").collect()
        if len(rows) < want and share < 1.0:
            rows = unit_rows(df.where(F.col("collection") == name), spec.dim).orderBy(F.xxhash64("id", F.lit("centre")), "id").limit(want).select("vec").collect()
        drawn = np.stack([np.frombuffer(r[0], np.float32) for r in rows])
        kept = np.empty_like(drawn)
        many = 0
        for v in drawn:
            if not many or (kept[:many] @ v).max() <= spec.apart:
                kept[many] = v
                many += 1
        out[name] = kept[:many].copy()
    return out


def _grids(units: DataFrame, centres: dict[str, np.ndarray], sizes: dict[str, int], spec: IndexSpec) -> tuple[dict[str, _Grid], int]:
    """The cells of every shard by how many vectors it holds and is asked, and their number."""
    held = {name: np.zeros(len(c), np.int64) for name, c in centres.items()}
    asked = {name: np.zeros(len(c), np.int64) for name, c in centres.items()}
    if any(n > spec.split_rows for n in sizes.values()):

        def run(batches):
            for b in batches:
                names = b.column(0).to_numpy(zero_copy_only=False)
                v = _unpacked(pa.chunked_array([b.column(2)]), spec.dim)
                ask = b.column(3).to_numpy(zero_copy_only=False)
                counts: dict[str, np.ndarray] = {}
                for name, mine in _pieces(names):
                    row, shard, own = _nearest_shards(v[mine], centres[name], spec)
                    many = len(centres[name])
                    both = np.stack([np.bincount(shard[own], minlength=many), np.bincount(shard[ask[mine[row]]], minlength=many)])
                    counts[name] = counts.get(name, 0) + both
                for name, both in counts.items():
                    some = np.flatnonzero(both.sum(0))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(both[0, some]), pa.array(both[1, some])], ["collection", "shard", "held", "asked"])

        # one row per shard comes back, at most max_shards a collection
        counted = units.mapInArrow(run, "collection string, shard int, held bigint, asked bigint").groupBy("collection", "shard").agg(F.sum("held").alias("held"), F.sum("asked").alias("asked"))
        for r in counted.collect():
            held[r["collection"]][r["shard"]], asked[r["collection"]][r["shard"]] = r["held"], r["asked"]
    grids, total = {}, 0
    for name, c in centres.items():
        h, a = np.maximum(-(-held[name] // spec.split_rows), 1), np.maximum(-(-asked[name] // spec.ask_rows), 1)
        first = total + np.cumsum(h * a) - h * a
        total += int((h * a).sum())
        grids[name] = _Grid(c, h, a, first)
    return grids, total


def similar_pairs(df: DataFrame, spec: IndexSpec = IndexSpec(), asked: Column | None = None) -> DataFrame:
    """For every usable vector its ``k`` most similar ones of its collection: collection, id, other, cosine, rank.

    ``df`` has ``collection``, ``id`` (unique in a collection) and ``embedding``. A vector is usable if it has ``spec.dim`` finite numbers, not
    all zero; others, null ones included, have no neighbours and are none. Only neighbours with a cosine of at least ``spec.min_cosine``
    are listed. Equal cosines rank by the smaller id. Of a repeated id with equal vectors one row stands. The index is
    approximate across shards; see the README for its measured recall. Exact copies never make a task grow: of equal vectors only
    the k + 1 with the smallest ids are indexed, and the rest are given the first k, which are their nearest. An empty
    input gives an empty result. With ``asked``, a condition on ``id``, only those vectors ask, against all.
    """
    spark = df.sparkSession
    df = df.select("collection", "id", "embedding")
    units = unit_rows(df, spec.dim)
    h = [F.xxhash64("vec").alias("_h1"), F.xxhash64(F.lit("vector"), "vec").alias("_h2")]
    copies = units.select("collection", *h).groupBy("collection", "_h1", "_h2").agg(F.count(F.lit(1)).alias("_n"))
    known = copies.groupBy("collection").agg(F.sum("_n").alias("n"), F.max("_n").alias("most")).collect()  # a row per collection
    sizes = {r["collection"]: r["n"] for r in known}
    if not sizes:
        return spark.createDataFrame([], f"{_FOUND.replace('float', 'double')}, rank int")
    surplus = None
    if max(r["most"] for r in known) > spec.k + 1:
        many = copies.where(F.col("_n") > spec.k + 1).select("collection", "_h1", "_h2")
        named = units.select("collection", "id", *h).join(many, ["collection", "_h1", "_h2"], "left_semi")
        order = Window.partitionBy("collection", "_h1", "_h2").orderBy("id")
        first = named.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= spec.k + 1)  # cut before the shuffle
        kept = first.groupBy("collection", "_h1", "_h2").agg(F.sort_array(F.collect_list("id")).alias("_first"))
        rest = named.join(F.broadcast(kept) if kept.count() * (spec.k + 5) * 8 < 8_000_000 else kept, ["collection", "_h1", "_h2"])
        rest = rest.where(F.col("id") > F.element_at("_first", -1))
        surplus = rest.select("collection", "id", F.explode(F.slice("_first", 1, spec.k)).alias("other"), F.lit(1.0).cast("float").alias("cosine"))
        units = units.join(rest.select("collection", "id"), ["collection", "id"], "left_anti")
    centres = _centres(df, sizes, spec)
    ask = F.lit(True) if asked is None else F.coalesce(asked, F.lit(False))
    asking = units.select("collection", "id", "vec", ask.alias("ask"))
    grids, cells = _grids(asking, centres, sizes, spec)
    # a task to a cell: what a task takes is bounded by the grid, not by the number of partitions
    found = _routed(asking, grids, spec).repartitionById(cells, "cell").groupBy("cell").applyInArrow(_cell_search(spec), _FOUND)
    if asked is not None:
        both = found if surplus is None else found.unionByName(surplus.where(ask))
        return _best(both, spec)
    # a pair found from one side counts for both; to the first of its copies a surplus copy is never among the k nearest
    mirrored = F.explode(F.array(F.struct("id", "other"), F.struct(F.col("other").alias("id"), F.col("id").alias("other"))))
    both = found.select("collection", mirrored.alias("e"), "cosine").select("collection", "e.id", "e.other", "cosine")
    if surplus is not None:
        both = both.unionByName(surplus)
    return _best(both, spec)


def _best(found: DataFrame, spec: IndexSpec) -> DataFrame:
    merged = found.groupBy("collection", "id", "other").agg(F.max("cosine").alias("cosine"))
    rank = F.row_number().over(Window.partitionBy("collection", "id").orderBy(F.desc("cosine"), "other"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= spec.k).select("collection", "id", "other", F.col("cosine").cast("double").alias("cosine"), "rank")
