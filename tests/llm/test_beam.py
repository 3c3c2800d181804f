"""The beam of the small-world graph: what it finds and what it copies."""

import tracemalloc

import numpy as np
import pytest

from marlstone.llm import hnsw


def unit(v):
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def plain_walk(layer, q, entries, ef, expand, patient):
    """One query, a row at a time."""
    sims = {int(e): float(np.einsum("i,i->", layer.vectors[e], q)) for e in entries if e >= 0}
    beam, looked, seen = sorted(sims, key=lambda x: -sims[x])[:ef], set(), set(sims)
    while True:
        waiting = [x for x in beam if x not in looked][:expand]
        if not waiting:
            return beam, sims
        looked |= set(waiting)
        met = {int(x) for w in waiting for x in layer.links[w] if x >= 0} - seen
        seen |= met
        sims |= {x: float(np.einsum("i,i->", layer.vectors[x], q)) for x in met}
        worst = sims[beam[-1]] if len(beam) == ef else -2.0
        better = [x for x in met if sims[x] > worst]
        beam = sorted(beam + better, key=lambda x: -sims[x])[:ef]
        if not patient and not better:
            return beam, sims


@pytest.mark.parametrize("ef,expand,patient", [(16, 4, False), (24, 4, True), (4, 2, False), (3, 8, True), (900, 16, True)])
def test_beam_is_that_of_a_plain_walk(ef, expand, patient):
    rng = np.random.default_rng(11)
    layer = hnsw.build(unit(rng.normal(size=(800, 6)))).layers[0]
    q = np.concatenate([layer.vectors[:40], -layer.vectors[40:60], unit(rng.normal(size=(40, 6)))])
    entries = np.stack([rng.permutation(800)[:4] for _ in q])
    entries[::3, 1:] = -1
    entries[1::7, 0] = -1
    entries[5] = -1  # nowhere to set out from
    rows, sims = hnsw._beam(layer, q, entries, ef, expand, patient)
    for i in range(len(q)):
        want, score = plain_walk(layer, q[i], entries[i], ef, expand, patient)
        assert rows[i].tolist() == want + [-1] * (ef - len(want))
        assert np.allclose(sims[i], [score[x] for x in want] + [-2.0] * (ef - len(want)), atol=1e-6)


def test_equal_rows_and_rows_below_zero_keep_their_order():
    sims = np.array([[1.0, 0.5, 0.5, 0.0, -0.25, -0.25, -1.0, -2.0]], np.float32)
    keys = hnsw._keys(sims, np.array([[7, 2**31 - 1, 3, 5, 9, 1, 0, 4]]))
    assert np.argsort(keys[0]).tolist() == [0, 2, 1, 3, 5, 4, 6, 7]
    assert hnsw._sims(keys).tolist() == sims.tolist() and (keys < hnsw._NONE).all() and not (keys & 1).any()


def test_rows_met_are_copied_few_at_a_time():
    """The rows a round meets were copied all at once, some ten times the processor's cache, which cost half of the time."""
    rng = np.random.default_rng(12)
    v = unit(rng.normal(size=(4000, 64)))
    graph = hnsw.build(v, 16, 24)
    tracemalloc.start()
    try:
        ids, _ = hnsw.search(graph, v, 6, 16, 4, False, np.arange(len(v)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (ids[:, 0] == np.arange(len(v))).all()
    # 32 MB when they were
    assert peak < 16_000_000, peak
