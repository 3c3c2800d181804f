"""Late events, as-of join, change feed and intervals against brute force and on awkward rows."""

import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import asof, change_feed, intervals, late_events
from marlstone.operators.dyadic import canonical_blocks, dyadic_union

UTC = timezone.utc
T0 = datetime(2024, 5, 1, tzinfo=UTC)
CLAIM = "event_id bigint, source_id string, content_hash string, valid_from timestamp, recorded_from timestamp, claim struct<predicate:string,object:string>, n int, row string, period string"


def claims(spark, rows):
    return spark.createDataFrame([(*r, ("P", "o"), 1, "x", "y") for r in rows], CLAIM)


def test_late_events_outcomes_and_edges(spark):
    day = timedelta(days=1)
    rows = [
        (1, "s", "h", T0, T0 + timedelta(hours=1)), (2, "s", "h", T0, T0 + 9 * day), (3, "s", None, T0, T0 + day), (4, "s", None, T0, T0 + 4 * day), (5, "s", None, T0, T0 + 4 * day - timedelta(microseconds=1)),
        (6, None, "h", T0, T0 + 30 * day), (7, "s", "k", None, T0), (8, "s", "k2", T0, None), (9, "s", "e", T0, T0 + 2 * day), (10, "s", "e", T0, T0 + 2 * day), (1, "s", "h", T0, T0 + timedelta(hours=1)),
        (11, "s", "old", datetime(1969, 12, 31, 12, tzinfo=UTC), datetime(1970, 1, 1, tzinfo=UTC)),
    ]
    out = late_events.late_claims([late_events.claim_rows(claims(spark, rows))])
    got = {r.event_id: r.outcome for r in out.collect()}
    assert got == {1: "on_time", 3: "correction", 4: "too_late", 5: "correction", 6: "too_late", 9: "correction", 11: "correction"}


def counted_at_once(rows):
    """Plain counts per (source, day): on time, corrections, too late."""
    first = {}
    for event, source, content, valid, recorded in rows:
        if valid is not None and recorded is not None:
            key = (source, content, event if content is None else None)
            first[key] = min(first.get(key, (recorded, event, valid)), (recorded, event, valid))
    out = defaultdict(lambda: [0, 0, 0])
    for (source, _, _), (recorded, _, valid) in first.items():
        day = valid.replace(hour=0, minute=0, second=0, microsecond=0)
        out[source, day][0 if recorded < day + timedelta(days=1) else 1 if recorded < day + timedelta(days=4) else 2] += 1
    return {k: tuple(v) for k, v in out.items()}


def read_back(state):
    return {(r.source_id, r.period.replace(tzinfo=UTC)): (r.n_on_time, r.n_corrections, r.n_too_late) for r in late_events.read_counters(state).collect()}


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_counter_states_merge_from_any_split(spark, seed):
    rng = random.Random(seed)
    stamp = lambda: T0 + timedelta(hours=rng.randrange(72))
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, f"h{rng.randrange(40)}"]), rng.choice([stamp(), stamp(), None]), T0 + timedelta(hours=rng.randrange(200))) for i in range(150)]
    want = counted_at_once(rows)
    parts = [[r for r in rows if rng.random() < 0.5] for _ in range(3)]
    parts += [[r for r in rows if not any(r in p for p in parts)], rng.sample(rows, 30) * 2]
    rng.shuffle(parts)
    states = [late_events.delivered_cells(late_events.claim_rows(claims(spark, p))) for p in parts]
    whole = late_events.merge_cells(*states)
    assert read_back(late_events.counters(whole, 1)) == want
    assert read_back(late_events.counters(late_events.merge_cells(whole, states[0], whole), 1)) == want
    # an earlier publication, read again after the later one, changes nothing
    early, late = late_events.counters(late_events.merge_cells(states[0]), 1), late_events.counters(whole, 5)
    for order in ((early, late), (late, early), (early, late, early, late)):
        assert read_back(late_events.merge_counters(*order)) == want
    assert late_events.read_counters(late_events.counters(late_events.merge_cells(states[0].limit(0)), 1)).count() == 0


def test_event_moves_to_its_earlier_outcome_and_day(spark):
    late, early = [(1, "s", "h", T0, T0 + timedelta(days=9))], [(2, "s", "h", T0 + timedelta(days=1), T0 + timedelta(days=2, hours=1))]
    a, b = (late_events.delivered_cells(late_events.claim_rows(claims(spark, rows))) for rows in (late, early))
    assert read_back(late_events.counters(a, 1)) == {("s", T0): (0, 0, 1)}
    for states in ((a, b), (b, a), (b, a, a)):
        assert read_back(late_events.counters(late_events.merge_cells(*states), 2)) == {("s", T0 + timedelta(days=1)): (0, 1, 0)}
    both = late_events.counters(late_events.merge_cells(a, b), 2)
    assert read_back(late_events.merge_counters(both, late_events.counters(a, 1))) == {("s", T0 + timedelta(days=1)): (0, 1, 0)}
    # events of different batches add up
    other = late_events.delivered_cells(late_events.claim_rows(claims(spark, [(7, "s", None, T0, T0 + timedelta(days=9))])))
    assert read_back(late_events.counters(late_events.merge_cells(a, other), 1)) == {("s", T0): (0, 0, 2)}


def best_claim(q, cs):
    fit = [c for c in cs if c[1:4] == q[1:4] and None not in q[1:6] and c[4] is not None and c[6] is not None and c[4] <= q[4] and (c[5] is None or q[4] < c[5]) and c[6] <= q[5]]
    return max(((c[7] is not None, c[7] or 0, c[6], c[0]) for c in fit), default=None)


@pytest.mark.parametrize("hot_rows", [200_000, 7, 20])
def test_asof_against_brute_force(spark, hot_rows):
    rng = random.Random(hot_rows)
    hour = asof.HOUR_US
    stamp = lambda: rng.choice([rng.randrange(0, 40 * hour), rng.randrange(0, 40) * hour, rng.randrange(3 * hour, 3 * hour + 50), -rng.randrange(hour)])
    cs = []
    for i in range(300):
        a = stamp()
        cs.append((i, rng.choice(["s", "t", None]), "k", rng.choice("pq"), rng.choice([a, a, a, None]), rng.choice([None, a + rng.randrange(1, 20 * hour), a + rng.randrange(1, 60), a - 5, a]), rng.randrange(30), rng.choice([None, *range(6)])))
    cs += cs[:40]
    qs = [(f"q{i}", rng.choice(["s", "t", None]), "k", rng.choice("pq"), stamp(), rng.randrange(-2, 32)) for i in range(200)] + [("null", "s", "k", "p", None, 5)]
    schema = "id {}, source_id string, scope_key string, predicate string, {} bigint, {} bigint"
    c = spark.createDataFrame([(*x, "x") for x in cs], schema.format("bigint", "from_us", "to_us") + ", recorded_us bigint, ordinal bigint, _best string")
    q = spark.createDataFrame([(*x, "y") for x in qs], schema.format("string", "valid_us", "known_us") + ", _q string")
    keys = ["source_id", "scope_key", "predicate"]
    got = {r.question: r.claim for r in asof.as_of_join(q, c, keys, hot_rows).collect()}
    want = {x[0]: b[3] for x in qs if (b := best_claim(x, cs))}
    assert got == want
    assert asof.as_of_join(q.limit(0), c, keys).count() == asof.as_of_join(q, c.limit(0), keys).count() == 0


@pytest.mark.parametrize("known", [None, 20, -1])
def test_regions_hold_the_current_claim_everywhere(spark, known):
    rng = random.Random(6)
    cs = []
    for i in range(160):
        a = rng.choice([rng.randrange(50), rng.randrange(3 * asof.HOUR_US)])
        cs.append((i, rng.choice(["s", "t", None]), "k", "p", rng.choice([a, a, None]), rng.choice([None, a + rng.randrange(1, 60), a + rng.randrange(1, 5 * asof.HOUR_US), a]) if i % 9 else a + 7, rng.randrange(40), rng.choice([None, *range(6)])))
    cs += cs[:20]
    c = spark.createDataFrame(cs, "id bigint, source_id string, scope_key string, predicate string, from_us bigint, to_us bigint, recorded_us bigint, ordinal bigint")
    keys = ["source_id", "scope_key", "predicate"]
    regions = asof.current_regions(c, keys, known).collect()
    bounds = sorted({x for r in cs for x in r[4:6] if x is not None})
    for source in "st":
        own = sorted((r.from_us, r.to_us or 2**62, r.claim) for r in regions if r.source_id == source)
        assert all(b[0] > a[1] or (b[0] == a[1] and b[2] != a[2]) for a, b in zip(own, own[1:]))  # disjoint, and none continues the one before
        for valid in [x + d for x in bounds for d in (-1, 0, 1)]:
            want = best_claim(("q", source, "k", "p", valid, 99 if known is None else known), cs)
            assert [c for a, b, c in own if a <= valid < b] == ([want[3]] if want else [])
    assert asof.current_regions(c.limit(0), keys).count() == 0


def test_covering_pairs_against_brute_force(spark):
    rng = random.Random(8)
    hour = asof.HOUR_US
    stamp = lambda: rng.choice([rng.randrange(-hour, 9 * hour), rng.randrange(9) * hour])
    spans = [(i, rng.choice(["a", "b", None]), x, rng.choice([None, x + rng.randrange(-2, 4 * hour), x + rng.randrange(1, 50)])) for i in range(120) for x in [stamp()]] + [(500, "a", None, 5)]
    points = [(i, rng.choice(["a", "b", None]), rng.choice([stamp(), spans[i][2], None])) for i in range(100)]
    p, s = spark.createDataFrame(points, "pid int, k string, at bigint"), spark.createDataFrame(spans, "sid int, k string, lo bigint, hi bigint")
    got = sorted((r.pid, r.sid) for r in asof.covering(p, s, ["k"], "at", "lo", "hi").collect())
    assert got == sorted((i, j) for i, k, at in points for j, kk, lo, hi in spans if k == kk and k and at is not None and lo is not None and lo <= at and (hi is None or at < hi))


def replay(rows):
    """State machine over the feed: the plain reading of the rules."""
    by = defaultdict(dict)
    for seq, pk, ext, rev, op, pol, ordinal in sorted(rows, key=lambda r: r[0]):
        if op in ("upsert", "delete", "policy_change"):
            by[pk, ext].setdefault(seq if ordinal is None else ordinal, (op, rev, pol))
    out = {}
    for key, steps in by.items():
        alive, ever, rev, pol = False, False, None, ""
        for o in sorted(steps):
            op, r, p = steps[o]
            if op == "policy_change":
                pol = p if p is not None else pol
            elif op == "delete":
                alive = False
            elif alive or not ever or r != rev:
                alive, ever, rev, pol = True, True, r, p if p is not None else pol
        out[key] = (rev, pol, alive)
    return out


@pytest.mark.parametrize("seed,chunk", [(1, 1 << 16), (2, 3), (3, 1)])
def test_change_feed_against_state_machine(spark, seed, chunk):
    rng = random.Random(seed)
    rows = []
    for a in range(40):
        ordered = rng.random() < 0.6
        for i in range(rng.randrange(1, 25)):
            op = rng.choice(["upsert"] * 4 + ["delete", "policy_change", "unknown"])
            rows.append([0, rng.choice(["w", None]) if a % 9 == 0 else "w", f"x{a}", rng.choice(["r1", "r2", "r3", None]) if op == "upsert" else None, op, rng.choice([None, "p1", "p2"]), i if ordered else None])
            if rng.random() < 0.2:
                rows.append(list(rows[-1]))
    rng.shuffle(rows)
    for i, r in enumerate(rows):
        r[0] = i
    # equal ordinals must repeat the same change
    feed = [(r[0], (r[1], None, r[2], r[3]), r[4], r[5], ("f", None, r[6]), "extra") for r in rows]
    df = spark.createDataFrame(feed, "seq bigint, ref struct<partition_key:string,artifact_kind:string,external_id:string,provider_revision:string>, operation string, policy_id string, provider_order struct<adapter:string,kind:string,ordinal:bigint>, o string")
    got = {(r.partition_key, r.external_id): (r.provider_revision, r.policy_id, r.is_alive) for r in change_feed.artifact_states(df, chunk).collect()}
    assert got == replay([tuple(r) for r in rows])
    assert change_feed.alive_artifacts(df.limit(0), chunk).count() == 0


def sweep(rows):
    by = defaultdict(list)
    for k, lo, hi in rows:
        if lo is not None and (hi is None or hi > lo):
            by[k].append((lo, float("inf") if hi is None else hi))
    out = set()
    for k, spans in by.items():
        merged = []
        for lo, hi in sorted(spans):
            if merged and lo <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], hi)
            else:
                merged.append([lo, hi])
        out |= {(k, "period", a, None if b == float("inf") else b) for a, b in merged} | {(k, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])}
    return out


@pytest.mark.parametrize("hot_rows", [200_000, 10, 0])
def test_intervals_against_sweep(spark, hot_rows):
    rng = random.Random(hot_rows)
    cell = intervals.CELL
    rows = []
    for i in range(400):
        lo = rng.choice([rng.randrange(-3 * cell, 6 * cell), rng.randrange(-3, 6) * cell, rng.randrange(20), None])
        hi = None if lo is None or rng.random() < 0.03 else rng.choice([lo + rng.randrange(1, 5), lo + rng.randrange(4 * cell), lo + cell, lo, lo - 9])
        rows.append((rng.choice(["a", "b", "c", "d", None]), lo, hi))
    rows += rows[:50]
    df = spark.createDataFrame([(*r, 1) for r in rows], "k string, lo bigint, hi bigint, _cell int")
    out = [tuple(r) for r in intervals.periods_and_gaps(df, ["k"], hot_rows).collect()]
    assert len(out) == len(set(out)) and set(out) == sweep(rows)
    assert intervals.periods_and_gaps(df.limit(0), ["k"], hot_rows).count() == 0


def test_dyadic_blocks_tile_exactly(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(0, 257), rng.randrange(0, 257)) for _ in range(200)] + [(0, 256), (7, 7)]
    rows = spark.createDataFrame(pairs, "lo bigint, hi bigint").select("lo", "hi", canonical_blocks(F.col("lo"), F.col("hi"), 8).alias("b")).collect()
    for r in rows:
        covered = sorted(x for b in r.b for x in range(b.block << b.level, (b.block + 1) << b.level))
        assert covered == list(range(r.lo, r.hi)) and len(r.b) <= 16
    g, lo, hi = dyadic_union(np.array([0, 0, 1, 1]), np.array([0, 3, 1, 5]), np.array([3, 8, 2, 5]), 3)
    assert list(zip(g.tolist(), lo.tolist(), hi.tolist())) == [(0, 0, 8), (1, 1, 2)]
