"""Ranking and traversal of graphs by joins. Edges are (src, dst, ...) rows; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.plans.skew import HOT_ROWS, hot_keys
from marlstone.session import checkpointed

DAMPING = 0.5
#: Rounds between two cuts of the lineage.
CUT = 6


def mirrored(edges: DataFrame) -> DataFrame:
    """Undirected (a, b, weight) as directed edges both ways; only positive weights walk."""
    some = edges.where("weight > 0 and a <> b")
    return some.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(some.select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))


def reset_vector(seeds: DataFrame) -> DataFrame:
    """Seeds (id, value) as a distribution: missing, NaN and negative values count 0; an empty or all-zero one has no rows."""
    clean = F.when(F.isnan("value") | (F.col("value") < 0), 0.0).otherwise(F.coalesce("value", F.lit(0.0)))
    summed = checkpointed(seeds.groupBy("id").agg(F.sum(clean).alias("value")).where("value > 0"))
    total = summed.agg(F.sum("value")).first()[0]
    return summed.select("id", (F.col("value") / F.lit(total or 1.0)).alias("p"))


def personalized_pagerank(edges: DataFrame, reset: DataFrame, damping: float = DAMPING, rounds: int = 24, whole: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Personalised PageRank: id, score.

    ``edges`` are directed and weighted (``mirrored``), ``reset`` is a distribution (id, p). A vertex without edges returns to the
    reset vector. Vertices that the walk cannot reach have no row, their score is 0; nor has a vertex further than ``rounds`` from the reset
    vector, but with ``whole``: then rounds go on until no vertex is newly reached.

    Only vertices of the reset vector can be dangling and hold weight, so what returns from them is one number, known
    beforehand. The rounds are Chebyshev's: each mixes the walk's step with the table before last, which on edges of the same weight both ways
    leaves about ``(damping / (1 + sqrt(1 - damping ** 2))) ** rounds``, at a damping of one half 0.27 a round instead of 0.5. On
    other edges they come to the same scores, but more slowly. A round is one join on the source and one combined sum. The edges of a
    vertex with more than ``hot_rows`` of them are laid out in several parts, which its rank is sent to.
    """
    edges = checkpointed(edges.select("src", "dst", "weight"))  # derived once, read by the counts and the layout
    strength = edges.groupBy("src").agg(F.sum("weight").alias("_all"))
    # the edges are laid out by source once; a round then moves ranks only
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hubs = checkpointed(hot_keys(edges, ["src"], hot_rows))  # at most edges / hot_rows vertices
    hub_less = hubs.isEmpty()
    keys = ["src"] if hub_less else ["src", "_lane"]  # without hubs the ranks keep the partitioning of their sum
    shares = edges.join(strength, "src").select("src", "dst", (F.col("weight") / F.col("_all")).alias("share"))
    # a vertex's edge to itself, without share, hands on what it held: so a round reads the ranks once
    reset = reset.select("id", "p")
    every = strength.select("src").unionByName(reset.select(F.col("id").alias("src"))).distinct()
    shares = shares.unionByName(every.select("src", F.col("src").alias("dst"), F.lit(None).cast("double").alias("share")))
    if not hub_less:
        lane = F.coalesce(F.pmod(F.xxhash64("dst"), F.col("_salts")).cast("int"), F.lit(0))
        shares = shares.join(F.broadcast(hubs), "src", "left").withColumn("_lane", lane).drop("_salts")
    walk = checkpointed(shares.repartition(parts, *keys))

    def in_lanes(rank: DataFrame) -> DataFrame:
        rank = rank.withColumnRenamed("id", "src")
        if hub_less:
            return rank
        salts = F.coalesce(F.col("_salts"), F.lit(1))
        return rank.join(F.broadcast(hubs), "src", "left").withColumn("_lane", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")

    total, lost = reset.join(walk.where("share is not null").select(F.col("src").alias("id"), F.lit(True).alias("_out")).distinct(), "id", "left").agg(
        F.coalesce(F.sum("p"), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("_out").isNull(), F.col("p"))), F.lit(0.0))
    ).first()
    if not total:
        raise ValueError("the reset vector sums to nothing")
    base = (1 - damping) / (1 - damping * lost)
    rank = reset.select("id", (F.col("p") * base).alias("score"), F.lit(0.0).alias("before"))
    omega, r, reached = 2.0, 0, None
    while r < rounds or whole:
        omega = 1.0 / (1.0 - damping**2 * omega / 4.0)
        own = F.col("share").isNull()
        moved = walk.join(in_lanes(rank), keys).select(
            F.col("dst").alias("id"), F.when(own, F.col("before") * (1.0 - omega)).otherwise(F.col("share") * F.col("score") * (omega * damping)).alias("score"), F.when(own, F.col("score")).otherwise(0.0).alias("before")
        )
        parts_of = moved.unionByName(reset.select("id", (F.col("p") * (omega * base)).alias("score"), F.lit(0.0).alias("before")))
        rank = parts_of.groupBy("id").agg(F.sum("score").alias("score"), F.sum("before").alias("before"))
        r += 1
        if r % CUT == 0:
            rank = checkpointed(rank)
            if whole and r + CUT >= rounds:
                last, reached = reached, rank.count()
                if last == reached and r >= rounds:
                    break
    return rank.select("id", "score")


def neighbours(edges: DataFrame, ids: list) -> DataFrame:
    """Edges that leave the given vertices; unknown ones give nothing."""
    return edges.where(F.col("src").isin(ids))


def bfs(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Vertices within ``depth`` steps of the seeds (id): id, hops. One join and one anti-join per step."""
    seen = seeds.select("id").distinct().withColumn("hops", F.lit(0))
    frontier = seen.select("id")
    for hop in range(1, depth + 1):
        step = edges.join(frontier, edges["src"] == frontier["id"], "left_semi").select(F.col("dst").alias("id")).distinct()
        frontier = checkpointed(step.join(seen.select("id"), "id", "left_anti"))
        seen = seen.unionByName(frontier.withColumn("hops", F.lit(hop)))
    return seen


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int, limit: int) -> DataFrame:
    """Up to ``limit`` vertices around the seeds, near ones first, then those on heavier edges, then by id: id, hops, weight."""
    depth = max(0, min(depth, 3))
    found = bfs(edges, seeds, depth)
    a, b = found.alias("a"), found.alias("b")
    inward = edges.join(a, F.col("dst") == F.col("a.id")).join(b, (F.col("src") == F.col("b.id")) & (F.col("b.hops") == F.col("a.hops") - 1))
    weight = inward.groupBy(F.col("a.id").alias("id")).agg(F.max("weight").alias("weight"))
    return found.join(weight, "id", "left").orderBy("hops", F.desc_nulls_last("weight"), "id").limit(limit)


def walkable(edges: DataFrame, theta: float, not_a_step: tuple[str, ...] = ("CONTAINS",)) -> DataFrame:
    """Edges a path may take: kinds that are steps, with omega of at least theta."""
    return edges.where(~F.col("kind").isin(*not_a_step) & (F.col("omega") >= theta))


def shortest_path(edges: DataFrame, start, goal, hops: int = 6, budget: int = 5000) -> DataFrame:
    """The first shortest path in the order (kind, dst, src) of its edges: one row with ``path`` and ``kinds``, or none.

    Breadth first; every vertex is reached once, by the first edge in order; after ``budget`` vertices the search ends.
    """
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    seen = spark.createDataFrame([(start,)], f"id {kind}").select("id", F.array("id").alias("path"), F.array().cast("array<string>").alias("kinds"))
    frontier = seen
    for _ in range(hops):
        met = edges.alias("e").join(frontier.alias("f"), F.col("e.src") == F.col("f.id")).select(
            F.col("e.dst").alias("id"), F.struct(F.col("e.kind").alias("kind"), F.col("e.dst").alias("dst"), F.col("e.src").alias("src"), F.col("f.path").alias("path"), F.col("f.kinds").alias("kinds")).alias("via")
        )
        fresh = met.join(seen.select("id"), "id", "left_anti").groupBy("id").agg(F.min("via").alias("via"))
        frontier = checkpointed(fresh.select("id", F.concat("via.path", F.array("id")).alias("path"), F.concat("via.kinds", F.array("via.kind")).alias("kinds")))
        seen = seen.unionByName(frontier)
        done = frontier.where(F.col("id") == F.lit(goal))
        counts = frontier.agg(F.count(F.lit(1)), F.count_if(F.col("id") == F.lit(goal))).first()
        if counts[1]:
            return done.select("path", "kinds")
        budget -= counts[0]
        if not counts[0] or budget <= 0:
            break
    return seen.where(F.col("id") == F.lit(goal)).where(F.lit(start == goal)).select("path", "kinds")


def blast_radius(edges: DataFrame, seeds: DataFrame, depth: int = 2, cap: int = 200) -> DataFrame:
    """What depends on the seeds within ``depth`` steps against the edges: id, hops, truncated (more than ``cap`` were there)."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = checkpointed(bfs(back, seeds, depth).where("hops > 0"))
    total = found.count()
    return found.orderBy("hops", "id").limit(cap).withColumn("truncated", F.lit(total > cap))


def induced_edges(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with both ends among the vertices (id)."""
    v = vertices.select("id").distinct()
    return edges.join(v.withColumnRenamed("id", "src"), "src", "left_semi").join(v.withColumnRenamed("id", "dst"), "dst", "left_semi")


def label_communities(edges: DataFrame, rounds: int = 4) -> DataFrame:
    """Communities by synchronous label propagation: id, community (the least member).

    In a round a vertex takes the label with the greatest weight among itself (weight of its heaviest edge) and its neighbours, the least
    of equals. This stands in for modularity optimisation; only the numbering by the least member is the same.
    """
    edges = checkpointed(edges.select("src", "dst", "weight"))
    own = edges.groupBy(F.col("src").alias("id")).agg(F.max("weight").alias("weight"))
    labels = own.select("id", F.col("id").alias("label"))
    for _ in range(rounds):
        heard = edges.join(labels, edges["dst"] == labels["id"]).select(F.col("src").alias("id"), "label", "weight")
        kept = labels.join(own, "id").select("id", "label", "weight")
        weighed = heard.unionByName(kept).groupBy("id", "label").agg(F.sum("weight").alias("weight"))
        best = weighed.groupBy("id").agg(F.min(F.struct((-F.round("weight", 9)).alias("w"), "label")).alias("_b"))
        labels = checkpointed(best.select("id", F.col("_b.label").alias("label")))
    least = labels.groupBy("label").agg(F.min("id").alias("community"))
    return labels.join(least, "label").select("id", "community")


def numbered_communities(members: DataFrame, name: str = "name") -> DataFrame:
    """Communities numbered from 0 by their least name, with that name as label: community, number, label."""
    least = members.groupBy("community").agg(F.min(name).alias("label"))
    return least.withColumn("number", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("label")) - 1)


def cross_counts(edges: DataFrame, group_of: DataFrame) -> DataFrame:
    """Edges between groups (id, grp), counted per unordered pair: a, b, n."""
    x, y = group_of.select(F.col("id").alias("src"), F.col("grp").alias("ga")), group_of.select(F.col("id").alias("dst"), F.col("grp").alias("gb"))
    both = edges.join(x, "src").join(y, "dst").where("ga <> gb")
    return both.groupBy(F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def edited(edges: DataFrame, edits: DataFrame) -> DataFrame:
    """What-if weights: the last edit (a, b, weight, pos) of a pair replaces its weight, 0 removes it, new pairs are added."""
    last = edits.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max_by("weight", "pos").alias("edit"))
    both = edges.select("a", "b", "weight").join(last, ["a", "b"], "full")
    return both.select("a", "b", F.coalesce("edit", "weight").alias("weight")).where("weight > 0")


def by_degree(edges: DataFrame, limit: int) -> DataFrame:
    """The vertices to show first: by degree, then id; the limit is kept within 10..8000."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "id").limit(max(10, min(limit, 8000)))


def boosted(scores: DataFrame, community_of: DataFrame, seeds: DataFrame, boost: float) -> DataFrame:
    """Scores (id, score) times 1 + boost for members of a seed's community."""
    chosen = community_of.join(seeds.select("id"), "id", "left_semi").select("community").distinct().withColumn("_in", F.lit(True))
    near = community_of.join(chosen, "community").select("id", "_in")
    factor = F.when(F.col("_in"), 1 + boost).otherwise(1.0)
    return scores.join(near, "id", "left").select("id", (F.col("score") * factor).alias("score"))


def resolve_symbol(symbols: DataFrame, asked: str) -> DataFrame:
    """The symbols (id, name, qualname, display) of the best tier that match: id, display, qualname, dotted suffix, bare name.

    ``ambiguous`` where the tier has more than one."""
    def tier(c: Column, n: int) -> Column:
        return F.when(c, n)

    t = F.coalesce(
        tier(F.col("id") == asked, 0), tier(F.col("display") == asked, 1), tier(F.col("qualname") == asked, 2),
        tier(F.endswith("qualname", F.lit("." + asked)), 3), tier(F.col("name") == asked, 4),
    )
    hits = symbols.withColumn("tier", t).where("tier is not null")
    best = hits.groupBy("tier").agg(F.collect_list("id").alias("ids"), F.count(F.lit(1)).alias("n")).orderBy("tier").limit(1)
    return best.select("tier", F.array_sort("ids").alias("ids"), (F.col("n") > 1).alias("ambiguous"))
