"""Row-level access: role ladder, visible sources and what remains of the graph within them, policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators import knowledge


def visible_sources(sources: DataFrame, user: str | None, rank: int, everything: bool = False) -> DataFrame:
    """Sources that are open to all, owned by the user or within the rank (a missing rank is 0)."""
    if everything:
        return sources
    return sources.where((F.col("owner_id") == F.lit(user)) | (F.coalesce("min_rank", F.lit(0)) <= rank))


def roles_within(roles: DataFrame, rank: int) -> DataFrame:
    return roles.where(F.col("rank") <= rank)


def set_source_ranks(sources: DataFrame, roles: DataFrame) -> DataFrame:
    """Sources with the rank of their role copied into ``min_rank``; sources without role keep theirs."""
    ranks = roles.select(F.col("id").alias("access_role_id"), F.col("rank").alias("_rank"))
    return sources.join(ranks, "access_role_id", "left").withColumn("min_rank", F.coalesce("_rank", "min_rank")).drop("_rank")


def scoped(facts: DataFrame, visible: DataFrame) -> dict[str, DataFrame]:
    """The graph of the visible sources: triples, mentions, passage counts and edges, all counted anew on what is visible."""
    t = knowledge.triples(facts.join(visible.select(F.col("id").alias("source_id")), "source_id", "left_semi"))
    m = knowledge.mentions(t)
    return {"triples": t, "mentions": m, "specificity": knowledge.node_specificity(m), "edges": knowledge.fact_edges(t)}


def supported(supports: DataFrame, visible: DataFrame) -> DataFrame:
    """Assertions with a support group whose every span is visible: AND inside a group, OR across groups.

    ``supports``: assertion_id, group_no, span_id; ``visible``: span_id.
    """
    marked = supports.join(visible.select("span_id").distinct().withColumn("_v", F.lit(True)), "span_id", "left")
    per_group = marked.groupBy("assertion_id", "group_no").agg(F.every(F.coalesce("_v", F.lit(False))).alias("whole"))
    return per_group.groupBy("assertion_id").agg(F.bool_or("whole").alias("is_supported"))


def evidence_closure(artifacts: DataFrame, revisions: DataFrame, spans: DataFrame, observations: DataFrame, assertions: DataFrame, supports: DataFrame, grants: DataFrame, suppressed: DataFrame) -> dict[str, DataFrame]:
    """What a principal may see, from artifacts down to assertions.

    Artifacts need a granted policy and no suppression; revisions and spans follow (a span needs its own policy too), observations
    follow their spans, objects their observations; an assertion needs both its objects and one whole support group.
    ``grants``: policy_id, valid_until. ``until`` of an artifact is its policy's deadline.
    """
    a = artifacts.join(grants, "policy_id").join(suppressed.select(F.col("id").alias("artifact_id")), "artifact_id", "left_anti")
    r = revisions.join(a.select("artifact_id", F.col("valid_until").alias("until")), "artifact_id")
    s = spans.join(grants.select("policy_id", "valid_until"), "policy_id").join(r.select("revision_id", "until"), "revision_id")
    s = s.withColumn("until", F.least("until", "valid_until")).drop("valid_until")
    o = observations.join(s.select("span_id"), "span_id", "left_semi")
    objects = o.select("object_id").distinct()
    ok = supported(supports, s).where("is_supported").select("assertion_id")
    c = assertions.join(ok, "assertion_id", "left_semi")
    for end in ("subject_id", "object_id"):
        c = c.join(objects.withColumnRenamed("object_id", "_o"), F.col(end) == F.col("_o"), "left_semi")
    return {"artifacts": a, "revisions": r, "spans": s, "observations": o, "objects": objects, "assertions": c}


def mapped_principals(policies: DataFrame, mapping: DataFrame) -> DataFrame:
    """Provider principals turned into our own, leaning to denial: policy_id, mode, allow, deny, n_dropped.

    ``policies``: policy_id, mode, allow, deny (arrays of provider names); ``mapping``: provider, principal. A deny entry without mapping makes
    the policy unknown, and so does an allow list that loses all entries; other unmapped allow entries are dropped and counted.
    """
    def mapped(column: str) -> DataFrame:
        rows = policies.select("policy_id", F.explode(column).alias("provider")).join(mapping, "provider", "left")
        return rows.groupBy("policy_id").agg(F.array_sort(F.collect_set("principal")).alias(f"_{column}"), F.count_if(F.col("principal").isNull()).alias(f"_{column}_lost"), F.count(F.lit(1)).alias(f"_{column}_all"))

    both = policies.join(mapped("allow"), "policy_id", "left").join(mapped("deny"), "policy_id", "left")
    lost = F.coalesce("_allow_lost", F.lit(0))
    unknown = (F.coalesce("_deny_lost", F.lit(0)) > 0) | ((lost > 0) & (lost == F.col("_allow_all")))
    none = F.array().cast("array<string>")
    return both.select("policy_id", F.when(unknown, "unknown").otherwise(F.col("mode")).alias("mode"), F.coalesce("_allow", none).alias("allow"), F.coalesce("_deny", none).alias("deny"), lost.alias("n_dropped"))


def policy_allows(principal: str, now: Column, max_age_us: int) -> Column:
    """Whether a policy row admits the principal now. Columns: mode, allow, deny, verified_us, expires_us.

    Unknown modes, verification in the future, and a missing or passed deadline deny; deny entries beat allow entries; mode ``workspace``
    needs no allow entry. A provider's verification lasts ``max_age_us`` at most.
    """
    deadline = F.when(F.col("mode") == "provider", F.least("expires_us", F.col("verified_us") + max_age_us)).otherwise(F.col("expires_us"))
    live = F.col("mode").isin("workspace", "provider", "list") & (F.col("verified_us") <= now) & (now < deadline)
    named = F.array_contains("allow", principal) | (F.col("mode") == "workspace")
    return F.coalesce(live & named & ~F.array_contains("deny", principal), F.lit(False))


def node_tiers(supports: DataFrame, ranks: DataFrame) -> DataFrame:
    """Least rank of the sources behind each node (id, source_id)."""
    return supports.join(ranks, "source_id").groupBy("id").agg(F.min("rank").alias("tier"))
