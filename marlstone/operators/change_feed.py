"""Current state of a table from a repeated, out-of-order feed of upserts, deletes and policy changes. SQL only.

Column-wise last writer wins: each field is the ``max_by`` over the changes that set it and take effect. An upsert after a
delete with the revision held before takes no effect, so upserts fall into runs of one revision: the first of a run always
takes effect, later ones as long as no delete lies between the start of their run and them.

That takes one shuffle by artifact. If an artifact has very many changes, what a row needs to know of earlier rows is
carried from chunk to chunk of its order instead, so that it is spread over its chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Positions of one artifact's order that one task takes.
CHUNK = 1 << 16

_ROWS = """
SELECT partition_key, external_id, o, o DIV {chunk} AS chunk, c.operation AS operation, c.revision AS revision, c.policy AS policy
FROM (
  SELECT ref.partition_key AS partition_key, ref.external_id AS external_id,
         coalesce(provider_order.ordinal, seq) AS o,
         min(struct(seq, operation, ref.provider_revision AS revision, policy_id AS policy)) AS c
  FROM {changes}
  WHERE operation IN ('upsert', 'delete', 'policy_change')
  GROUP BY 1, 2, 3
)
"""

_HELD = """
SELECT *, last(IF(operation = 'upsert', struct(revision), NULL), true) OVER (
  PARTITION BY partition_key, external_id, chunk ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held
FROM {rows}
"""

_HELD_BEFORE = """
SELECT partition_key, external_id, chunk, last(held, true) OVER (
  PARTITION BY partition_key, external_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held_before
FROM (
  SELECT partition_key, external_id, chunk, max_by(struct(revision), o) FILTER (WHERE operation = 'upsert') AS held
  FROM {rows} GROUP BY 1, 2, 3
)
"""

_RUNS = """
SELECT r.partition_key, r.external_id, r.chunk, r.o, r.operation, r.revision, r.policy,
       IF(r.operation = 'upsert' AND (coalesce(r.held, c.held_before) IS NULL
          OR NOT coalesce(r.held, c.held_before).revision <=> r.revision), r.o, NULL) AS run_at,
       IF(r.operation = 'delete', r.o, NULL) AS delete_at
FROM {held} r JOIN {before} c
  ON r.partition_key <=> c.partition_key AND r.external_id <=> c.external_id AND r.chunk = c.chunk
"""

_LAST_BEFORE = """
SELECT partition_key, external_id, chunk,
       max(run_at) OVER w AS run_before, max(delete_at) OVER w AS delete_before
FROM (
  SELECT partition_key, external_id, chunk, max(run_at) AS run_at, max(delete_at) AS delete_at
  FROM {runs} GROUP BY 1, 2, 3
)
WINDOW w AS (PARTITION BY partition_key, external_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
"""

_STATE = """
SELECT partition_key, external_id,
       max_by(revision, o) FILTER (WHERE operation = 'upsert') AS provider_revision,
       coalesce(max_by(policy, o) FILTER (WHERE policy IS NOT NULL AND (operation = 'policy_change' OR effective)), '') AS policy_id,
       max(run_at) AS run_at, max(delete_at) AS delete_at
FROM (
  SELECT r.*, r.operation = 'upsert' AND coalesce(greatest(b.delete_before, max(r.delete_at) OVER w), {floor})
            < greatest(b.run_before, max(r.run_at) OVER w) AS effective
  FROM {runs} r JOIN {before} b
    ON r.partition_key <=> b.partition_key AND r.external_id <=> b.external_id AND r.chunk = b.chunk
  WINDOW w AS (PARTITION BY r.partition_key, r.external_id, r.chunk ORDER BY r.o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
GROUP BY 1, 2
"""

_FLOOR = "(-9223372036854775807L)"

_CROWDED = """
SELECT 1 FROM {changes} GROUP BY ref.partition_key, ref.external_id HAVING count(*) > {chunk} LIMIT 1
"""

_STATE_AT_ONCE = """
WITH placed AS (
  SELECT partition_key, external_id, operation, revision, policy, o, lag(o) OVER (PARTITION BY partition_key, external_id ORDER BY o, seq) AS o_before
  FROM (
    SELECT ref.partition_key AS partition_key, ref.external_id AS external_id, operation, ref.provider_revision AS revision, policy_id AS policy,
           coalesce(provider_order.ordinal, seq) AS o, seq
    FROM {changes} WHERE operation IN ('upsert', 'delete', 'policy_change')
  )
), kept AS (
  SELECT *, last(IF(operation = 'upsert', struct(revision), NULL), true) OVER (
    PARTITION BY partition_key, external_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held
  FROM placed WHERE o_before IS NULL OR o_before <> o
), runs AS (
  SELECT partition_key, external_id, operation, revision, policy, o,
         IF(operation = 'upsert' AND (held IS NULL OR NOT held.revision <=> revision), o, NULL) AS run_at, IF(operation = 'delete', o, NULL) AS delete_at
  FROM kept
), marked AS (
  SELECT *, operation = 'upsert' AND coalesce(max(delete_at) OVER w, {floor}) < max(run_at) OVER w AS effective
  FROM runs WINDOW w AS (PARTITION BY partition_key, external_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
SELECT partition_key, external_id,
       max_by(revision, o) FILTER (WHERE operation = 'upsert') AS provider_revision,
       coalesce(max_by(policy, o) FILTER (WHERE policy IS NOT NULL AND (operation = 'policy_change' OR effective)), '') AS policy_id,
       max(run_at) AS run_at, max(delete_at) AS delete_at
FROM marked GROUP BY 1, 2
"""


def artifact_states(changes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per artifact with its last revision and policy, and whether it is alive (``is_alive``).

    Changes take effect by ordinal, or by ``seq`` where there is none; of several changes at one position the first to arrive
    counts, so repeats do nothing. A null revision is a value like any other; a null policy sets nothing. Unknown or null
    operations are ignored. Artifacts are compared null-safely. An empty feed gives an empty table.
    """
    spark = changes.sparkSession
    feed = changes.select("seq", "ref", "operation", "policy_id", "provider_order")
    if spark.sql(_CROWDED.replace("{chunk}", str(int(chunk))), changes=feed).isEmpty():
        state = spark.sql(_STATE_AT_ONCE.replace("{floor}", _FLOOR), changes=feed)
    else:
        rows = spark.sql(_ROWS.replace("{chunk}", str(int(chunk))), changes=feed)
        runs = spark.sql(_RUNS, held=spark.sql(_HELD, rows=rows), before=spark.sql(_HELD_BEFORE, rows=rows))
        state = spark.sql(_STATE.replace("{floor}", _FLOOR), runs=runs, before=spark.sql(_LAST_BEFORE, runs=runs))
    return spark.sql(
        f"SELECT partition_key, external_id, provider_revision, policy_id, run_at IS NOT NULL AND run_at > coalesce(delete_at, {_FLOOR}) AS is_alive FROM {{state}}",
        state=state,
    )


def alive_artifacts(changes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The artifacts alive at the end of the feed with their revision and policy ('' where none was set)."""
    return artifact_states(changes, chunk).where("is_alive").drop("is_alive")
