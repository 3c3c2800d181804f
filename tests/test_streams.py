"""Streams: repeats, reordering and restarts leave the state as it is."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from marlstone.operators import late_events
from marlstone.streaming import feed, late_counts

SCHEMA = "event_id bigint, source_id string, content_hash string, valid_from timestamp, recorded_from timestamp"
T0 = datetime(2024, 5, 1, tzinfo=timezone.utc)


def batches():
    first = [(1, "s", "h", T0, T0 + timedelta(days=9)), (2, "s", None, T0, T0 + timedelta(hours=1))]
    second = [(3, "s", "h", T0, T0 + timedelta(days=1, hours=2)), (2, "s", None, T0, T0 + timedelta(hours=1))]
    return first, second


def test_late_counts_stream(spark, tmp_path):
    first, second = batches()
    source = str(tmp_path / "in")
    state, marks, counts = str(tmp_path / "state"), str(tmp_path / "marks"), str(tmp_path / "counts")
    for rows in (first, second, first):  # the last one is delivered again
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        late_counts.start(spark.readStream.schema(SCHEMA).parquet(source), state, marks).awaitTermination()
        late_counts.publish(spark, state, counts)
    whole = late_events.merge_cells(late_events.delivered_cells(spark.createDataFrame(first + second, SCHEMA)))
    want = late_events.read_counters(late_events.counters(whole, 1))
    got = late_counts.read(spark, counts)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.first().n_corrections == 1 and got.first().n_too_late == 0
    late_counts.compact(spark, state, str(tmp_path / "compact"))
    late_counts.publish(spark, str(tmp_path / "compact"), str(tmp_path / "again"))
    assert sorted(map(tuple, late_counts.read(spark, str(tmp_path / "again")).collect())) == sorted(map(tuple, want.collect()))


def test_windowed_form_runs(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame(batches()[0], SCHEMA).coalesce(1).write.parquet(source)
    out = late_counts.windowed_counts(spark.readStream.schema(SCHEMA).parquet(source))
    query = out.writeStream.format("memory").queryName("windowed").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("windowed").agg(F.sum("n")).first()[0] == 2


def test_feed_log_overwrites_repeated_batches(spark, tmp_path):
    schema = "seq bigint, partition_key string, external_id string, provider_revision string, operation string, policy_id string, ordinal bigint"
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    for rows in ([(1, "w", "a", "r1", "upsert", "p", None), (2, "w", "b", "r1", "upsert", None, None)], [(3, "w", "b", None, "delete", None, None), (4, "w", "b", "r1", "upsert", None, None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        feed.start(spark.readStream.schema(schema).parquet(source), log, str(tmp_path / "marks")).awaitTermination()
    assert [tuple(r) for r in feed.current_state(spark, log).collect()] == [("w", "a", "r1", "p")]


def test_paged_source_streams_every_page_once(spark, tmp_path):
    from marlstone.sources import change_pages

    change_pages.register(spark)
    whole = spark.read.parquet("/root/testdata/sf0.001/changes.parquet").coalesce(1)
    path, log, marks = str(tmp_path / "pages"), str(tmp_path / "log"), str(tmp_path / "marks")
    for low, high in ((0, 3), (3, 10**9)):
        whole.where((F.col("page_no") >= low) & (F.col("page_no") < high)).write.mode("append").parquet(path)
        feed.start(spark.readStream.format("change_pages").option("path", path).option("pages_per_task", 2).load(), log, marks).awaitTermination()
    got = spark.read.parquet(log)
    assert got.count() == whole.count() == got.select("seq").distinct().count()


CHANGES = "seq bigint, page_no bigint, ref struct<partition_key:string,artifact_kind:string,external_id:string,provider_revision:string>, operation string, policy_id string, provider_order struct<adapter:string,kind:string,ordinal:bigint>"


def change(seq, page, external_id, operation="upsert"):
    return seq, page, ("w", "doc", external_id, "r1"), operation, "p", ("a", "k", seq)


def test_paged_feed_takes_tasks_by_row_groups(spark, tmp_path):
    from marlstone.plans import evidence_queries
    from marlstone.sources import change_pages

    rows = [change(1, 1, "a"), change(2, 1_000_000, "b"), change(3, None, "c"), change(4, -3, "d", "delete"), (5, 7, None, "upsert", None, None)]
    spark.createDataFrame(rows, CHANGES).coalesce(1).write.parquet(f"{tmp_path}/changes.parquet")
    change_pages.register(spark)
    pages = spark.read.format("change_pages").option("path", f"{tmp_path}/changes.parquet").load()
    assert pages.rdd.getNumPartitions() == 1
    assert sorted(tuple(r) for r in pages.collect())[2:4] == [(3, None, "w", "c", "r1", "upsert", "p", 3), (4, -3, "w", "d", "r1", "delete", "p", 4)]
    got = evidence_queries.paged_feed(spark, str(tmp_path)).collect()
    assert {(r.partition_key, r.operation): r.n for r in got} == {("w", "upsert"): 3, ("w", "delete"): 1, (None, "upsert"): 1}


def test_stream_state_takes_rows_of_any_page(spark, tmp_path):
    from marlstone.plans import evidence_queries

    first = [change(1, 2, "a"), change(2, 1_000_000, "b"), change(3, None, "c"), change(4, -3, "d")]
    spark.createDataFrame(first, CHANGES).coalesce(1).write.parquet(f"{tmp_path}/changes.parquet")
    got = evidence_queries.stream_final_state(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [("w", name, "r1", "p") for name in "abcd"]
    spark.createDataFrame([], CHANGES).write.parquet(f"{tmp_path}/none/changes.parquet")
    assert evidence_queries.stream_final_state(spark, f"{tmp_path}/none").isEmpty()


def test_paged_source_goes_on_after_pages_without_number(spark, tmp_path):
    from marlstone.sources import change_pages

    change_pages.register(spark)
    path, log, marks = str(tmp_path / "pages"), str(tmp_path / "log"), str(tmp_path / "marks")
    for rows in ([change(1, None, "a")], [change(2, 5, "b"), change(3, -3, "c")], [change(4, 9, "a", "delete")]):
        spark.createDataFrame(rows, CHANGES).coalesce(1).write.mode("append").parquet(path)
        feed.start(spark.readStream.format("change_pages").option("path", path).load(), log, marks).awaitTermination()
    assert sorted((r.seq, r.batch) for r in spark.read.parquet(log).collect()) == [(1, 0), (2, 1), (3, 1), (4, 2)]


def test_large_row_group_is_dealt_to_tasks(monkeypatch):
    from marlstone.sources import change_pages

    path = "/root/testdata/sf0.01/changes.parquet"
    read = lambda low, high: [[r for b in change_pages._batches(*p.value) for r in b.to_pylist()] for p in change_pages._partitions(path, None, low, high)]
    for low, high in ((None, None), (change_pages._START, 30), (7, 31)):
        monkeypatch.setattr(change_pages, "_CUT_ROWS", 1 << 18)
        (whole,) = read(low, high)
        monkeypatch.setattr(change_pages, "_CUT_ROWS", 700)
        parts = read(low, high)
        assert len(parts) == 3 and whole and sum(parts, []) == whole
        assert {r["page_no"] for r in whole} == set(range(max(low or 1, 1), high or 51))
