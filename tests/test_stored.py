"""Stored tables after repeated, restarted and half-finished writes."""

import os

import pytest
from pyspark.sql import functions as F

from lectern.sources.stored import Added, InsertOnly, KeyedTable, read_generations, replace_partitions
from lectern.streaming import live


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.startswith("part-")}


def test_appends_count_once(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "book int, sequence int, x string, order int")
    sink = InsertOnly(spark, str(tmp_path / "s"), rows((1, 1, "", 1)).drop("order").schema, ["book", "sequence"])
    assert sink.read().count() == 0
    assert sink.append(rows((1, 1, "b", 2), (1, 1, "a", 1), (1, 2, "c", 3)), "t1") == 2
    assert sink.append(rows((1, 1, "z", 0)), "t1") == -1  # the same job, tried again
    half = tmp_path / "s" / "data" / "t2"  # a try that died before its commit
    rows((1, 9, "lost", 1)).drop("order").write.parquet(str(half))
    os.remove(half / "_SUCCESS")
    assert sink.read().count() == 2
    assert sink.append(rows((1, 2, "d", 1), (2, 1, "e", 1)), "t2") == 1
    assert sink.append(rows((1, 2, "d", 1), (2, 1, "e", 1)), "t3") == 0  # the same rows under another token
    assert sorted(map(tuple, sink.read().collect())) == [(1, 1, "a"), (1, 2, "c"), (2, 1, "e")]


def test_other_books_are_untouched(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "book int, title string")
    replace_partitions(rows, path, "book")
    before = files(f"{path}/book=2")
    for _ in range(2):
        replace_partitions(rows.where("book = 1").limit(1).withColumn("title", F.lit("new")), path, "book")
    assert files(f"{path}/book=2") == before
    assert sorted((r.book, r.title) for r in spark.read.parquet(path).collect()) == [(1, "new"), (2, "c")]


def test_keyed_table(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "k int, v string, t int")
    kept = KeyedTable(spark, str(tmp_path / "k"), rows((1, "", 1)).schema, ["k"], ["t"], buckets=4)
    assert kept.read().count() == 0
    kept.upsert(rows((1, "a", 1), (2, "b", 5), (2, "old", 4)), 0)
    kept.upsert(rows((2, "late", 3), (3, "c", 1)), 1)
    want = [(1, "a", 1), (2, "b", 5), (3, "c", 1)]
    for _ in range(2):  # a batch applied again, and by a new process
        kept = KeyedTable(spark, str(tmp_path / "k"), kept.schema, ["k"], ["t"], buckets=4)
        kept.upsert(rows((9, "never", 9)), 1)
        assert sorted(map(tuple, kept.read().collect())) == want
    died = f"{tmp_path}/k/data/v2/bucket=0"  # a version that died before its manifest
    rows((7, "lost", 1)).write.parquet(died)
    assert sorted(map(tuple, kept.read().collect())) == want
    kept.upsert(rows((1, "x", 0)).limit(0), 2)
    kept.upsert(rows((1, "new", 2)), 3)
    kept.upsert(rows((1, "newer", 3)), 4)
    assert sorted(map(tuple, kept.read().collect())) == [(1, "newer", 3), (2, "b", 5), (3, "c", 1)]
    assert kept.versions() == [3, 4] and sorted(os.listdir(tmp_path / "k" / "data"))[-1] == "v4" and "v2" not in os.listdir(tmp_path / "k" / "data")


def test_stream_restarts(spark, tmp_path):
    """A stream that is run again with more files goes on; the table is the same as from one run."""
    events = spark.range(300).selectExpr("id AS event_id", "cast(id % 7 AS int) AS k", "timestamp_seconds(1700000000 + id * 60) AS ts")
    stream = live.replayed(events, 3, "arrival")
    folder = str(tmp_path / "run")
    kept = live.upserted(stream.drop("arrival"), ["k"], ["ts", "event_id"], folder, 4)
    first = sorted(map(tuple, kept.read().select("k", "event_id").collect()))
    assert first == [(k, max(i for i in range(300) if i % 7 == k)) for k in range(7)]
    versions = kept.versions()
    assert versions[-1] >= 3  # several batches
    again = live.upserted(stream.drop("arrival"), ["k"], ["ts", "event_id"], folder, 4)
    assert sorted(map(tuple, again.read().select("k", "event_id").collect())) == first and again.versions() == versions


def test_generations(spark, tmp_path):
    path = str(tmp_path / "g")
    spark.createDataFrame([(1,)], "id int").write.parquet(f"{path}/generation=1")
    spark.createDataFrame([(2, None, 5), (3, "x", 6)], "id int, note string, n int").write.parquet(f"{path}/generation=2")
    got = {r.id: (r.note, r.n, r.extra) for r in read_generations(spark, path, [Added("note", "string", 2, "old"), Added("n", "int", 2, 0, True), Added("extra", "double", 3, 1.5)]).collect()}
    assert got == {1: ("old", 0, 1.5), 2: (None, 5, 1.5), 3: ("x", 6, 1.5)}
    with pytest.raises(ValueError, match="no default"):
        read_generations(spark, path, [Added("n", "int", 2, None, True)])
    with pytest.raises(Exception, match="note is required"):
        read_generations(spark, path, [Added("note", "string", 2, "old", True)]).collect()


def test_late_beats_are_dropped(spark):
    """Of the replay some beats come too late for their window, and only these are missing."""
    events = spark.range(2000).selectExpr("id AS event_id", "cast(id % 5 AS int) AS worker", "timestamp_seconds(1700000000 + id * 900) AS ts")
    stream = live.replayed(events, 6, "arrival")
    rows = live.kept_updates(live.heartbeat_windows(stream, "1 hour", "1 hour"), ["worker", "start"])
    arrived = 2000 + len(range(0, 2000, 11))
    counted = rows.agg(F.sum("n")).first()[0]
    assert 0.7 * arrived < counted < arrived


def test_changes_of_liveness(spark):
    """A worker that stops is seen dead by a timer; a beat that comes late, but within the delay, keeps it alive."""
    beats = [("a", m) for m in range(0, 600, 10)] + [("b", 0), ("b", 30), ("b", 300)]
    rows = spark.createDataFrame([(w, m, k) for k, (w, m) in enumerate(beats)], "worker string, m int, event_id long").selectExpr("worker", "timestamp_seconds(1700000000 + m * 60) AS ts", "event_id")
    changes = live.liveness_changes(live.replayed(rows, 5, "arrival"), 2400, "240 minutes")
    got = sorted((r.worker, (r.micros // 1_000_000 - 1700000000) // 60, r.alive) for r in live.kept_updates(changes, [], "append").collect())
    assert got == [("a", 0, True), ("b", 0, True), ("b", 70, False), ("b", 300, True), ("b", 340, False)]
