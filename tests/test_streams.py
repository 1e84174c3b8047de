"""Replays are read by batch from the table itself; liveness is told by buckets of workers."""

import glob
import random
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from lectern.streaming import live


def test_a_replay_copies_no_rows(spark):
    """What is written for a replay is the number of a slice, a file each; slices without rows have none."""
    rows = spark.range(100).selectExpr("id AS event_id", "timestamp_seconds(1700000000 + if(id < 50, id, id + 900)) AS ts").repartition(3)
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(glob.glob(f"{folder}/stream-*/replay/*.parquet"))
    stream = live.replayed(rows, 5, "arrival")
    new = sorted(set(glob.glob(f"{folder}/stream-*/replay/*.parquet")) - before)
    written = spark.read.parquet(*new)
    assert written.columns == ["__slice"]
    got = live.kept_updates(stream, [], "append")
    assert got.columns == ["event_id", "ts", "arrival"] and got.count() == 100 + len(range(0, 100, 11))
    slices = {r.arrival for r in got.select("arrival").distinct().collect()}
    assert slices == {r["__slice"] for r in written.collect()} == {0, 1, 2, 4, 5, 6} and len(new) == 6


def test_an_empty_replay(spark):
    rows = spark.range(3).selectExpr("id AS event_id", "timestamp_seconds(1700000000 + id) AS ts")
    assert live.kept_updates(live.replayed(rows.where("event_id < 0"), 5, "arrival"), [], "append").count() == 0
    untimed = live.kept_updates(live.replayed(rows.withColumn("ts", F.lit(None).cast("timestamp")), 5, "arrival"), [], "append")
    assert untimed.count() == 0


def _alive_and_dead(beats, length, now):
    """(worker, when, alive) from all beats of each worker, up to now."""
    out = []
    for worker in {w for w, _ in beats}:
        own = sorted({t for w, t in beats if w == worker})
        for i, t in enumerate(own):
            if t <= now and (i == 0 or t - own[i - 1] > length):
                out.append((worker, t, True))
            if t + length < now and (i == len(own) - 1 or own[i + 1] - t > length):
                out.append((worker, t + length, False))
    return sorted(out, key=str)


class _State(SimpleNamespace):
    """A bucket's state as Spark's GroupState has it."""

    exists, get, due = False, None, None

    def getCurrentWatermarkMs(self):
        return self.now

    def update(self, new):
        self.exists, self.get = True, new

    def setTimeoutTimestamp(self, at):
        self.due = at

    def remove(self):
        self.exists = False


def test_changes_of_a_bucket_of_workers():
    """One call of a batch tells the changes of all workers of a bucket: null names, equal and late beats, gaps of just the length."""
    rng = random.Random(3)
    for _ in range(60):
        names, length = [None, "", "a", "b", "10", "ü"], 2
        beats = [(rng.choice(names), rng.randrange(60) * 1_000_000) for _ in range(rng.randrange(1, 60))]
        run, state, got, sent = live._transitions(length), _State(now=-1), [], 0
        waiting = sorted(beats, key=lambda b: b[1])
        while waiting or state.exists:
            now = min((b[1] for b in waiting), default=state.now * 1000 + 5_000_000)
            batch = [waiting.pop(rng.randrange(min(3, len(waiting)))) for _ in range(min(len(waiting), rng.randrange(1, 8)))]
            parts = [pd.DataFrame({"worker": [w for w, _ in b], "micros": [t for _, t in b]}) for b in (batch[:2], batch[2:]) if b]
            state.now = max(state.now, now // 1000 - 1)
            got += [(None if r.worker is None or r.worker != r.worker else r.worker, r.micros, r.alive) for part in run((0,), iter(parts), state) for r in part.itertuples()]
            sent += len(batch)
            assert sorted(got, key=str) == _alive_and_dead(beats, length * 1_000_000, state.now * 1000)
        assert sent == len(beats)


def test_changes_are_told_by_bucket(spark):
    """Calls are by bucket and not by worker; workers without a name, and of any type, are workers; beats without a time are none."""
    beats = [(w, t) for w in (None, 1, 2**62 + 1, 7) for t in (0, 10, 300)] + [(5, None)]
    rows = spark.createDataFrame([(w, t, k) for k, (w, t) in enumerate(beats)], "worker long, t int, event_id long").selectExpr("worker", "timestamp_seconds(1700000000 + t * 60) AS ts", "event_id")
    changes = live.liveness_changes(live.replayed(rows, 5, "arrival"), 2400, "240 minutes", buckets=2)
    got = [(r.worker, (r.micros // 1_000_000 - 1700000000) // 60, r.alive) for r in live.kept_updates(changes, [], "append").collect()]
    assert sorted(got, key=str) == sorted([(w, m, a) for w in (None, 1, 2**62 + 1, 7) for m, a in ((0, True), (50, False))], key=str)
