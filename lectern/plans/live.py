"""Streaming queries over events; SQL is that of the batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.plans.text import table
from lectern.streaming import live


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = live.read(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events").schema)
    return stream.select(F.col("user_id").alias("book"), F.col("user_id").alias("worker"), (F.col("event_id") % 50).alias("sequence"), F.col("value").alias("position"), F.col("ts").cast("timestamp").alias("ts"), "event_id")


def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = live.kept_updates(live.latest_progress(_events(spark, sf_dir)), ["book"])
    return rows.select("book", "sequence", "position", F.unix_micros("ts").alias("at"))


def stream_liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = live.kept_updates(live.heartbeat_windows(_events(spark, sf_dir)), ["worker", "start"])
    return rows.select("worker", F.unix_micros("start").alias("start"), F.unix_micros("last_beat").alias("last_beat"), "n")


def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = live.kept_updates(live.first_arrivals(_events(spark, sf_dir), ["book", "sequence"], "1 hour"), [], "append")
    return rows.select("book", "sequence")


def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.kept_updates(live.running_counts(_events(spark, sf_dir), "book"), ["book"])


def stream_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress events that come in many batches, late and repeated, upserted into a keyed table by event time."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("book"), (F.col("event_id") % 50).alias("sequence"), F.col("value").alias("position"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    kept = live.upserted(live.replayed(events, 4, "arrival").drop("arrival"), ["book"], ["ts", "event_id"])
    return kept.read().select("book", "sequence", "position", F.unix_micros("ts").alias("at"))


#: Beats are late by two slices of the replay at most; the watermark waits for so many days.
SLICES, WAIT_DAYS = 6, 11


def stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each worker came alive and died, from beats that come in many batches, late and repeated; as far as the last watermark."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("worker"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    changes = live.liveness_changes(live.replayed(events, SLICES, "arrival"), 6 * 3600, f"{WAIT_DAYS} days")
    return live.kept_updates(changes, [], "append").select("worker", "micros", "alive")


CHANGES_SQL = f"""
WITH w AS (SELECT (epoch_ms(max(ts)) - {WAIT_DAYS} * 86400000) * 1000 AS now FROM events),
b AS (SELECT user_id AS worker, epoch_us(ts) AS beat, lag(epoch_us(ts)) OVER o AS before, lead(epoch_us(ts)) OVER o AS after FROM (SELECT DISTINCT user_id, ts FROM events) WINDOW o AS (PARTITION BY user_id ORDER BY ts))
SELECT worker, beat AS micros, true AS alive FROM b, w WHERE beat <= now AND (before IS NULL OR beat - before > 21600000000)
UNION ALL SELECT worker, beat + 21600000000, false FROM b, w WHERE beat + 21600000000 < now AND (after IS NULL OR after - beat > 21600000000)
"""


def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beats a day in many batches: the watermark moves, windows that it has passed are dropped, and beats that come for them are too."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("worker"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    rows = live.kept_updates(live.heartbeat_windows(live.replayed(events, SLICES, "arrival"), "1 day", "1 day"), ["worker", "start"])
    return rows.select("worker", F.unix_micros("start").alias("start"), F.unix_micros("last_beat").alias("last_beat"), "n")


#: A batch drops what is late by the watermark of the batch before it, which rests on all batches before that one.
LATE_SQL = f"""
WITH e AS (SELECT user_id AS worker, event_id, epoch_us(ts) AS t FROM events), m AS (SELECT min(t) AS low, greatest(1, (max(t) - min(t)) // {SLICES} + 1) AS width FROM e),
o AS (SELECT worker, event_id, t, ((t - low) // width)::INTEGER + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS own FROM e, m),
a AS (SELECT worker, t, own AS arrival FROM o UNION ALL SELECT worker, t, own + 1 FROM o WHERE event_id % 11 = 0),
k AS (SELECT arrival, row_number() OVER (ORDER BY arrival) AS batch, max(t) AS latest FROM a GROUP BY arrival),
w AS (SELECT k.arrival, max(before.latest) // 1000 - 86400000 AS mark FROM k LEFT JOIN k before ON before.batch < k.batch - 1 GROUP BY k.arrival),
s AS (SELECT worker, t, t // 86400000000 * 86400000000 AS start, coalesce(mark, 0) AS mark FROM a JOIN w USING (arrival))
SELECT worker, start, max(t) AS last_beat, count(*) AS n FROM s WHERE start // 1000 + 86400000 > mark GROUP BY worker, start
"""


QUERIES = {
    "stream_late": (stream_late, LATE_SQL),
    "stream_changes": (stream_changes, CHANGES_SQL),
    "stream_upserts": (stream_upserts, "SELECT user_id AS book, event_id % 50 AS sequence, value AS position, epoch_us(ts) AS at FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"),
    "stream_progress": (stream_progress, "SELECT user_id AS book, event_id % 50 AS sequence, value AS position, epoch_us(ts) AS at FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"),
    "stream_liveness": (stream_liveness, "SELECT user_id AS worker, (epoch_us(ts) // 120000000) * 120000000 AS start, max(epoch_us(ts)) AS last_beat, count(*) AS n FROM events GROUP BY 1, 2"),
    "stream_dedupe": (stream_dedupe, "SELECT DISTINCT user_id AS book, event_id % 50 AS sequence FROM events"),
    "stream_counts": (stream_counts, "SELECT user_id AS book, count(*) AS n_done FROM events GROUP BY 1"),
}
