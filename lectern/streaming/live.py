"""Streaming forms of the state questions: updates are kept per key and batch, so that a repeated batch does no harm."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import StructType

from lectern.operators.state import latest
from lectern.sources.stored import KeyedTable


def scratch(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir, or one of our own where a local session has none; on a cluster without it this raises."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-lectern-")
    return f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"


def read(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 16) -> DataFrame:
    """A stream over a Parquet file or folder. As a pattern, since a streaming source takes a plain path to be a folder."""
    path = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def kept_updates(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """Runs a stream over what is there now and returns the last update of each key.

    Each batch writes its updates to a folder named by its id, overwriting what a failed try left.
    """
    folder = scratch(stream.sparkSession)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    keep(stream.sparkSession.createDataFrame([], stream.schema), -1)  # so that there is something to read where there was no batch
    rows = stream.sparkSession.read.schema(StructType([*stream.schema, *StructType().add("batch", "long")])).parquet(f"{folder}/out")
    return latest(rows, keys, [F.col("batch")]).drop("batch") if keys else rows.drop("batch")


def replayed(rows: DataFrame, slices: int, late: str) -> DataFrame:
    """A stream of rows that arrive in so many slices, one a batch: in order of ts, but every seventh row (by event_id) comes a slice late, and every eleventh twice.

    late names the column that gets the slice of a row's arrival. What streams is the slices' numbers, a file each; a batch takes its rows
    from the table by a broadcast of that number, so they are read on all cores and not copied. A slice without rows is no batch.
    """
    spark, folder = rows.sparkSession, f"{scratch(rows.sparkSession)}/replay"
    ends = rows.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).agg(F.min("t"), F.max("t")).first()
    width = max(1, ((ends[1] or 0) - (ends[0] or 0)) // slices + 1)
    own = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - (ends[0] or 0)) / width).cast("int")
    own = own + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)
    arrived = rows.withColumn(late, F.explode(F.when(F.col("event_id") % 11 == 0, F.array(own, own + 1)).otherwise(F.array(own))))
    held = sorted(r[late] for r in arrived.select(late).distinct().collect() if r[late] is not None)
    for k in held or [0]:  # files are taken in order of their times
        spark.createDataFrame([(k,)], "__slice int").coalesce(1).write.mode("append").parquet(folder)
    batches = spark.readStream.schema("__slice int").option("maxFilesPerTrigger", 1).parquet(folder)
    return F.broadcast(batches).join(arrived, F.col("__slice") == F.col(late)).select(*arrived.columns)


def upserted(stream: DataFrame, keys: list[str], order: list[str], folder: str | None = None, buckets: int = 16) -> KeyedTable:
    """Runs a stream over what is there now, upserting each batch into a keyed table by its id; with a folder given it goes on where it ended."""
    spark, folder = stream.sparkSession, folder or scratch(stream.sparkSession)
    kept = KeyedTable(spark, f"{folder}/table", stream.schema, keys, order, buckets)
    query = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(kept.upsert).trigger(availableNow=True).start()
    query.awaitTermination()
    return kept


def latest_progress(events: DataFrame) -> DataFrame:
    """book, sequence, position, ts: the last event of each book, by event time and then id."""
    top = events.groupBy("book").agg(F.max_by(F.struct("sequence", "position", "ts"), F.struct("ts", "event_id")).alias("top"))
    return top.select("book", "top.*")


def heartbeat_windows(events: DataFrame, length: str = "120 seconds", delay: str = "1 hour") -> DataFrame:
    """worker, start, last_beat, n: beats in tumbling windows; state of windows older than the watermark is dropped."""
    return events.withWatermark("ts", delay).groupBy("worker", F.window("ts", length)).agg(F.max("ts").alias("last_beat"), F.count("*").alias("n")).select("worker", F.col("window.start").alias("start"), "last_beat", "n")


def _turns(code: np.ndarray, at: np.ndarray, living: np.ndarray, length: int, now: int) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Of beats up to now, and the last ones of living workers: the changes (code, when, alive), and the last beats (code, at) of those that live on."""
    by = np.lexsort((at, ~living, code))
    code, at, living = code[by], at[by], living[by]
    first = np.append(True, code[1:] != code[:-1])[: len(code)]
    at = np.maximum(at, at[first][np.cumsum(first) - 1])  # none is before what its worker was last told of
    before = np.append(at[:1], at[:-1])
    gap = ~first & (at - before > length)
    born = gap | first & ~living
    last = np.append(first[1:], True)[: len(code)]
    dead = last & (at + length < now)
    changes = np.concatenate([code[born], code[gap], code[dead]]), np.concatenate([at[born], before[gap] + length, at[dead] + length]), np.arange(born.sum() + gap.sum() + dead.sum()) < born.sum()
    return changes, (code[last & ~dead], at[last & ~dead])


def _transitions(seconds: int):
    """Of a bucket of workers the beats that the watermark hasn't passed yet, and the last ones that it has of workers that count as alive."""
    length = seconds * 1_000_000

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = [(p["worker"].to_numpy(object), p["micros"].to_numpy(np.int64), np.zeros(len(p), np.bool_)) for p in parts]
        held = [pickle.loads(state.get[0])] if state.exists else []
        names, at, living = (np.concatenate(x) for x in zip(*held, *new, strict=True))
        code, names = pd.factorize(names, use_na_sentinel=False)
        now = state.getCurrentWatermarkMs() * 1000
        due = living | (at <= now)
        (who, when, alive), (still, last) = _turns(code[due], at[due], living[due], length, now)
        code, at = np.append(still, code[~due]), np.append(last, at[~due])
        living = np.arange(len(code)) < len(still)
        if len(code):
            state.update((pickle.dumps((names[code], at, living)),))
            state.setTimeoutTimestamp(int(max((at + np.where(living, length, 0)).min(), now)) // 1000 + 1)
        elif state.exists:
            state.remove()  # a worker that is dead and has nothing waiting is as one never seen
        yield pd.DataFrame({"worker": names[who], "micros": when, "alive": alive})

    return run


def liveness_changes(events: DataFrame, seconds: int = 120, delay: str = "1 hour", buckets: int = 2048) -> DataFrame:
    """worker, micros (when, since the epoch), alive: a worker comes alive with a beat and dies seconds after its last one, as the watermark passes.

    Beats may come late by the delay, in any order and twice: they wait in the state until the watermark has passed them. A timer tells of a
    death that no later event of the worker would show. State is the beats of one delay, and nothing of the dead. Workers are dealt over
    buckets, each a call of Python a batch, for a call costs more than a worker's beats. Workers are carried as strings; beats without a time don't count.
    """
    kind = events.schema["worker"].dataType.simpleString()
    rows = events.where("ts IS NOT NULL").withWatermark("ts", delay).select(F.pmod(F.xxhash64("worker"), F.lit(buckets)).alias("bucket"), F.col("worker").cast("string").alias("worker"), "ts", F.unix_micros("ts").alias("micros"))
    changes = rows.groupBy("bucket").applyInPandasWithState(_transitions(seconds), "worker string, micros long, alive boolean", "kept binary", "append", "EventTimeTimeout")
    return changes.select(F.col("worker").cast(kind).alias("worker"), "micros", "alive")


def first_arrivals(events: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """The first row of each key; keys are remembered until the watermark passes them."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def running_counts(events: DataFrame, key: str) -> DataFrame:
    return events.groupBy(key).agg(F.count("*").alias("n_done"))
