"""Where intermediate tables are written, so that a lost executor costs a reread and not a recomputation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a folder of our own only where a local session has none (tests).

    On a cluster without the setting this raises, for other machines would not see a folder of ours.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-lectern-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new path under the application's own folder, which can be removed when its results have been read."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_and_seen(df: DataFrame, name: str, *figures: Column) -> tuple[DataFrame, dict]:
    """df written, with its rows as n and further aggregates over them by name, taken by the tasks that write: no job reads the table for them."""
    seen = Observation()
    return written(df.observe(seen, F.count(F.lit(1)).alias("n"), *figures), name), seen.get


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of one or two longs (67 MB were measured as a hash table) up to which a written table is broadcast; wider ones take a smaller bound.
BROADCAST_ROWS = 2_000_000


def broadcast_if_small(keys: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of keys, marked for broadcast if it has rows rows at most; else as it is, for a shuffled join."""
    return F.broadcast(keys) if keys.count() <= rows else keys


def written_small(df: DataFrame, name: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df written, and marked for broadcast as by broadcast_if_small; its rows are counted while they are written."""
    keys, seen = written_and_seen(df, name)
    return F.broadcast(keys) if seen["n"] <= rows else keys
