"""Stored tables that a repeated, restarted or half-finished write leaves right: appends by token, replaced books, keyed upserts, generations of a schema.

Everything is Parquet in folders under one path of any file system that Spark writes to. What a write makes visible is one small file,
written last; whatever lies there without it is overwritten by the next try.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.operators.state import add_column, appended, latest


def _fs(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system of a path, and the path, as JVM objects."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def _remove(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def _marked(spark: SparkSession, path: str) -> list[str]:
    """Names of the subfolders of path that were written to their end."""
    return [x for x in _names(spark, path) if "_SUCCESS" in _names(spark, f"{path}/{x}")]


class InsertOnly:
    """Rows that are stored once for each key, whatever is appended how often. An append has a token; one that is done does nothing."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str]):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, keys

    def read(self) -> DataFrame:
        """The rows of finished appends."""
        parts = [f"{self.path}/data/{t}" for t in _marked(self.spark, f"{self.path}/data")]
        return self.spark.read.schema(self.schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.schema)

    def append(self, new: DataFrame, token: str) -> int:
        """Stores rows of new (with a column order, which tells the first of a key) whose key isn't stored, and says how many; -1 for a token that is done.

        One write at a time: the rows are written under the token's own folder, which counts once Spark has committed it, so a try that
        died leaves nothing and a second one starts anew.
        """
        if token in _marked(self.spark, f"{self.path}/data"):
            return -1
        fresh, _ = appended(self.read(), new, self.keys)
        target = f"{self.path}/data/{token}"
        fresh.select(*self.schema.names).write.mode("overwrite").parquet(target)
        return self.spark.read.schema(self.schema).parquet(target).count()


def replace_partitions(new: DataFrame, path: str, key: str) -> None:
    """Writes new in folders by key, each replacing what the key had; folders of other keys aren't touched. A repeated write gives the same."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


class KeyedTable:
    """The last row of each key, by upserts that carry a version (a batch's id): a version applied again, or after a restart, changes nothing.

    Keys are dealt over buckets. A version writes the buckets that it touches anew, and then a manifest that says which version each
    bucket is of; readers take the last manifest. Data that neither of the last two manifests has is removed.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], order: list[str], buckets: int = 16):
        self.spark, self.path, self.schema, self.keys, self.order, self.buckets = spark, path.rstrip("/"), schema, keys, order, buckets

    def versions(self) -> list[int]:
        return sorted(int(x.removeprefix("v")) for x in _marked(self.spark, f"{self.path}/manifest"))

    def _manifest(self, version: int) -> dict[int, int]:
        return {r["bucket"]: r["version"] for r in self.spark.read.parquet(f"{self.path}/manifest/v{version}").collect()}

    def _rows(self, held: dict[int, int]) -> DataFrame:
        parts = [f"{self.path}/data/v{v}/bucket={b}" for b, v in sorted(held.items())]
        return self.spark.read.schema(self.schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        done = self.versions()
        return self._rows(self._manifest(done[-1]) if done else {})

    def upsert(self, batch: DataFrame, version: int) -> None:
        """Applies a batch: of each key the row that comes last in order, stored or new, stays. An older version than the last one is done already."""
        done = self.versions()
        if done and version <= done[-1]:
            return
        held = self._manifest(done[-1]) if done else {}
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        new = batch.select(*self.schema.names)
        touched = [r["bucket"] for r in new.select(bucket.alias("bucket")).distinct().collect()]
        merged = latest(self._rows({b: held[b] for b in touched if b in held}).unionByName(new), self.keys, [F.col(c) for c in self.order])
        merged.withColumn("bucket", bucket).repartition(self.buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v{version}")
        held |= dict.fromkeys(touched, version)
        rows = self.spark.createDataFrame(sorted(held.items()), "bucket int, version long")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v{version}")
        self._tidy([*done, version][-2:])

    def _tidy(self, kept: list[int]) -> None:
        used = {v for k in kept for v in self._manifest(k).values()}
        for name in _names(self.spark, f"{self.path}/data"):
            if int(name.removeprefix("v")) not in used | {max(kept)}:
                _remove(self.spark, f"{self.path}/data/{name}")
        for name in _names(self.spark, f"{self.path}/manifest"):
            if int(name.removeprefix("v")) not in kept:
                _remove(self.spark, f"{self.path}/manifest/{name}")


@dataclass(frozen=True)
class Added:
    """A column that rows have since a generation: its type and the value of older rows."""

    name: str
    kind: str
    since: int
    default: object | None = None
    required: bool = False


def read_generations(spark: SparkSession, path: str, added: list[Added]) -> DataFrame:
    """The rows under path/generation=N, written with as many schemas, in the newest: older rows have the defaults of what was added since.

    A null in a row that could have had the column stays null. A required column needs a default, and may not be null since it is there.
    """
    rows = spark.read.option("mergeSchema", True).parquet(path)
    for c in added:
        if c.required and c.default is None:
            raise ValueError(f"column {c.name} is required and has no default")
        was_there = c.name in rows.columns
        rows = add_column(rows, c.name, c.kind, c.default, c.required)
        if was_there:
            own = F.col(c.name).cast(c.kind)
            own = F.coalesce(own, F.raise_error(F.lit(f"column {c.name} is required")).cast(c.kind)) if c.required else own
            rows = rows.withColumn(c.name, F.when(F.col("generation") < c.since, F.lit(c.default).cast(c.kind)).otherwise(own))
    return rows
