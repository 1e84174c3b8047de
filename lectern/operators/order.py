"""Sums, last values and neighbours in an order within a key, without a window over the whole key.

Rows are windowed in ranges of width orders; what a range hands on to the next ones is a row of its summary, and only summaries are
windowed over the whole key. So a key with very many rows is no hot group: ten million rows of one key are 2,442 summaries.
Orders are whole numbers, of which each key has a value once; they may have gaps. Null keys are one key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 4096


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt over all cores where the input has hardly more splits than these (a small file of one row group is one split); a larger input stays as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < 2 * cores else rows


def _by_range(rows: DataFrame, key: str | list[str], order: str, width: int) -> tuple[DataFrame, list[str]]:
    keys = [key] if isinstance(key, str) else [*key]
    return rows.withColumn("__range", F.floor(F.col(order) / width)), keys


def _with_summaries(rows: DataFrame, summaries: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the other columns of their range's summary."""
    on = [*keys, "__range"]
    own = summaries.select(*[F.col(c).alias(f"__of_{c}") for c in on], *[c for c in summaries.columns if c not in on])
    return rows.join(own, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in on])).drop(*[f"__of_{c}" for c in on])


def with_sum_before(rows: DataFrame, key: str | list[str], order: str, size: Column, name: str, width: int = WIDTH) -> DataFrame:
    """rows with the sum of size over the key's rows of smaller order."""
    cut, keys = _by_range(rows.withColumn("__size", size), key, order, width)
    ranges = cut.groupBy(*keys, "__range").agg(F.sum("__size").alias("__sum"))
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(*keys, "__range", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*keys, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    found = _with_summaries(cut.withColumn("__inside", F.coalesce(F.sum("__size").over(inside), F.lit(0))), offsets, keys)
    return found.withColumn(name, F.col("__offset") + F.col("__inside")).drop("__range", "__size", "__offset", "__inside")


def carried(rows: DataFrame, key: str | list[str], order: str, value: Column, name: str, width: int = WIDTH) -> DataFrame:
    """rows with the last value of the key that isn't null, at the row or before; null where there is none."""
    cut, keys = _by_range(rows.withColumn("__value", value), key, order, width)
    ranges = cut.groupBy(*keys, "__range").agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.col(order))).alias("__last"))
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.select(*keys, "__range", F.last("__last", ignorenulls=True).over(earlier).alias("__before"))
    inside = Window.partitionBy(*keys, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    found = _with_summaries(cut.withColumn("__inside", F.last("__value", ignorenulls=True).over(inside)), before, keys)
    return found.withColumn(name, F.coalesce("__inside", "__before")).drop("__range", "__value", "__before", "__inside")


def neighbours(rows: DataFrame, key: str | list[str], order: str, before: Column, after: Column, names: tuple[str, str] = ("before", "after"), width: int = WIDTH) -> DataFrame:
    """rows with the value of before at the key's row ahead, and of after at the row behind; null at the ends. Values are never null (structs may hold nulls)."""
    cut, keys = _by_range(rows.withColumn("__b", before).withColumn("__a", after), key, order, width)
    ranges = cut.groupBy(*keys, "__range").agg(F.max_by("__b", order).alias("__b"), F.min_by("__a", order).alias("__a"))
    over = Window.partitionBy(*keys).orderBy("__range")
    ends = ranges.select(*keys, "__range", F.lag("__b").over(over).alias("__end_before"), F.lead("__a").over(over).alias("__end_after"))
    inside = Window.partitionBy(*keys, "__range").orderBy(order)
    found = cut.withColumn("__in_before", F.lag("__b").over(inside)).withColumn("__in_after", F.lead("__a").over(inside)).drop("__a", "__b")
    found = _with_summaries(found, ends, keys)
    out = found.withColumn(names[0], F.coalesce("__in_before", "__end_before")).withColumn(names[1], F.coalesce("__in_after", "__end_after"))
    return out.drop("__range", "__in_before", "__in_after", "__end_before", "__end_after")
