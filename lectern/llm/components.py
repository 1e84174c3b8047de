"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.store import written_and_seen

#: Edges (16 bytes each) up to which a round is one task: far less than what Spark would leave in one partition of its exchanges anyway.
SMALL = 50_000


def _round(edges: DataFrame) -> DataFrame:
    """The edges after a large-star and a small-star step."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    first = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    small = large.join(first, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return small.unionAll(first.select("u", "m")).distinct()


def _small_round(edges: DataFrame) -> DataFrame:
    """The same of few edges, in one partition: minima are windows there, without an exchange."""
    least = F.min("b").over(Window.partitionBy("a"))
    pair = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    both = edges.coalesce(1).select(F.explode(F.array(pair("a", "b"), pair("b", "a"))).alias("e")).select("e.a", "e.b")
    large = both.withColumn("m", F.least("a", least)).where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    met = large.withColumn("m", least).select(F.explode(F.array(pair("b", "m"), pair("a", "m"))).alias("e")).select("e.a", "e.b")
    return met.where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60, small: int = SMALL) -> DataFrame:
    """(node, component) for every node of the edges (a, b): component is the least node that it reaches.

    Every round joins each edge with the least neighbour of its ends, so edges never outnumber the first ones by much, and is
    written to the shared folder, which cuts the lineage. Minima are combined before the shuffle and AQE can split the join
    of a node with very many edges; up to small edges a round is a task, for its eleven exchanges cost the driver more than the edges do. Rounds grow
    with the logarithm of the longest path. Self-loops and repeated edges do no harm; an empty table gives no rows.
    """
    figures = F.bit_xor(F.xxhash64("a", "b")).alias("ab"), F.bit_xor(F.xxhash64("b")).alias("b")  # tell two edge tables apart: sums of ids could overflow, exclusive ors can't
    now, before = written_and_seen(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges", *figures)
    if not before["n"]:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    step = _small_round if before["n"] <= small else _round
    for _ in range(rounds):
        now, after = written_and_seen(step(now), "edges", *figures)
        if after == before:
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
        before = after
    raise RuntimeError(f"no fixed point after {rounds} rounds")
