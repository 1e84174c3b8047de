"""Exact dedup by deterministic block naming: blocks are sorted into integer names, pairs of names into names, until each text has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.store import broadcast_if_small, table, written

BLOCK_BYTES = 1024
#: Stands for the missing right half of a pair; names are never negative but those of blocks told apart by their bytes, from -2 down.
NONE = -1


def _blocks(text: Column, size: int) -> Column:
    """array<binary>: the text's UTF-8 in blocks of size bytes; an empty text is one empty block. The bytes are made once, not for each block."""

    def cut(b: Column) -> Column:
        last = F.greatest(F.ceil(F.octet_length(b) / size).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(b, i * size + 1, F.lit(size)))

    return F.get(F.transform(F.array(text.cast("binary")), cut), F.lit(0))


def _version(sha: Column) -> Column:
    """Tells rows of one id apart that have different texts."""
    return F.substring(F.unhex(sha), 1, 16)


def _named(things: DataFrame, *columns: str) -> DataFrame:
    """things, distinct, with a name: the place in the sort of the distinct rows. Copies are combined before the shuffle; a written table, so that names stay."""
    return written(things.distinct().sortWithinPartitions(*columns).withColumn("name", F.monotonically_increasing_id()), "names")


def _first_names(texts: DataFrame, size: int, address: Callable[[Column], Column]) -> DataFrame:
    """(d, v, n, pos, c, name): a row for each block of each distinct (id, text), n blocks in all, c rows of the table that hold it.

    Blocks are sorted as bytes, in one shuffle of the distinct ones; the names come back to the documents by a 64-bit address. Where
    blocks share an address, these are named and joined by their bytes, so names never collide.
    """
    blocks = texts.select(F.explode(_blocks(F.col("t"), size)).alias("b")).select(address(F.col("b")).alias("h"), "b")
    names = written(blocks.distinct().sortWithinPartitions("h", "b").select("h", F.monotonically_increasing_id().alias("name")), "block-names")
    shared = written(names.groupBy("h").count().where("count > 1").select("h"), "shared-addresses")
    if not shared.count():
        found = texts.select("d", "v", F.posexplode(F.transform(_blocks(F.col("t"), size), lambda b: address(b))).alias("pos", "h"), F.ceil(F.octet_length("t") / size).cast("int").alias("n"))
        return found.groupBy("d", "v", "n", "pos", "h").agg(F.count("*").alias("c")).join(names, "h").select("d", "v", F.greatest("n", F.lit(1)).alias("n"), "pos", "c", "name")
    few = broadcast_if_small(shared)
    own = _named(blocks.join(few, "h", "left_semi"), "h", "b").withColumn("name", F.lit(NONE - 1) - F.col("name"))
    names = names.join(few, "h", "left_anti").select("h", F.lit(None).cast("binary").alias("b"), "name").unionByName(own)
    found = texts.select("d", "v", F.posexplode(_blocks(F.col("t"), size)).alias("pos", "b"), F.ceil(F.octet_length("t") / size).cast("int").alias("n"))
    found = found.withColumn("h", address(F.col("b"))).join(few.withColumn("told", F.lit(True)), "h", "left").withColumn("b", F.when(F.col("told"), F.col("b")))
    found = found.groupBy("d", "v", "n", "pos", "h", "b").agg(F.count("*").alias("c")).alias("f").join(names.alias("k"), (F.col("f.h") == F.col("k.h")) & F.col("f.b").eqNullSafe(F.col("k.b")))
    return found.select("d", "v", F.greatest("n", F.lit(1)).alias("n"), "pos", "c", "name")


def identities(texts: DataFrame, block_bytes: int = BLOCK_BYTES, address: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(d, v, c, level, name) of (d, v, t), a row for each distinct (d, v): texts are equal exactly when level and name are.

    A level halves the names of every text; there are as many as the longest text's blocks have binary digits. Only numbers
    are shuffled after the first naming. Every level is written to the shared folder, which cuts the lineage.
    """
    now = written(_first_names(texts, block_bytes, address), "level")
    done = [now.where("n = 1").select("d", "v", "c", F.lit(0).alias("level"), "name")]
    level, longest = 0, now.agg(F.max("n")).first()[0] or 1
    while longest > 1:
        level, longest = level + 1, (longest + 1) // 2
        half = lambda k: F.max(F.when(F.col("pos") % 2 == k, F.col("name")))
        pairs = now.where("n > 1").groupBy("d", "v", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.floor(F.col("pos") / 2).cast("int").alias("pos"), "c").agg(half(0).alias("a"), F.coalesce(half(1), F.lit(NONE)).alias("b"))
        names = _named(pairs.select("a", "b"), "a", "b")
        now = written(pairs.join(names, ["a", "b"]).select("d", "v", "n", "pos", "c", "name"), "level")
        done.append(now.where("n = 1").select("d", "v", "c", F.lit(level).alias("level"), "name"))
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, address: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256: of rows of equal texts those of the greatest id are kept.

    Texts are equal when they are identical; a null text counts as empty, and all empty texts are one group. Identity rests on names,
    never on hashes; rows of one id with different texts are told apart by 128 bits of SHA-256. group_size counts rows. Rows
    that repeat an id and a text are one document: all of them are kept or none. A row with a null id is kept only where no equal text has an
    id. A text of any length is cut into blocks of block_bytes; an empty table gives no rows. Columns of these four names are replaced.
    Groups are combined before they are shuffled, so one with a third of all rows is no hot key.
    """
    new = ["keep_id", "group_size", "kept", "text_sha256"]
    sha = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    texts = docs.select(F.col(id_col).alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("v", _version(F.sha2("t", 256)))
    own = written(identities(texts, block_bytes, address), "identities")
    groups = own.groupBy("level", "name").agg(F.max("d").alias("keep"), F.sum("c").alias("size")).where("size > 1")
    groups = broadcast_if_small(written(groups, "groups"))
    found = own.join(groups, ["level", "name"], "left").select(F.col("d").alias("__d"), F.col("v").alias("__v"), F.when(F.col("size").isNull(), F.col("d")).otherwise(F.col("keep")).alias("__keep"), F.coalesce("size", F.lit(1)).alias("__size"))
    rows = docs.select(*[c for c in docs.columns if c not in new], sha.alias("__sha"))
    joined = rows.join(found, F.col(id_col).eqNullSafe(F.col("__d")) & (_version(F.col("__sha")) == F.col("__v")))
    return joined.select(
        *[F.col(c) for c in rows.columns[:-1]], F.col("__keep").alias("keep_id"), F.col("__size").cast("long").alias("group_size"),
        F.col(id_col).eqNullSafe(F.col("__keep")).alias("kept"), F.col("__sha").alias("text_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
