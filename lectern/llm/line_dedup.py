"""Line dedup: explode normalised lines, hash, count documents per hash, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.store import table, written

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is; lower() does that where all characters are ASCII."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def line_dedup(docs: DataFrame, min_docs: int = 2, min_length: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    r"""docs with text_col deduplicated by line, plus n_lines (before dropping) and n_dropped.

    A line whose key (stripped, A-Z lower-cased) has min_length code points or more and occurs in min_docs distinct ids or
    more is dropped, except in the smallest id that holds it. A null text is one empty line. Rows with a null id are neither
    counted nor changed. Repeated rows of an id are one document; each gets the same treatment. When every line goes, the
    text is empty. Columns named n_lines or n_dropped are replaced.

    Only (hash, id, position) of long lines is shuffled for counting; minima and maxima are combined before the shuffle,
    so a line that a third of the documents share is no hot group. The shared hashes are written to the shared folder, so that
    the join back on them reads both sides through exchanges of its own, whose hot partitions AQE can split.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.split(text, "\n", -1)
    version = F.xxhash64(text)
    entries = (
        docs.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("__id"), version.alias("__version"), F.posexplode(lines).alias("__pos", "__line"))
        .withColumn("__key", line_key(F.col("__line")))
        .where(F.length("__key") >= min_length)
        .select("__id", "__version", "__pos", F.xxhash64("__key").alias("__h1"), F.hash("__key", F.length("__key")).alias("__h2"))
    )
    if min_docs == 2:  # two distinct ids exactly when the least and the greatest differ
        shared = entries.groupBy("__h1", "__h2").agg(F.min("__id").alias("__least"), F.max("__id").alias("__greatest")).where("__least < __greatest")
    else:
        held = entries.groupBy("__h1", "__h2", "__id").agg(F.lit(1).alias("__one"))
        shared = held.groupBy("__h1", "__h2").agg(F.min("__id").alias("__least"), F.count("*").alias("__docs")).where(F.col("__docs") >= min_docs)
    shared = written(shared.select("__h1", "__h2", "__least"), "shared-lines")
    gone = (
        entries.join(shared, ["__h1", "__h2"])
        .where("__id > __least")
        .groupBy("__id", "__version")
        .agg(F.collect_set("__pos").alias("__gone"))
    )
    on = (F.col(id_col) == F.col("__id")) & (version == F.col("__version"))
    n, gone_or_none = F.size(lines), F.coalesce(F.col("__gone"), F.array().cast("array<int>"))
    stay = F.array_except(F.sequence(F.lit(0), n - 1), gone_or_none)
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col("__lines"), i)), "\n")
    others = [c for c in docs.columns if c not in {"n_lines", "n_dropped"}]
    return (
        docs.select(*others)
        .join(gone, on, "left")
        .withColumn("__lines", lines)
        .withColumn("__kept", F.when(F.col("__gone").isNull(), text).otherwise(kept))
        .select(
            *[F.col("__kept").alias(c) if c == text_col else F.col(c) for c in others],
            F.size("__lines").cast("long").alias("n_lines"),
            F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_dropped"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


SQL = f"""
WITH lines AS (
  SELECT doc_id, i, l[i] AS line, translate(trim(l[i], chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), '{UPPER}', '{LOWER}') AS k
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), shared AS (
  SELECT k, min(doc_id) AS least FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT lines.*, shared.k IS NOT NULL AND doc_id > least AS gone FROM lines LEFT JOIN shared ON lines.k = shared.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
