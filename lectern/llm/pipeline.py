"""Training-data pipeline over documents: quality, line dedup, near duplicates, decontamination, SentencePiece encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, jaccard_join, line_dedup, pieces, quality_classifier
from lectern.llm import features as X
from lectern.llm.store import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour classifier scores 0.3 or more; labels of every fifth id are never learned from.

    Null and empty texts get the share of good labels, so they stay where most are good; without labels every score is 0.5 and all
    stay. Repeated rows are scored each; an empty table gives no rows.
    """
    labels = table(spark, sf_dir, "labels").where(X.crc_bucket("doc_id", 5) != 0)
    model = quality_classifier.fit(docs, labels)
    return quality_classifier.score_quality(docs, model, COLUMNS).where("score >= 0.3").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a smaller id holds too; one that is left without a word has nothing of its own and goes.

    A document that loses no line stays as it is, empty and null ones included; null ids lose nothing; repeated rows are one document
    each. An empty table gives no rows.
    """
    rows = line_dedup.line_dedup(docs.select(*COLUMNS))
    left = (F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return rows.where(left).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each similarity component; documents with a null id stay.

    Null and wordless texts are in no group and stay; of a tie between rows of one id all stay; an empty table gives no rows.
    """
    later = jaccard_join.similar_components(docs).where("component_id < doc_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(written(later, "later-copies"), "doc_id", "left_anti").select(*COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item: with fewer than three quarters of the five-word shingles of every item.

    Null and empty texts hold none and stay, as do null ids; of repeated rows all go or stay; an empty benchmark drops nothing.
    """
    return decontaminate.decontaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, and the ids, scores and number of the best segmentations.

    Null and empty texts have one segmentation without pieces; equal scores are settled by the order of search; repeated rows are
    encoded each.
    """
    rows = pieces.encode(docs, pieces.load())
    best = F.col("segmentations")[0]
    return rows.select("doc_id", best.ids.alias("ids"), F.size(best.ids).cast("long").alias("n_pieces"), best.score.alias("score"), F.transform("segmentations", lambda s: s.score).alias("scores"))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("SentencePiece encoding", encode_pieces),
]
#: Trained models and similarity components have no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
