"""Key-value dictionaries kept as files: read as a table, empty where the file is absent or malformed."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """(term, spoken) of lines "term: spoken"; comments and lines without both parts are skipped."""
    try:
        return terms_of(spark.read.text(path))
    except AnalysisException:  # no such file: no terms
        return spark.createDataFrame([], "term string, spoken string")


def terms_of(lines: DataFrame) -> DataFrame:
    """(term, spoken) of a table of lines (value); of a term given twice one spelling stays, the last in order of characters."""
    parts = lines.where(~F.col("value").rlike(r"^\s*#")).select(F.regexp_extract("value", r"^\s*[\"']?([^:\"']+?)[\"']?\s*:", 1).alias("term"), F.regexp_extract("value", r":\s*[\"']?(.+?)[\"']?\s*$", 1).alias("spoken"))
    return parts.where("term <> '' AND spoken <> ''").groupBy("term").agg(F.max("spoken").alias("spoken"))


def as_map(terms: DataFrame, most: int = 1000) -> dict[str, str] | None:
    """The terms on the driver; None for a dictionary of more than most entries, which stays a table (operators.terms)."""
    rows = terms.limit(most + 1).collect()
    return {r["term"]: r["spoken"] for r in rows} if len(rows) <= most else None
