"""Language identification by nearest centroid: TF-IDF vectors of byte n-grams against several centroids per language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm import features as X
from lectern.llm.store import table

DIMS, ORDERS = 4096, (1, 2, 3)
UNKNOWN = "und"


def _counts(joined: bytes, at: np.ndarray) -> np.ndarray:
    return X.gram_counts(np.frombuffer(joined.lower(), np.uint8), at, ORDERS, DIMS)


def _vectors(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, _, _, counts in X.counted(batch.column("text"), _counts):
                vectors = [v.astype(np.float16).tobytes() for v in X.weighted(counts, idf)]
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(i, j - i), pa.array(vectors, pa.binary())], names=["lang", "vector"])

    return run


def _centroids(clusters: int, quantile: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Spherical k-means of one language's sampled vectors, and the cosine below which a member is an outlier."""
        x = np.stack([np.frombuffer(v, np.float16) for v in sorted(rows["vector"])]).astype(np.float32)
        centre = x[np.linspace(0, len(x) - 1, min(clusters, len(x))).astype(int)]
        for _ in range(12):
            nearest = (x @ centre.T).argmax(axis=1)
            centre = np.stack([x[nearest == c].mean(axis=0) if (nearest == c).any() else centre[c] for c in range(len(centre))])
            centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
        best = (x @ centre.T).max(axis=1)
        return pd.DataFrame({"lang": key[0], "centroid": [c.tobytes() for c in centre], "cut": float(np.quantile(best, quantile))})

    return run


class Model:
    def __init__(self, langs: list[str], centroids: np.ndarray, cuts: np.ndarray, idf: np.ndarray):
        self.langs, self.centroids, self.cuts, self.idf = langs, centroids, cuts, idf

    def predict(self, counts: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        cosine = X.weighted(counts, self.idf) @ self.centroids.T
        best = cosine.argmax(axis=1)  # of equals the first: languages are in order
        score = cosine[np.arange(len(cosine)), best]
        return [self.langs[k] for k in best], np.clip(score, 0, 1).astype(np.float64), score < self.cuts[best]


def fit(docs: DataFrame, learn: Column, clusters: int = 4, per_language: int = 300, reject_quantile: float = 0.005, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Centroids of every language found on rows where learn holds; None if there are none.

    Document frequencies are counted over all these rows. The clusters are fitted on a sample of per_language rows of each
    language at most, those of least hash of the id (one row of an id). Of a centroid's radius, reject_quantile of the sample
    lies outside. Rows with a null text or language teach nothing. Over 1000 languages are refused: the centroids go to every task.
    """
    known = docs.where(learn & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    langs = known.select("lang").distinct().limit(1001).count()
    if not langs:
        return None
    if langs > 1000:
        raise ValueError("more than 1000 languages")
    rows, frequency = X.document_frequencies(known, F.col("text"), _counts, DIMS)
    idf = X.inverse_frequencies(rows, frequency)
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.col("id").cast("string"), F.lit("sample")), "id")  # each task keeps its first rows only
    first = known.select("lang", "id").withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_language).select("lang", "id").distinct()
    chosen = known.join(F.broadcast(first), (known["lang"] == first["lang"]) & known["id"].eqNullSafe(first["id"]), "left_semi")
    chosen = chosen.groupBy("lang", "id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    vectors = chosen.select("text", "lang").mapInArrow(_vectors(idf), "lang string, vector binary")
    found = vectors.groupBy("lang").applyInPandas(_centroids(clusters, reject_quantile), "lang string, centroid binary, cut double").collect()
    found.sort(key=lambda r: (r["lang"], bytes(r["centroid"])))
    return Model([r["lang"] for r in found], np.stack([np.frombuffer(r["centroid"], np.float32) for r in found]), np.array([r["cut"] for r in found]), idf)


def _predict(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, joined, at, counts in X.counted(batch.column("__text"), _counts):
                langs, score, far = model.predict(counts) if model else ([UNKNOWN] * (j - i), np.zeros(j - i), np.ones(j - i, np.bool_))
                b = np.frombuffer(joined.lower() + b"\n", np.uint8)
                ascii_letters = np.add.reduceat((b >= 97) & (b <= 122), at[:-1], dtype=np.int64)
                for d in np.flatnonzero(ascii_letters == 0):
                    if not any(map(str.isalpha, joined[at[d] : at[d + 1] - 1].decode())):  # category L; numerals are none
                        langs[d], score[d], far[d] = UNKNOWN, 0.0, True
                names = [n for n in batch.schema.names if n != "__text"]
                kept = [batch.column(n).slice(i, j - i) for n in names]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(score), pa.array(far)], names=[*names, "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score (cosine to the nearest centroid) and rejected (farther than that centroid's radius) for each row.

    A null text, or one without a letter (Unicode category L, so numerals such as ½ are none), is "und" with score 0; so is all without a
    model. Texts of any length are read whole; of equally near centroids the first language in order is given; an empty table gives no rows. The nearest language is given for
    rejected texts too, so that the caller decides. Repeated rows are answered each; other columns are not read.
    """
    cut = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    kind = cut.schema[id_col].dataType.simpleString()
    return cut.mapInArrow(_predict(model), f"`{id_col}` {kind}, lang_pred string, score double, rejected boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs, X.crc_bucket("doc_id", 4) != 2))
    return found.select("doc_id", (X.crc_bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
