"""Quality by nearest-neighbour voting: latent-semantic vectors of labelled texts, exact blocked cosines, weighted votes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import features as X
from lectern.llm import words as W
from lectern.llm.store import table

SHAPES, WORDS = 2048, 1024
DIMS = SHAPES + WORDS


def _counts(joined: bytes, at: np.ndarray) -> np.ndarray:
    """Terms: n-grams of character shapes, and words, where a word that repeats the one before is a term of its own."""
    b = np.frombuffer(joined, np.uint8)
    shapes = X.gram_counts(X.SHAPE[b], at, (1, 2, 3, 4), SHAPES)
    words, first = W.word_hashes(joined, at)
    n = len(at) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    term = (words >> np.uint64(54)).astype(np.int64)
    same = np.zeros(len(words), np.bool_)
    same[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    term[same] = 0
    terms = np.bincount(doc * WORDS + term, minlength=n * WORDS).reshape(n, WORDS)
    return np.hstack([shapes, terms])


def _packed(counts: np.ndarray) -> bytes:
    """The terms that there are, then their counts: a few KB of a text instead of a number for each term."""
    term = np.flatnonzero(counts)
    return term.astype("<u2").tobytes() + counts[term].astype("<u4").tobytes()


def _unpacked(rows: list[bytes]) -> np.ndarray:
    out = np.zeros((len(rows), DIMS), np.float32)  # what weights are made of; counts that it can't hold are rounded there too
    for own, raw in zip(out, rows, strict=True):
        n = len(raw) // 6
        own[np.frombuffer(raw, "<u2", n)] = np.frombuffer(raw, "<u4", n, 2 * n)
    return out


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, _, _, counts in X.counted(batch.column("text"), _counts):
            raw = [_packed(c) for c in counts]
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i).cast(pa.string()), batch.column("label").slice(i, j - i), pa.array(raw, pa.binary())], names=["id", "label", "counts"])


def _basis(x: np.ndarray, rank: int, seed: int = 7) -> np.ndarray:
    """Right singular vectors of x, by randomised subspace iteration."""
    q = np.random.default_rng(seed).standard_normal((x.shape[1], rank + 16)).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return np.ascontiguousarray((q @ v.T)[:, :rank])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """The places of the k greatest of each row; of equal ones the first."""
    least = np.partition(cosine, -k, axis=1)[:, -k, None]
    above, equal = cosine > least, cosine == least
    chosen = above | equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True))
    return np.nonzero(chosen)[1].reshape(len(cosine), k)


class Model:
    """The latent basis, the labelled vectors and their votes: at most 2 * per_class of them, so the size is bounded."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, idf: np.ndarray, weight: dict[int, float], rank: int, neighbours: int, power: float):
        self.idf, self.neighbours, self.power = idf, neighbours, power
        x = X.weighted(counts, idf)
        self.basis = _basis(x, min(rank, *x.shape))
        self.vectors = _unit(x @ self.basis)
        self.labels = labels.astype(np.float32)
        self.weight = np.array([weight.get(int(v), 1.0) for v in labels], np.float32)
        self.prior = float((self.weight * self.labels).sum() / self.weight.sum())

    def score(self, counts: np.ndarray, block: int = 128) -> np.ndarray:
        """Share of label 1 in the similarity-weighted vote of the nearest labelled texts (of equal cosines those of the first ids); the prior share without terms."""
        v = _unit(X.weighted(counts, self.idf) @ self.basis)
        out = np.empty(len(v))
        k = min(self.neighbours, len(self.labels))
        for i in range(0, len(v), block):
            cosine = v[i : i + block] @ self.vectors.T
            near = _nearest(cosine, k)
            vote = np.maximum(np.take_along_axis(cosine, near, axis=1), 0.0) ** self.power * self.weight[near]
            total = vote.sum(axis=1)
            out[i : i + block] = np.where(total > 0, (vote * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-30), self.prior)
        return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 1500, rank: int = 32, neighbours: int = 8, power: float = 30.0, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """A model of at most per_class labelled texts of each class (see features.labelled_texts); None without both ids and labels.

    Document frequencies are counted over all texts. Labelled rows whose text is missing teach nothing; votes of a class are
    weighted by its rows per sampled row, so that sampling doesn't change the odds.
    """
    rows, frequency = X.document_frequencies(docs, F.col(text_col), _counts, DIMS)
    texts, weight = X.labelled_texts(docs, labels, label, per_class, id_col, text_col)
    got = texts.mapInArrow(_sampled, "id string, label int, counts binary").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r["id"], bytes(r["counts"])))
    counts = _unpacked([bytes(r["counts"]) for r in got])
    return Model(counts, np.array([r["label"] for r in got]), X.inverse_frequencies(rows, frequency), weight, rank, neighbours, power)


def _score(model: Model | None, keep: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, _, _, counts in X.counted(batch.column(text), _counts):
                kept = [batch.column(n).slice(i, j - i) for n in keep]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(model.score(counts) if model else np.full(j - i, 0.5))], names=[*keep, "score"])

    return run


def score_quality(docs: DataFrame, model: Model | None, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The columns in keep (all by default), and score, for each row; a column named score is replaced.

    Null and empty texts have no terms and get the prior share of label 1; without a model every score is 0.5. Repeated rows
    are scored each; texts of any length are read whole; an empty table gives no rows. A text that is kept travels once, as itself; another
    only to be scored.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    text = text_col if text_col in keep else "__text"
    cut = docs.select(*keep, *([] if text_col in keep else [F.col(text_col).alias(text)]))
    kinds = ", ".join(f"`{n}` {cut.schema[n].dataType.simpleString()}" for n in keep)
    return cut.mapInArrow(_score(model, keep, text), f"{kinds}, score double")


def _learn(labels: DataFrame) -> DataFrame:
    return labels.where(X.crc_bucket("doc_id", 5) != 0)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, _learn(table(spark, sf_dir, "labels")))
    held_out: Column = X.crc_bucket("doc_id", 5) == 0
    return score_quality(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
