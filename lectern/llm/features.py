"""Hashed term counts of Arrow batches, document frequencies over whole tables, and bounded labelled samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import words as W

#: Rows and text bytes that are counted at once: bounds the dense count matrix.
ROWS, BYTES, PART = 256, 1 << 18, 4 << 20
Counter = Callable[[bytes, np.ndarray], np.ndarray]  # joined texts and their starts: a row of term counts per text

_shape = np.arange(256, dtype=np.uint8)
_shape[ord("a") : ord("z") + 1] = ord("a")
_shape[ord("A") : ord("Z") + 1] = ord("A")
_shape[ord("0") : ord("9") + 1] = ord("0")
_shape[128:] = ord("a")
SHAPE = _shape


def gram_counts(b: np.ndarray, at: np.ndarray, orders: tuple[int, ...], dims: int) -> np.ndarray:
    """Counts of each text's byte n-grams, hashed to dims (a power of two); no n-gram spans two texts."""
    n, bits = len(at) - 1, dims.bit_length() - 1
    b = np.append(b, np.uint8(10))
    out = np.zeros(n * dims + 1, np.int64)
    for low in range(0, int(at[-1]), PART):  # so that one very long text needs no more memory than many short ones
        high = min(low + PART, int(at[-1]))
        first, last = int(np.searchsorted(at, low, side="right")) - 1, int(np.searchsorted(at, high))
        doc = np.repeat(np.arange(first, last, dtype=np.int64) * dims, np.diff(np.clip(at[first : last + 1], low, high)))
        for k in orders:
            m = min(high, len(b) - k + 1) - low
            if m <= 0:
                continue
            code = np.full(m, k, np.uint32)
            for i in range(k):
                code = code * np.uint32(0x01000193) ^ b[low + i : low + i + m]
            code ^= code >> np.uint32(15)
            key = doc[:m] + ((code * np.uint32(2654435761)) >> np.uint32(32 - bits))
            cut = ((at[first + 1 :] - 1)[: last - first + k, None] - np.arange(k)).ravel() - low  # windows that hold a separator
            key[cut[(cut >= 0) & (cut < m)]] = n * dims
            out += np.bincount(key, minlength=n * dims + 1)
    return out[:-1].reshape(n, dims)


def counted(column: pa.Array, counter: Counter) -> Iterator[tuple[int, int, bytes, np.ndarray, np.ndarray]]:
    for i, j, joined, at in W.slices(column, BYTES, ROWS):
        yield i, j, joined, at, counter(joined, at)


def document_frequencies(docs: DataFrame, text: Column, counter: Counter, dims: int) -> tuple[int, np.ndarray]:
    """Rows, and how many of them have each term: a sum over every row, of which dims numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(dims + 1, np.int64), 0
        for batch in batches:
            for i, j, _, _, counts in counted(batch.column(0), counter):
                total[:dims] += (counts > 0).sum(axis=0)
                rows += j - i
        total[dims] = rows
        term = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(total[term], pa.int64())], names=["term", "n"])

    got = docs.select(text).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(dims + 1, np.int64)
    for r in got:
        out[r["term"]] = r["n"]
    return int(out[dims]), out[:dims]


def inverse_frequencies(rows: int, frequency: np.ndarray) -> np.ndarray:
    return np.log((1 + rows) / (1 + frequency)).astype(np.float32) + np.float32(0.05)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of (1 + log tf) * idf, of length 1 (or 0 without terms)."""
    x = np.log1p(counts, dtype=np.float32)
    x *= idf
    for i in range(0, len(x), ROWS):  # so that the norms need no copies of all rows
        x[i : i + ROWS] /= np.maximum(np.linalg.norm(x[i : i + ROWS], axis=1, keepdims=True), 1e-12)
    return x


def crc_bucket(id_col: str, of: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % of


def labelled_sample(labels: DataFrame, label: str, per_class: int, id_col: str) -> tuple[DataFrame, dict[int, float]]:
    """(id, label) of at most per_class ids of each of the classes 0 and 1, those of least hash, and each class's rows per sampled row.

    Rows with a null id or label don't count.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("__sid")).agg(F.max(F.col(label).cast("int")).alias("__label"))
    sizes = {r["__label"]: r["count"] for r in known.groupBy("__label").count().collect()}
    parts = [known.where(F.col("__label") == k).orderBy(F.xxhash64(F.col("__sid")), "__sid").limit(per_class) for k in (0, 1)]
    return parts[0].unionAll(parts[1]), {k: max(1.0, n / per_class) for k, n in sizes.items()}


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str, text_col: str) -> tuple[DataFrame, dict[int, float]]:
    """(id, label, text) of the sampled ids that docs holds, and the weights of labelled_sample.

    An id counts once, with its text of least hash, however many rows it has; a null text is empty.
    """
    chosen, weight = labelled_sample(labels, label, per_class, id_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("__sid")).select(F.col(id_col).cast("string").alias("id"), F.col("__label").alias("label"), text.alias("text"))
    return rows.groupBy("id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")), weight
