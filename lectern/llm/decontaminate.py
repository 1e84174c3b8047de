r"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so a Jaccard sketch of the document says little; containment is estimated from the
item's side. Items are partitioned by the size of their shingle set (powers of two). In the partition of sizes up to u an
item is indexed by its bottom-k MinHash values with k = floor((1 - t) * u) + 1: of a document that contains a share t of
the item's n <= u shingles at most floor((1 - t) * n) < k are missing, so at least k - floor((1 - t) * n) of the sketched values are
in it, and no such document is lost. The hits of a document on an item's sketch are its containment estimate; pairs that
reach the bound are verified by comparing the shingles themselves, word for word.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import words as W
from lectern.llm.store import table, written, written_small

WIDTH = 5


def item_shingles(text: bytes, width: int = WIDTH) -> set[bytes]:
    """Distinct shingles; an item of fewer words is one shingle of all its words. Words are joined by single spaces."""
    own = text.lower().split()
    k = min(width, len(own))
    return {b" ".join(own[i : i + k]) for i in range(len(own) - k + 1)} if own else set()


def _shingle_hash(s: bytes) -> int:
    words, first = W.word_hashes(s, np.array([0, len(s) + 1]))
    return int(W.window_hashes(words, first, len(words))[0][0])


class Index:
    """Sketches and shingles of one block of items; small enough to go with each task."""

    def __init__(self, items: list[tuple[int, bytes]], threshold: Fraction, width: int):
        self.threshold, self.items = threshold, []
        slots: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))  # shingle width, hash: items
        for key, text in items:
            shingles = item_shingles(text, width)
            if not shingles:
                continue
            n, w = len(shingles), len(next(iter(shingles)).split())
            upper = 1 << (n - 1).bit_length()  # the partition's largest size
            k = int((1 - threshold) * upper) + 1
            sketch = sorted(_shingle_hash(s) for s in shingles)[:k]
            need = max(1, len(sketch) - int((1 - threshold) * n))
            for h in sketch:
                slots[w][h].append(len(self.items))
            self.items.append((key, w, need, shingles))
        self.slots = {w: dict(x) for w, x in slots.items()}
        self.hashes = {w: np.sort(np.array(list(x), np.uint64)) for w, x in slots.items()}

    def found(self, hits: dict[int, list[np.ndarray]], text: bytes) -> Iterator[tuple[int, int, int]]:
        """(item, its shingles, those in the text), for one text and the sketch hashes found in it."""
        seen: dict[int, int] = defaultdict(int)
        for w, hs in hits.items():
            for h in hs:
                for i in self.slots[w][h]:
                    seen[i] += 1
        own: dict[int, set[bytes]] = {}
        words = None
        for i, n in sorted(seen.items()):
            key, w, need, shingles = self.items[i]
            if n < need:
                continue
            if words is None:
                words = text.lower().split()
            if w not in own:
                own[w] = {b" ".join(words[k : k + w]) for k in range(len(words) - w + 1)}
            shared = len(shingles & own[w])
            if shared >= self.threshold * len(shingles):
                yield key, len(shingles), shared


def _search(index: Index, id_type: pa.DataType, item_type: pa.DataType):
    table_bits = 20
    filters = {}
    for w, hs in index.hashes.items():
        filters[w] = np.zeros(1 << table_bits, np.bool_)
        filters[w][hs >> np.uint64(64 - table_bits)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, joined, at in W.slices(batch.column("__text")):
                words, first = W.word_hashes(joined, at)
                hits: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
                for w, hs in index.hashes.items():
                    h, begin = W.window_hashes(words, first, w)
                    maybe = np.flatnonzero(filters[w][h >> np.uint64(64 - table_bits)])
                    if not len(maybe):
                        continue
                    where = np.minimum(np.searchsorted(hs, h[maybe]), len(hs) - 1)
                    maybe = maybe[hs[where] == h[maybe]]
                    doc = np.searchsorted(begin, maybe, side="right") - 1
                    for d, x in {*zip(doc.tolist(), h[maybe].tolist(), strict=True)}:
                        hits[d][w].append(x)
                rows = [(d, *x) for d in sorted(hits) for x in index.found(hits[d], joined[at[d] : at[d + 1] - 1])]
                ids = batch.column("__id").slice(i, j - i).take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[k] for r in rows], t) for k, t in ((1, item_type), (2, pa.int64()), (3, pa.int64())))], names=["__id", "__item", "n_shingles", "n_shared"])

    return run


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[int, bytes]]]:
    """The items with text, in blocks of at most block_bytes of text (or one item); one block is on the driver at a time."""
    block, size = [], 0
    rows = benchmark.where(F.col(text_col).isNotNull() & F.col(item_col).isNotNull()).select(item_col, text_col).toLocalIterator()
    for key, text in rows:
        raw = text.encode()
        if block and size + len(raw) > block_bytes:
            yield block
            block, size = [], 0
        block.append((key, raw))
        size += len(raw)
    if block:
        yield block


def contained_items(docs: DataFrame, benchmark: DataFrame, threshold: Fraction = Fraction(3, 4), width: int = WIDTH, block_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id_col, item_col, n_shingles, n_shared): the items of which a row holds the threshold's share of shingles, or more.

    Words are ASCII-lower-cased runs without white space. An item of fewer than width words is one shingle, looked for as a run
    of that many words. Null and empty texts and items, and items with a null id, find nothing; rows with a null id are
    reported under null; repeated rows are reported each. Documents are never shuffled: the index of a block of items goes to
    every task, its size bounded by block_bytes. More items mean more blocks over the same documents, one after another: what
    a block finds is written to the shared folder before the next block is read.
    """
    cut = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    id_kind, item_kind = cut.schema["__id"].dataType, benchmark.schema[item_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = f"__id {id_kind.simpleString()}, __item {item_kind.simpleString()}, n_shingles long, n_shared long"
    parts, blocks = [], item_blocks(benchmark, item_col, item_text_col, block_bytes)
    block = next(blocks, None)
    while block is not None:
        found = cut.mapInArrow(_search(Index(block, threshold, width), to_arrow_type(id_kind), to_arrow_type(item_kind)), schema)
        block = next(blocks, None)
        parts.append(found if block is None and not parts else written(found, "leaks"))
    out = functools.reduce(DataFrame.unionAll, parts) if parts else cut.sparkSession.createDataFrame([], schema)
    return out.select(F.col("__id").alias(id_col), F.col("__item").alias(item_col), "n_shingles", "n_shared")


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the rows whose id holds a benchmark item; rows with a null id stay."""
    leaks = contained_items(docs, benchmark, id_col=id_col, **options).select(F.col(id_col).alias("__leak")).distinct()
    leaks = written_small(leaks, "leaks")
    return docs.join(leaks, F.col(id_col) == F.col("__leak"), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = """
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
bw AS (SELECT item_id, w, least(5, len(w)) AS k FROM (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM benchmark) WHERE len(w) > 0),
d AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i+k-1], ' ') AS s FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM bw))),
b AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i+k-1], ' ') AS s FROM (SELECT item_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM bw)),
n AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, n_shared
FROM (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN b USING (k, s) GROUP BY doc_id, item_id) JOIN n USING (item_id)
WHERE 4 * n_shared >= 3 * n_shingles
"""
