r"""How filters interact: what each of five removes in every order in which they can be applied.

Repeats are found by a counting Bloom filter over all texts: what it shows to be unique never shuffles its text; the rest is
compared whole. Each document then is a mask of the filters that it fails, and every figure is a sum over counts of masks.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.store import broadcast_if_small, table, written

FILTERS = "ABCDE"
BIT = {f: 1 << k for k, f in enumerate(FILTERS)}
#: A segment of the sketch has so many counters, for so many rows; all counters of a text are in one segment.
COUNTERS, ROWS, HASHES = 4096, 256, 4
#: Cells (segment and place) that a task gathers before it hands on their counts.
CELLS = 1 << 20


def failures(text: Column) -> Column:
    """The mask of A to D that a text fails; E depends on other texts."""
    n_capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))

    def mask(words: Column) -> Column:
        own = {
            "A": F.size(words) < 200,
            "B": F.lit(100).cast("long") * F.size(F.array_distinct(words)) < F.lit(50).cast("long") * F.size(words),
            "C": F.lit(100).cast("long") * n_capitals > F.lit(3).cast("long") * F.length(text),
            "D": text.rlike(r"[#$%&*|]"),
        }
        return sum((F.when(fails, BIT[f]).otherwise(0) for f, fails in own.items()), F.lit(0))

    return F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))), mask), F.lit(0))


def _cells(segment: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Each row's cells, a row of HASHES numbers: places are twelve bits of g each."""
    places = (g[:, None] >> (12 * np.arange(HASHES))) & (COUNTERS - 1)
    return segment[:, None] * COUNTERS + places


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the cells of a part of the rows, a row for each segment. A text that hits a cell twice counts once in it."""
    held: list[np.ndarray] = []
    n = 0

    def handed_on() -> pa.RecordBatch:
        cells, counts = np.unique(np.concatenate(held), return_counts=True)
        cut = np.flatnonzero(np.diff(cells // COUNTERS, prepend=-1))
        ends = np.append(cut[1:], len(cells))
        place, count = (cells % COUNTERS).astype("<u2"), np.minimum(counts, 255).astype(np.uint8)
        arrays = [pa.array(cells[cut] // COUNTERS, pa.int64()), *(pa.array([x[i:j].tobytes() for i, j in zip(cut, ends, strict=True)], pa.binary()) for x in (place, count))]
        return pa.RecordBatch.from_arrays(arrays, names=["segment", "places", "counts"])

    for batch in batches:
        cells = np.sort(_cells(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)), axis=1)
        first = np.ones(cells.shape, bool)
        first[:, 1:] = cells[:, 1:] != cells[:, :-1]
        held.append(cells[first])
        n += len(held[-1])
        if n >= CELLS:
            yield handed_on()
            held, n = [], 0
    if n:
        yield handed_on()


def _merged(part: pa.Table) -> pa.Table:
    """One segment's counters, a byte each, which stay at 255 once they are there."""
    total = np.zeros(COUNTERS, np.int64)
    for places, counts in zip(part.column("places").to_pylist(), part.column("counts").to_pylist(), strict=True):
        total[np.frombuffer(places, "<u2")] += np.frombuffer(counts, np.uint8)
    return pa.table({"segment": part.column("segment").slice(0, 1), "counters": pa.array([np.minimum(total, 255).astype(np.uint8).tobytes()], pa.binary())})


def sketch(rows: DataFrame) -> DataFrame:
    """(segment, counters) of (segment, g): sums of the tasks' sketches. A part of a segment is at most one row a task and CELLS cells, however many copies a text has."""
    parts = rows.select("segment", "g").mapInArrow(_partial, "segment long, places binary, counts binary")
    return written(parts.groupBy("segment").applyInArrow(_merged, "segment long, counters binary"), "sketch")


def _repeats(rows: DataFrame) -> DataFrame:
    """The distinct h of rows (h) that the sketch doesn't show to be unique. Segments follow the number of rows, so there are as few false ones at any size."""
    n = max(1, math.ceil(rows.count() / ROWS))
    placed = rows.select("h", F.pmod(F.xxhash64("h", F.lit(1)), F.lit(n)).alias("segment"), F.xxhash64("h", F.lit(2)).alias("g"))
    counters = sketch(placed)
    several = F.lit(True)
    for k in range(HASHES):
        place = F.shiftright("g", 12 * k).bitwiseAND(F.lit(COUNTERS - 1)).cast("int")
        several &= F.substring(F.col("counters"), place + 1, F.lit(1)) >= F.lit(bytearray(b"\x02"))
    return written(placed.distinct().join(broadcast_if_small(counters, 4096), "segment").where(several).select("h"), "possible-repeats")


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", address: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, part, mask): each row's part and the mask of filters it fails.

    One pass over the texts keeps a row of numbers for each; a second one reads those that may repeat, and shuffles their texts, combined
    before, for the least id of each whole text. Texts that share an address are told apart there and joined by the text itself.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("t")).withColumn("h", address(F.col("t")))
    own = written(texts.select("doc_id", "part", "h", failures(F.col("t")).alias("mask")), "masks")
    possible = broadcast_if_small(_repeats(own))
    least = texts.join(possible, "h", "left_semi").groupBy("h", "t").agg(F.min("doc_id").alias("least"))
    firsts = written(least.groupBy("h").agg(F.count("*").alias("texts"), F.min("least").alias("least")), "first-ids")
    several = firsts.where("texts > 1").select("h")
    later = lambda of: F.col("mask").bitwiseOR(F.when(F.col("doc_id") > F.col(of), BIT["E"]).otherwise(0)).alias("mask")
    out = own.join(broadcast_if_small(firsts.where("texts = 1").select("h", "least")), "h", "left").select("doc_id", "part", "h", later("least"))
    if not several.count():
        return out.drop("h")
    few = broadcast_if_small(written(several, "shared-addresses"))
    told = least.join(few, "h", "left_semi")
    again = texts.join(few, "h", "left_semi").withColumn("mask", failures(F.col("t"))).join(told.select("h", "t", "least"), ["h", "t"])
    return out.join(few, "h", "left_anti").drop("h").unionByName(again.select("doc_id", "part", later("least")))


def counted_masks(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each mask, and how many are labelled good and toxic. An id's labels count once, as 1 if any row of it says so."""
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    known = broadcast_if_small(written(known.where("good = 1 or toxic = 1"), "marked"))
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c)
    return rows.join(known, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), total("good"), total("toxic"))


def _steps() -> list[tuple[str, int, int, int]]:
    """(order, step, bit, mask of the filters before) of all 120 orders."""
    return [("".join(p), k + 1, BIT[f], sum(BIT[e] for e in p[:k])) for p in itertools.permutations(FILTERS) for k, f in enumerate(p)]


def audit(counts: DataFrame) -> DataFrame:
    """A row for each part, order and step of (part, mask, n, good, toxic), zeros included.

    What a step does depends on its filter and the set of those before, so sums are made for these 80 cases and then dealt to
    the 600 steps. Over all orders a filter stands behind the same set in (size)! (4 - size)! of them.
    """
    cases = sorted({(bit, before) for _, _, bit, before in _steps()})
    weight = [math.factorial(b.bit_count()) * math.factorial(4 - b.bit_count()) for _, b in cases]
    case = F.explode(F.array(*[F.struct(F.lit(b).alias("bit"), F.lit(s).alias("before"), F.lit(w).cast("long").alias("weight")) for (b, s), w in zip(cases, weight, strict=True)]))
    rows = counts.withColumn("case", case).select("part", "mask", "n", "good", "toxic", "case.*")
    fails, earlier = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda cond, of="n": F.sum(F.when(cond, F.col(of)).otherwise(0))
    sums = rows.groupBy("part", "bit", "before", "weight").agg(
        total(~fails & ~earlier).alias("kept"), total(fails & ~earlier).alias("removed"), total(fails & earlier).alias("redundant"), total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~earlier, "good").alias("good_lost"), total(fails & ~earlier, "toxic").alias("toxic_lost"),
    )
    shapley = sums.groupBy("part", "bit").agg(F.sum(F.col("removed") * F.col("weight")).alias("shapley"))
    steps = F.broadcast(counts.sparkSession.createDataFrame(_steps(), "filter_order string, step int, bit int, before int"))
    return sums.join(shapley, ["part", "bit"]).join(steps, ["bit", "before"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The audit of docs: a row for each part, order of the five filters and step.

    A null text counts as empty and a null part as the empty string; rows that repeat an id are counted each and don't fail E by each
    other; a row with a null id never fails E nor makes another fail, and has no labels. Texts of any length are read whole; ties
    can't arise; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    return audit(counted_masks(masks(docs, id_col, text_col, part_col), labels, id_col))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
f AS (SELECT part, doc_id,
    len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b, 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c,
    regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > least, false) AS e FROM w),
m AS (SELECT part, [a, b, c, d, e] AS fails, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad FROM f LEFT JOIN labels USING (doc_id)),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE bad) AS bad FROM m GROUP BY ALL),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
p AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT array_to_string(list_transform(o, lambda k: 'ABCDE'[k]), '') AS filter_order, x.i AS step, o[x.i] AS f, o[1:x.i - 1] AS before FROM p, x),
r AS (SELECT *, g.fails[s.f] AS own, len(list_filter(s.before, lambda k: g.fails[k])) > 0 AS earlier, len(list_filter(g.fails, lambda v: v)) AS n_fails FROM g, s),
z AS (SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (WHERE NOT own AND NOT earlier), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE own AND NOT earlier), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE own AND earlier), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE own AND n_fails = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE own AND NOT earlier), 0)::BIGINT AS good_lost, coalesce(sum(bad) FILTER (WHERE own AND NOT earlier), 0)::BIGINT AS toxic_lost
  FROM r GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM z
"""
