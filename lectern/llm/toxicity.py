"""Toxicity by compression distance: Zstandard dictionaries of toxic and of ordinary text, compared window by window.

The ordinary dictionary is trained on all windows of ordinary texts. The toxic one is trained on what toxic texts have and ordinary
texts lack: the passages that are left when every byte n-gram that is about as common in ordinary texts is taken out, each
as often as it occurs. It goes before the ordinary content, so both explain ordinary text equally well, and a window
compresses better with the toxic dictionary only by what it shares with those passages. A third dictionary has also the passages of rarer
wording, of which a single text is enough; what they are worth is left to the calibration, which sees their gains apart. Each
text's windows are counted by how many bytes they gain from either, at several thresholds, and a logistic curve calibrated on
labelled texts turns the counts into a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm import features as X
from lectern.llm import words as W
from lectern.llm.store import table, written

WINDOW = 12  # words
GRAM, GRAMS = 5, (5, 9)  # bytes; the longer ones find words made of common syllables
GAINS = (1, 2, 3, 5, 8)
BUCKETS = 1 << 22


def normalised(text: bytes) -> bytes:
    """ASCII-lower-cased words with single spaces between and around."""
    return b" " + b" ".join(text.lower().split()) + b" "


def windows(text: bytes) -> np.ndarray:
    """(offset, length) of the windows of a normalised text: WINDOW words each, the last one maybe fewer; all words are covered."""
    space = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    start = space[: max(1, len(space) - 1) : WINDOW]
    end = np.append(start[1:], len(text) - 1)
    return np.stack([start, end + 1 - start], axis=1).astype(np.uint64)


def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    made.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False)


class Distance:
    """The three dictionaries, each with the content of the one before; compressors are made once in each Python process."""

    def __init__(self, rare: bytes, toxic: bytes, ordinary: bytes, level: int):
        self.rare, self.toxic, self.ordinary, self.level = rare, toxic, ordinary, level

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "ready"}

    def gains(self, texts: list[bytes]) -> list[np.ndarray]:
        """Bytes that each window of each normalised text gains with the toxic dictionary, and with the rare passages beyond that: two rows."""
        if not hasattr(self, "ready"):
            contents = self.ordinary, self.toxic + self.ordinary, self.rare + self.toxic + self.ordinary
            self.ready = [_compressor(c, self.level) for c in contents]
        parts = [windows(t) for t in texts]
        shift = np.cumsum([0] + [len(t) for t in texts])
        cuts = np.concatenate(parts)
        cuts[:, 0] += np.repeat(shift[:-1], [len(p) for p in parts]).astype(np.uint64)
        whole = zstandard.BufferWithSegments(b"".join(texts), np.ascontiguousarray(cuts).tobytes())
        sizes = [np.fromiter((len(x) for x in c.multi_compress_to_buffer(whole)), np.int64, len(cuts)) for c in self.ready]
        return np.split(np.stack([sizes[0] - sizes[1], sizes[1] - sizes[2]]), np.cumsum([len(p) for p in parts])[:-1], axis=1)


def gain_features(gain: np.ndarray) -> np.ndarray:
    n = gain.shape[1]
    hits = np.array([(own >= g).sum() for own in gain for g in GAINS], float)
    return np.concatenate([[1.0], np.log1p(hits), 3 * hits / (n + 5), [np.log1p(n)]])


def _grams(text: bytes, size: int = GRAM) -> np.ndarray:
    a = np.frombuffer(text, np.uint8).astype(np.uint64)
    h = np.zeros(max(0, len(a) - size + 1), np.uint64)
    for k in range(size):
        h = h * np.uint64(1000003) + a[k : len(h) + k]
    return (W.mix(h) >> np.uint64(42)).astype(np.int64)


def _passages(covered: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the runs of marked bytes; covered has a byte more at both ends."""
    turn = np.diff(covered)
    return [*zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist(), strict=True)]


def _cover(covered: np.ndarray, found: np.ndarray, size: int) -> None:
    at = np.flatnonzero(found)
    for k in range(size):
        covered[at + k + 1] = 1


def _text_counts(texts: list[bytes], size: int) -> np.ndarray:
    """In how many texts each n-gram is."""
    out = np.zeros(BUCKETS, np.int32)
    for t in texts:
        out[np.unique(_grams(t, size))] += 1
    return out


def distinctive(toxic: list[bytes], ordinary: list[bytes], size: int = 64 << 10, ratio: float = 20.0, least: float = 0.02) -> tuple[list[bytes], list[bytes]]:
    """Passages of toxic texts made of n-grams found ratio times as often as in ordinary ones: common and rare ones.

    Common: made of n-grams of that share of the texts (five at least), of either length, and seen three times; each as often as it
    is seen. Rare: any others, whose n-grams are in most toxic texts first, each with an n-gram that none before it has,
    until they have size bytes.
    """
    covered = [np.zeros(len(t) + 2, np.int8) for t in toxic]
    for n in GRAMS:
        ours, theirs = _text_counts(toxic, n), _text_counts(ordinary, n)
        found = (ours >= max(5, least * len(toxic))) & (ours / max(1, len(toxic)) >= ratio * (theirs + 1) / max(1, len(ordinary)))
        for t, c in zip(toxic, covered, strict=True):
            _cover(c, found[_grams(t, n)], n)
    seen_in = [t[s:e] for t, c in zip(toxic, covered, strict=True) for s, e in _passages(c)]
    passages = Counter(seen_in)
    common = [p for p in seen_in if passages[p] >= 3]

    ours, theirs = _text_counts(toxic, GRAM), _text_counts(ordinary, GRAM)
    seen = np.zeros(BUCKETS, np.bool_)
    for p in set(common):
        seen[_grams(p)] = True
    found = (ours > 0) & (ours / max(1, len(toxic)) >= ratio * theirs / max(1, len(ordinary))) & ~seen
    worth: dict[bytes, float] = {}
    for t in toxic:
        grams, own = _grams(t), np.zeros(len(t) + 2, np.int8)
        _cover(own, found[grams], GRAM)
        for s, e in _passages(own):
            if (p := t[s:e]) not in worth:
                some = grams[s : e - GRAM + 1]
                worth[p] = float(ours[some[found[some]]].mean())
    rare, room = [], size
    for p in sorted(worth, key=lambda p: (-worth[p], p)):
        if room <= 0:
            break
        grams = _grams(p)
        if not seen[grams].all():
            seen[grams] = True
            rare.append(p)
            room -= len(p)
    return common, rare


def trained(samples: list[bytes], size: int, level: int, segment: int) -> bytes:
    """The content of a Zstandard dictionary trained on the samples; a single blank without samples.

    The trainer needs a few samples of eight bytes: what is shorter is padded, and all are repeated until there are enough. That
    changes no frequencies.
    """
    if not samples:
        return b" "
    samples = [s.ljust(8) for s in samples]
    samples *= max(1, -(-64 // len(samples)), -(-(16 << 10) // sum(map(len, samples))))
    return zstandard.train_dictionary(size, samples, k=segment, d=8, level=level).as_bytes()


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted ridge logistic regression by Newton's method."""
    w, keep = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + keep, x.T @ (weight * (p - y)) + keep @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, distance: Distance, weights: np.ndarray):
        self.distance, self.weights = distance, weights

    def score(self, texts: list[bytes]) -> np.ndarray:
        x = np.stack([gain_features(g) for g in self.distance.gains([normalised(t) for t in texts])])
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def train(toxic: list[bytes], ordinary: list[bytes], odds: float = 1.0, dictionary_bytes: int = 64 << 10, level: int = 6) -> Model:
    """Dictionaries from half of each class's texts, the curve calibrated on the other half (or on the same text where a class has one).

    odds is how many labelled ordinary texts a given one stands for, per toxic one: its root weighs the ordinary class.
    """
    toxic, ordinary = [normalised(t) for t in toxic], [normalised(t) for t in ordinary]
    learn, held_of = [t[::2] for t in (toxic, ordinary)], [t[1::2] or t for t in (toxic, ordinary)]
    base = trained([bytes(t[s : s + n]) for t in learn[1] for s, n in windows(t).tolist()], dictionary_bytes, level, 64)
    common, rare = distinctive(*learn, dictionary_bytes)
    distance = Distance(b"".join(reversed(rare)) or b" ", trained(common, dictionary_bytes, level, 24), base, level)
    held = held_of[0] + held_of[1]
    y = np.array([1.0] * len(held_of[0]) + [0.0] * len(held_of[1]))
    x = np.stack([gain_features(g) for k in range(0, len(held), 256) for g in distance.gains(held[k : k + 256])])
    return Model(distance, logistic(x, y, np.where(y == 1, 1.0, odds**0.5)))


def spread(text: bytes, size: int, piece: int = 4096) -> bytes:
    """The text if it has size bytes at most; else pieces of it, evenly spread from its start to its end, cut at white space, of so many bytes together."""
    if len(text) <= size:
        return text
    out = []
    for start in np.linspace(0, len(text) - piece, max(1, size // (piece + 1))).astype(int):
        own = text[start : start + piece]
        words = own.split()
        whole = words[int(start > 0 and len(words) > 1) : len(words) - 1 if start + piece < len(text) and len(words) > 2 else None]
        out.append(b" ".join(whole).decode(errors="ignore").encode())
    return b" ".join(out)


def _spread(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text = spread(batch.column("text")[k].as_py().encode(), size).decode()
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(k, 1), batch.column("label").slice(k, 1), pa.array([text], pa.string())], names=["id", "label", "text"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 2000, class_bytes: int = 64 << 20, text_bytes: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """A model of a bounded sample of labelled texts; None without both classes.

    Of each class at most per_class ids (see features.labelled_texts), in order of a hash of the id until their texts have
    class_bytes together, but one at least. Of a text of more than text_bytes, pieces spread evenly over it count.
    """
    rows, weight = X.labelled_texts(docs, labels, label, per_class, id_col, text_col)
    rows = rows.mapInArrow(_spread(text_bytes), "id string, label int, text string")
    rows = written(rows.withColumn("size", F.octet_length("text").cast("long")).withColumn("place", F.xxhash64("id")), "labelled")
    order = Window.partitionBy("label").orderBy("place", "id").rowsBetween(Window.unboundedPreceding, 0)
    fits = rows.select("id", "label", (F.sum("size").over(order) - F.col("size")).alias("before")).where(F.col("before") < class_bytes).select("id", "label")
    got = rows.join(F.broadcast(fits), ["id", "label"]).select("id", "label", "text").collect()
    got.sort(key=lambda r: (r["id"], r["text"]))
    sides = [[r["text"].encode() for r in got if r["label"] == k] for k in (1, 0)]
    return train(*sides, odds=weight[0] / weight[1]) if all(sides) else None


def _score(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, joined, at in W.slices(batch.column("__text"), 1 << 20):
                texts = [joined[at[d] : at[d + 1] - 1] for d in range(j - i)]
                names = [n for n in batch.schema.names if n != "__text"]
                kept = [batch.column(n).slice(i, j - i) for n in names]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(model.score(texts) if model else np.zeros(j - i))], names=[*names, "score"])

    return run


def score_toxicity(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score for each row; null and empty texts are one window without words; without a model every score is 0.

    Repeated rows are scored each; texts of any length are read whole; an empty table gives no rows; other columns are not read.
    """
    cut = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    kind = cut.schema[id_col].dataType.simpleString()
    return cut.mapInArrow(_score(model), f"`{id_col}` {kind}, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").where(X.crc_bucket("doc_id", 5) != 0))
    held_out = X.crc_bucket("doc_id", 5) == 0
    return score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
