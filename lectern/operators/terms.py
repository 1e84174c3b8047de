"""Terms of a dictionary of any size put into texts: runs of tokens joined with the dictionary, the leftmost and longest match first."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.notation import substitute_terms
from lectern.llm.store import written
from lectern.sources.dictionary import as_map

#: Up to so many terms are one pattern; up to so many are broadcast (a row is two short strings); more are shuffled.
PATTERN_TERMS, BROADCAST_TERMS = 1000, 200_000
#: Rows of a block at most: its texts share the terms that are found in them.
BLOCK_ROWS = 8192


def tokens(text: Column) -> Column:
    """array<string>: runs of word characters, and every other character by itself; put together they are the text."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\w+|\W"), F.lit(0))


def _lower(own: Column) -> Column:
    return F.transform(own, F.lower)


def _keyed(terms: DataFrame) -> DataFrame:
    """(key, n, spoken): a term's tokens in lower case, put together, and how many they are; of terms that differ in case one spelling stays."""
    own = tokens(F.col("term"))
    keyed = terms.where("term <> ''").select(F.array_join(_lower(own), "").alias("key"), F.size(own).alias("n"), "spoken")
    return keyed.groupBy("key", "n").agg(F.max("spoken").alias("spoken"))


def _letters(spark: SparkSession) -> dict[int, str]:
    """Every word character (its code) in lower case, as this JVM's version of Unicode has them: Python may have another."""
    codes = spark.range(1, 0x110000).where(~F.col("id").between(0xD800, 0xDFFF))
    chars = codes.select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    return {r["id"]: r["low"] for r in chars.where(F.col("c").rlike(r"(?U)^\w")).select("id", F.lower("c").alias("low")).collect()}


def _ranges(codes: list[int]) -> str:
    """The inside of a character class of the codes."""
    firsts = [c for c, before in zip(codes, [-2, *codes], strict=False) if c != before + 1]
    lasts = [c for c, after in zip(codes, [*codes[1:], -2], strict=True) if c + 1 != after]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(firsts, lasts, strict=True))


class _Scan:
    """Texts in runs of word characters and of others, and the runs of as many tokens as some term has, that begin and end where no word goes on."""

    def __init__(self, letters: dict[int, str], sizes: list[int], from_word: bool):
        codes = sorted(letters)
        near, far = ([c for c in codes if (c < 0x10000) == side] for side in (True, False))
        self.near, self.pattern = rf"([{_ranges(near)}]+)", rf"((?:[{_ranges(near)}]|[\U00010000-\U0010ffff](?<=[{_ranges(far)}]))+)"
        self.lower = {c: low for c, low in letters.items() if low != chr(c)}
        self.sizes, self.from_word = sorted(sizes, reverse=True), from_word
        self.words_only = from_word and self.sizes == [1]

    def split(self, text: str) -> tuple[list[str], list[str]]:
        """Runs of other characters and of word characters in turn, and the words in lower case."""
        own = re.split(self.pattern if re.search("[\U00010000-\U0010ffff]", text) else self.near, text)  # compiled once a process
        return own, [t.lower() if t.isascii() or "Σ" in t else t.translate(self.lower) for t in own[1::2]]  # of a sigma, lower case asks for its place

    def tokens(self, text: str) -> tuple[list[str], list[str], list[bool]]:
        """Words and single other characters, the same in lower case, and which are words."""
        out, small, words = [], [], []
        own, low = self.split(text)
        for k, t in enumerate(own):
            if k % 2:
                out.append(t), small.append(low[k // 2]), words.append(True)
            else:
                out.extend(t), small.extend(t), words.extend([False] * len(t))
        return out, small, words

    def at(self, p: int, low: list[str], words: list[bool]) -> Iterator[tuple[int, str]]:
        """(n, key) of the runs from token p on, the longest first."""
        if not words[p] and (self.from_word or (p and words[p - 1])):
            return
        for n in self.sizes:
            end = p + n
            if end <= len(low) and (words[end - 1] or end == len(low) or not words[end]):
                yield n, low[p] if n == 1 else "".join(low[p:end])

    def keys(self, text: str) -> Iterator[str]:
        if self.words_only:
            yield from self.split(text)[1]
            return
        _, low, words = self.tokens(text)
        for p in range(len(low)):
            for _, key in self.at(p, low, words):
                yield key

    def put(self, text: str, spoken: dict[str, str]) -> str:
        """The text with the leftmost and longest runs that the dictionary has put in."""
        if self.words_only:
            own, low = self.split(text)
            own[1::2] = map(spoken.get, low, own[1::2])
            return "".join(own)
        own, low, words = self.tokens(text)
        out, p = [], 0
        while p < len(own):
            n, said = next(((n, spoken[key]) for n, key in self.at(p, low, words) if key in spoken), (1, own[p]))
            out.append(said)
            p += n
        return "".join(out)


def _keys_of(scan: _Scan, most: int = 100_000):
    """(block, key) of (block, text), once for each stretch of rows of a block, or of so many keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, block = set(), None
        taken = lambda: pa.RecordBatch.from_arrays([pa.array([block] * len(found), pa.int64()), pa.array(list(found), pa.string())], names=["block", "key"])
        for batch in batches:
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if found and (own != block or len(found) > most):
                    yield taken()
                    found = set()
                block = own
                found.update(scan.keys(text.as_py()))
        yield taken()

    return run


def _put_in(scan: _Scan, text_col: str, names: list[str]):
    """Rows in order of block, the terms of a block ahead of its texts: the texts with these put in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, spoken = None, {}
        for batch in batches:
            texts, kept = [], []
            blocks, keys, said, own = (batch.column(n) for n in ("__block", "__key", "__spoken", text_col))
            for i, (at, key, new) in enumerate(zip(blocks.to_pylist(), keys.to_pylist(), said.to_pylist(), strict=True)):
                if at != block:
                    block, spoken = at, {}
                if key is not None:
                    spoken[key] = new
                else:
                    kept.append(i)
                    texts.append(scan.put(own[i].as_py(), spoken) if own[i].is_valid else None)
            left = batch.select([n for n in names if n != text_col] or ["__block"]).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == text_col else left.column(n) for n in names], names=names)

    return run


def substituted(rows: DataFrame, terms: DataFrame, text_col: str = "text", pattern_terms: int = PATTERN_TERMS, broadcast_terms: int = BROADCAST_TERMS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows with the terms (term, spoken) in text_col put in: whole words, whatever their case, the longest first; what is put in isn't read again.

    A small dictionary is a pattern in the row. A larger one is joined: the rows are written in blocks, the distinct runs of tokens of
    a block, as long as some term, are joined with the dictionary (broadcast up to broadcast_terms terms, shuffled beyond), and what is
    found goes to the block ahead of its texts. So a frequent word is a row for each block, not for each place where it stands, and no
    task holds more terms than a block of texts has. A null text stays null; an empty dictionary changes nothing.
    """
    small = as_map(terms, pattern_terms)
    if small is not None:
        return rows.withColumn(text_col, substitute_terms(F.col(text_col), small))
    keyed = written(_keyed(terms), "terms")
    sizes = {r["n"]: r for r in keyed.groupBy("n").agg(F.count("*").alias("terms"), F.min(F.col("key").rlike(r"(?U)^\w")).alias("from_word")).collect()}  # as many as the longest term has tokens, at most
    if not sizes:
        return rows
    scan = _Scan(_letters(rows.sparkSession), [*sizes], all(r["from_word"] for r in sizes.values()))
    if sum(r["terms"] for r in sizes.values()) <= broadcast_terms:
        keyed = F.broadcast(keyed)
    blocks = written(rows.withColumn("__block", F.floor(F.monotonically_increasing_id() / block_rows)), "term-texts")
    runs = blocks.where(F.col(text_col).isNotNull()).select("__block", text_col).mapInArrow(_keys_of(scan), "block long, key string").distinct()
    found = runs.join(keyed.where("spoken IS NOT NULL").select("key", "spoken"), "key").select(F.col("block").alias("__block"), F.col("key").alias("__key"), F.col("spoken").alias("__spoken"))
    dealt = blocks.unionByName(found, allowMissingColumns=True).repartition("__block").sortWithinPartitions("__block", F.col("__key").isNull())
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return dealt.mapInArrow(_put_in(scan, text_col, rows.columns), kinds)
