"""Languages by trigram profiles: counts and dot products over the code points of a batch of texts, so no row stands for a character."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.notation import let

#: A profile holds the trigrams that make up this share of its language's text, or more: so many at most.
SHARE = 1000
#: Trigrams of all profiles up to which they go to every task (some 8 bytes each and 8 for each language).
ROW_TRIGRAMS = 200_000
#: Code points looked at together, and what stands behind each text: no code point.
TOGETHER, END = 1 << 20, (1 << 21) - 1


def trigrams(text: Column) -> Column:
    """array<string>: every three characters of the text in lower case; in one pass, where substrings would start over each time."""
    return F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(...))"), F.lit(1))


def counted(items: Column) -> Column:
    """array<struct<item, n>>: how often each distinct item occurs, as runs of the sorted array."""

    def runs(own: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: (i == 0) | (F.get(own, i) != F.get(own, i - 1)))
        size = lambda s, k: F.transform(s, lambda at, i: F.struct(F.get(own, at).alias("item"), (F.coalesce(F.get(s, i + 1), F.size(own)) - at).cast("long").alias("n")))
        return F.when(F.size(own) > 0, let(starts, lambda s: size(s, own))).when(own.isNotNull(), F.array().cast("array<struct<item:string,n:bigint>>"))

    return let(F.array_sort(items), runs)


def _groups(texts: list[str]) -> Iterator[list[str]]:
    """The texts in order, in groups of some TOGETHER code points; a longer text is a group of its own."""
    group, n = [], 0
    for t in texts:
        if group and n + len(t) > TOGETHER:
            yield group
            group, n = [], 0
        group.append(t)
        n += len(t) + 1
    if group:
        yield group


def _packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The trigram at each code point of the texts as one number, -1 at a text's last two and at its end; and where each text starts."""
    end = np.array([END], "<u4")
    own = np.concatenate([*[x for t in texts for x in (np.frombuffer(t.encode("utf-32-le"), "<u4"), end)], end, end]).astype("int64")
    out = own[:-2] << 42 | own[1:-1] << 21 | own[2:]
    ends = own == END
    out[ends[:-2] | ends[1:-1] | ends[2:]] = -1
    return out, np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])


def _trigram_counts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for lang, texts in part.groupby("lang")["text"]:
            for group in _groups(list(texts)):
                found, n = np.unique(_packed(group)[0], return_counts=True)
                found, n = found[found >= 0], n[found >= 0]
                own = np.stack([found >> 42, found >> 21 & END, found & END], 1).astype("<u4").tobytes().decode("utf-32-le")
                yield pd.DataFrame({"lang": lang, "g": [own[k : k + 3] for k in range(0, len(own), 3)], "n": n})


def profiles(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """(lang, g, w) of (lang, text): the trigrams of each language of a share of its text or more, and their hundred-thousandths of it.

    Texts are counted in batches; only distinct trigrams are shuffled, combined before. Null languages and texts have no part.
    """
    texts = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", F.lower("text").alias("text"))
    counts = texts.mapInPandas(_trigram_counts, "lang string, g string, n bigint").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    return counts.join(total, "lang").where(F.col("n") * share >= F.col("total")).select("lang", "g", F.floor(F.col("n") * 100000 / F.col("total")).alias("w"))


def best_language(profile: list[tuple[str, str, int]]):
    """A function of a text in lower case: the language of most summed weight of its trigrams (of equal ones the last); null where it shares none with a profile."""
    langs = sorted({lang for lang, _, _ in profile})
    keys, at = np.unique(_packed([g for _, g, _ in profile])[0][::4] if profile else np.zeros(0, "int64"), return_inverse=True)
    weights = np.zeros((len(langs), len(keys) + 1), "int64")  # the last is of no trigram
    for (lang, _, w), k in zip(profile, at, strict=True):
        weights[langs.index(lang), k] = w

    def of(texts: list[str]) -> list[str | None]:
        own, starts = _packed(texts)
        near = np.searchsorted(keys, own)
        hit = np.append(keys, -2)[near] == own
        near[~hit] = len(keys)
        scores = np.stack([np.add.reduceat(w[near], starts) for w in weights])
        top = len(langs) - 1 - scores[::-1].argmax(0)
        return [langs[k] if score > 0 else None for k, score in zip(top, scores.max(0), strict=True)]

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out = pd.Series(None, part.index, dtype=object)
            full = part[part.notna()]
            if langs and len(full):
                out[full.index] = [x for group in _groups(list(full)) for x in of(group)]
            yield out

    return F.pandas_udf(run, "string")


def line_languages(docs: DataFrame, profile: DataFrame, least: int = 40, row_trigrams: int = ROW_TRIGRAMS) -> DataFrame:
    """(doc_id, line, lang) of (doc_id, text): the best language of each line of least characters or more; null for shorter ones and those unlike any profile.

    Up to row_trigrams entries the profiles go to every task, and lines are dot products in batches. Beyond, a line's distinct trigrams are
    joined with the profiles.
    """
    few = profile.limit(row_trigrams + 1).collect()  # counted once; a bounded table
    long = lambda line: F.length(F.trim(line)) >= least
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    if len(few) <= row_trigrams:
        low = F.when(long(F.col("text")), F.lower("text"))
        return lines.select("doc_id", "line", best_language([(r.lang, r.g, r.w) for r in few])(low).alias("lang"))
    met = lines.where(long(F.col("text"))).select("doc_id", "line", F.explode(counted(trigrams(F.col("text")))).alias("own")).join(profile, F.col("own.item") == F.col("g"))
    scores = met.groupBy("doc_id", "line", "lang").agg(F.sum(F.col("own.n") * F.col("w")).alias("score"))
    best = scores.groupBy("doc_id", "line").agg(F.max_by("lang", F.struct("score", "lang")).alias("lang"))
    return lines.select("doc_id", "line").join(best, ["doc_id", "line"], "left")
