"""Quality rules as weak supervision: rules vote or abstain, EM estimates their accuracies, a posterior decides."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import words as W
from lectern.llm.store import table, written

SYMBOLS = np.zeros(256, np.bool_)
SYMBOLS[list(b"#*$%&|<>")] = True
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_letters long, n_lines long"


def repeated_words(words: np.ndarray, first: np.ndarray, k: int = 3) -> list[int]:
    """Per text, the words that lie in a k-word window found twice or more in that text."""
    h, begin = W.window_hashes(words, first, k)
    out = []
    for d in range(len(first) - 1):
        own = h[begin[d] : begin[d + 1]]
        if len(own) < 2:
            out.append(0)
            continue
        order = np.argsort(own, kind="stable")
        same = own[order][1:] == own[order][:-1]
        if not same.any():
            out.append(0)
            continue
        twice = np.zeros(len(own), np.bool_)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(len(own) + k - 1, np.bool_)
        for i in range(k):
            covered[i : i + len(own)] |= twice
        out.append(int(covered.sum()))
    return out


def _dup_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and lines with a word."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines)), len(lines)


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[at[1:] - 1] - total[at[:-1]]


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, joined, at in W.slices(batch.column("__text")):
            b = np.frombuffer(joined, np.uint8)
            at = at.copy()
            words, first = W.word_hashes(joined, at, lower=False)
            upper = (b >= 65) & (b <= 90)
            lines = [_dup_lines(joined[at[d] : at[d + 1] - 1]) for d in range(j - i)]
            columns = [
                np.diff(first),
                _sums(~W.SPACE[b] & ((b & 0xC0) != 0x80), at),
                _sums(SYMBOLS[b], at),
                [x[0] for x in lines],
                repeated_words(words, first),
                _sums(upper, at),
                _sums(upper | ((b >= 97) & (b <= 122)), at),
                [x[1] for x in lines],
            ]
            kept = batch.slice(i, j - i)
            names = [n for n in batch.schema.names if n != "__text"]
            arrays = [kept.column(n) for n in names] + [pa.array(c, pa.int64()) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, names=names + [x.split()[0] for x in STATS.split(", ")])


def quality_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the counts of STATS for each row, read in one pass over the text; a null text has no words."""
    cut = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    kind = cut.schema[id_col].dataType.simpleString()
    return cut.mapInArrow(_stats, f"`{id_col}` {kind}, {STATS}")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: Outcomes of a rule, and what each is expected to be before any data: P(outcome | good), P(outcome | bad).
BAD, GOOD, ABSTAIN = 0, 1, 2
EXPECTED = ((0.1, 0.6, 0.3), (0.3, 0.4, 0.3))


def rules() -> dict[str, Column]:
    """The outcome of each rule: bad, good, or an abstention where its evidence is unclear.

    Defects have a sensitive rule, which is often wrong about clean texts, and a strict one, which never says good; what a vote is
    worth is for the estimation to find out.
    """
    n, share = F.greatest(F.col("n_words"), F.lit(1)), lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    symbols, dups, repeats, upper, mean_length = F.col("n_symbols") / n, share("n_dup_lines", "n_lines"), F.col("n_repeat_words") / n, share("n_upper", "n_letters"), F.col("word_chars") / n

    def vote(bad: Column, good: Column | None = None) -> Column:
        found = F.when(bad, F.lit(BAD))
        return (found if good is None else found.when(good, F.lit(GOOD))).otherwise(F.lit(ABSTAIN))

    return {
        "length": vote(F.col("n_words") < 80, F.col("n_words") >= 120),
        "word_length": vote((mean_length < 3.5) | (mean_length > 6.3), mean_length.between(4.2, 6.0)),
        "symbols": vote(symbols > 0.05, symbols <= 0.01),
        "many_symbols": vote(symbols > 0.2),
        "duplicate_lines": vote(dups > 0.3, (dups == 0) & (F.col("n_lines") >= 3)),
        "many_duplicate_lines": vote(dups > 0.5),
        "repetition": vote(repeats > 0.15, repeats <= 0.05),
        "much_repetition": vote(repeats > 0.4),
        "upper_case": vote(upper > 0.1, upper <= 0.06),
        "much_upper_case": vote(upper > 0.4),
    }


def posterior(votes: tuple[int, ...], prior: float, chances: list[tuple]) -> float:
    """P(good | votes), the rules being independent given the class; a rule that abstains says nothing."""
    odds = math.log(prior) - math.log1p(-prior) + sum(math.log(good[v] / bad[v]) for v, (good, bad) in zip(votes, chances, strict=True) if v != ABSTAIN)
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], int]], size: int, rounds: int = 300, prior: float = 0.8, strength: float = 5.0) -> tuple[float, list[tuple]]:
    """(P(good), per rule P(outcome | good) and P(outcome | bad)) from counts of vote patterns: Dawid-Skene by EM.

    All rules start alike, as EXPECTED, so the first verdicts are a weighted majority of the votes. The class balance is estimated
    too; prior is its start, worth ten texts. EXPECTED, worth strength texts of each class, keeps every chance above zero.
    Without patterns the start is returned.
    """
    chances: list[tuple] = [EXPECTED] * size
    for _ in range(rounds):
        seen = [[[strength * x for x in side] for side in EXPECTED] for _ in range(size)]
        mass, total = 10 * prior, 10.0
        for votes, count in patterns:
            p = posterior(votes, prior, chances)
            mass, total = mass + p * count, total + count
            for side, weight in ((0, p * count), (1, (1 - p) * count)):
                for k, v in enumerate(votes):
                    seen[k][side][v] += weight
        new = [tuple(tuple(x / sum(side) for x in side) for side in both) for both in seen]
        moved = max([abs(x - y) for p, q in zip(chances, new, strict=True) for a, b in zip(p, q, strict=True) for x, y in zip(a, b, strict=True)], default=0)
        chances, prior = new, mass / total
        if moved < 1e-9:
            break
    return prior, chances


def quality_rules(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts, base_failed, quality_posterior, kept, and bad_votes, the number of rules that voted bad.

    kept is false where base_failed, else whether the posterior probability of quality is at least the threshold, so a bad vote of
    a rule found unreliable, or one that the others outweigh, drops nothing. Nulls and empty texts have no words and so fail;
    repeated rows are counted and judged as rows; an empty table gives no rows. Texts are read once, the counts are
    written to the shared folder, and only counts of vote patterns (3 ** 6 * 2 ** 4 at most) come to the driver.
    """
    stats = written(quality_stats(docs, id_col, text_col), "quality-stats")
    named = rules()
    counts = stats.groupBy(*[c.alias(f"__{n}") for n, c in named.items()]).count().collect()
    prior, chances = expectation_maximisation(sorted((tuple(r)[:-1], r["count"]) for r in counts), len(named))
    odds = F.lit(math.log(prior) - math.log1p(-prior))
    for outcome, (good, bad) in zip(named.values(), chances, strict=True):
        odds = odds + F.element_at(F.array(*[F.lit(0.0 if v == ABSTAIN else math.log(good[v] / bad[v])) for v in (BAD, GOOD, ABSTAIN)]), outcome + 1)
    bad_votes = sum(((c == BAD).cast("int") for c in named.values()), F.lit(0))
    judged = stats.withColumn("base_failed", base_failed()).withColumn("quality_posterior", 1 / (1 + F.exp(-odds))).withColumn("bad_votes", bad_votes)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality_posterior") >= threshold))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_posterior", "bad_votes"]
    return quality_rules(table(spark, sf_dir, "documents")).select(*kept)
