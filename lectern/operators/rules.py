"""Row-wise decisions: rewrite gates, cost gates, language and voice lookups, signals."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import dictionaries as D
from lectern.functions.notation import let, sanitize, strip
from lectern.llm.store import broadcast_if_small, written
from lectern.operators import order as order_by
from lectern.operators import text as T


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for k, v in d.items() for x in (k, v)])


def size_verdict(original: Column, candidate: Column, shrink: float = 0.85, growth: float = 2.0) -> Column:
    """Why a rewrite is refused, or "accepted"; "original" where there is nothing to rewrite."""
    ratio = F.length(strip(candidate)) / F.nullif(F.length(original), F.lit(0))
    return F.when(strip(F.coalesce(original, F.lit(""))) == "", "original").when(strip(F.coalesce(candidate, F.lit(""))) == "", "blank").when(candidate.rlike(D.PREAMBLE), "preamble").when((ratio < shrink) | (ratio > growth), "size").otherwise("accepted")


def word_verdict(original: Column, candidate: Column) -> Column:
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), F.lit(0))
    return F.when(strip(F.coalesce(original, F.lit(""))) == "", "original").when(strip(F.coalesce(candidate, F.lit(""))) == "", "blank").when(candidate.rlike(D.PREAMBLE), "preamble").when(words(original) != words(candidate), "words").otherwise("accepted")


def rewritten(original: Column, candidate: Column, verdict: Column) -> Column:
    return F.when(verdict == "accepted", strip(candidate)).otherwise(original)


def enrich_once(rows: DataFrame, key: str, enrich) -> DataFrame:
    """rows with enriched: each distinct text is processed once and joined back; blank text is its own answer."""
    distinct = rows.select(F.col(key).alias("__text")).where(strip(F.col(key)) != "").distinct()
    done = distinct.withColumn("enriched", enrich(F.col("__text")))
    return rows.join(done, F.col(key) == F.col("__text"), "left").drop("__text").withColumn("enriched", F.coalesce("enriched", key))


def chain_rate(*rates: Column) -> Column:
    """The rate of a chain of steps: the sum of its links' rates, a null link costing nothing."""
    return sum((F.coalesce(r, F.lit(0.0)) for r in rates), F.lit(0.0))


def cost_estimate(text: Column, rate: Column, rewriting: Column | None = None, opt_in: Column | None = None) -> Column:
    """Characters of the sanitised text times the speech rate, and the rewriting chain's rate where opted in; a null text costs nothing."""
    more = F.lit(0.0) if rewriting is None else F.when(opt_in, rewriting).otherwise(F.lit(0.0))
    return F.coalesce(F.length(sanitize(text)), F.lit(0)) * chain_rate(rate, more)


def timing_summary(runs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, repetitions and the means over repetitions of total, sec_per_item and audio_ratio; runs: keys, repetition, seconds, audio_seconds by item."""
    each = runs.groupBy(*keys, "repetition").agg(F.sum("seconds").alias("total"), F.avg("seconds").alias("per_item"), (F.sum("audio_seconds") / F.nullif(F.sum("seconds"), F.lit(0))).alias("ratio"))
    return each.groupBy(*keys).agg(F.count("*").alias("repetitions"), F.avg("total").alias("total"), F.avg("per_item").alias("sec_per_item"), F.avg("ratio").alias("audio_ratio"))


def routing_cost(text: Column, limit: int = 1000) -> Column:
    """struct<n_chars, by_chunk, by_sentence>: characters that go to the paid tier if a chunk with an expressive sentence goes whole, or such sentences alone."""
    size = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, t: s + F.length(t))
    expressive = lambda pattern, t: size(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))
    marks = T.SENTENCE + T.PARAGRAPH
    n_chars = lambda m: F.length(F.replace(F.replace(m, F.lit(T.SENTENCE), F.lit("")), F.lit(T.PARAGRAPH), F.lit("")))
    whole = lambda m: size(F.filter(T.packed_sentences(m, limit), lambda t: t.rlike("[?!]")))
    alone = lambda m: expressive(f"(?<![^{marks}])[^{marks}?!]*+[?!][^{marks}]*+", m)
    return let(T.sentence_marks(text), lambda m: F.struct(n_chars(m).cast("long").alias("n_chars"), whole(m).alias("by_chunk"), alone(m).alias("by_sentence")))


def cost_gate(estimate: Column, cap: Column, confirmed: Column) -> Column:
    """degrade comes before pending_confirmation."""
    return F.when((estimate > 0) & cap.isNotNull() & (estimate > cap), "degrade").when((estimate > 0) & ~confirmed, "pending_confirmation").otherwise("proceed")


def language_code(language: Column) -> Column:
    return _map(D.LANGUAGE_CODES)[language]


def valid_voice(code: Column, voice: Column) -> Column:
    """The voice if the code has it, else null."""
    return F.when(F.array_contains(_map_of_lists(D.VOICES)[code], voice), voice)


def voice_or_default(code: Column, voice: Column) -> Column:
    return F.coalesce(valid_voice(code, voice), F.get(_map_of_lists(D.VOICES)[code], F.lit(0)))


def _map_of_lists(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))])


def carried_forward(rows: DataFrame, unit: str, order: str, code: str, start: str = "a") -> DataFrame:
    """Undecided rows take the last decided code of their unit, start where there is none. A unit of any number of rows is carried through in ranges."""
    return order_by.carried(rows, unit, order, F.col(code), "carried").withColumn("carried", F.coalesce("carried", F.lit(start)))


def trim_edges(signal: Column, rate: int = 24000, share: float = 0.02, guard_ms: float = 15) -> Column:
    """From the first to the last sample louder than share of the peak, widened by the guard; silence is unchanged."""
    guard = int(guard_ms / 1000 * rate)
    loud = F.transform(signal, lambda x: F.abs(x) > share * F.array_max(F.transform(signal, F.abs)))
    first = F.array_position(loud, F.lit(True)).cast("int")
    last = F.size(signal) + 1 - F.array_position(F.reverse(loud), F.lit(True)).cast("int")
    begin = F.greatest(first - guard, F.lit(1))
    return F.when(first > 0, F.slice(signal, begin, F.least(last + guard, F.size(signal)) - begin + 1)).otherwise(signal)


def silence(ms: Column, rate: int = 24000) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), F.floor(ms / 1000 * rate).cast("int"))


def joined_signal(parts: DataFrame, key: str, order: str, signal: str, rate: int = 24000) -> DataFrame:
    """(key, order, signal, start): the parts of a key with the sample at which each starts when they follow one another.

    Only lengths are summed over a key, so a signal of any length stays a table of parts; write it in order of start.
    """
    sizes = parts.select(key, order, F.size(signal).cast("long").alias("__n"))
    starts = order_by.with_sum_before(sizes, key, order, F.col("__n"), "start").drop("__n")
    return parts.join(starts, [key, order]).select(key, order, signal, "start", (F.col("start") / rate).alias("seconds"))


def registered(uploads: DataFrame) -> DataFrame:
    """Uploads (id, filename, language, voice) as books: title from the file name or the id, unknown language or voice to null."""
    code = language_code(F.col("language"))
    return uploads.select(
        "id", F.coalesce(F.nullif(F.col("filename"), F.lit("")), F.col("id").cast("string")).alias("title"), F.lit("uploaded").alias("status"),
        F.when(code.isNotNull(), F.col("language")).alias("language"), F.when(code.isNotNull(), valid_voice(code, F.col("voice"))).alias("voice"),
    )


def money(usd: Column) -> Column:
    """US$ 1.234,56, or nothing for null."""
    return F.coalesce(F.concat(F.lit("US$ "), F.translate(F.format_number(usd, 2), ",.", ".,")), F.lit(""))


def status_message(status: Column, done: Column, total: Column, estimate: Column, degraded: Column) -> Column:
    some, m = done > 0, D.STATUS_MESSAGES

    def said(name: str, *values: Column) -> Column:
        parts = m[name].split("{}")
        return F.concat(F.lit(parts[0]), *[x for v, p in zip(values, parts[1:], strict=True) for x in (v, F.lit(p))])

    progress = F.when(total.isNull(), F.concat(F.lit(m["other"]), F.coalesce(_map(D.STATUS_LABELS)[status], status))).otherwise(said("progress", done, total))
    return (
        F.when(status == "pending_confirmation", said("confirm", F.when(estimate > 0, money(estimate)).otherwise(m["unknown"])))
        .when(status == "paused", F.when(some, m["paused some"]).otherwise(m["paused"]))
        .when(status == "error", F.when(some, said("error some", done)).otherwise(m["error"]))
        .when(status == "ready", F.when(~some, m["nothing"]).when(degraded, m["degraded"]).otherwise(m["ready"]))
        .otherwise(F.when(some, F.concat(progress, F.lit(m["playing"]))).otherwise(progress))
    )


def guarded(transform: Callable, batch: bool = False) -> Callable[[Column], Column]:
    """A transform for normalized() that never raises: struct<text, error>, an exception being the error of its row alone.

    transform makes a str of a str, or, with batch, a pandas Series of a Series; if that raises, its rows are tried one by one, so that
    only those that fail are left as they are. What isn't a text is an error too; a null text isn't passed to it.
    """

    def one(t: str | None, call: Callable) -> tuple[str | None, str | None]:
        if t is None:
            return None, None
        try:
            out = call(t)
            if out is not None and not isinstance(out, str):
                raise TypeError(f"{type(out).__name__} instead of str")
            return out, None
        except Exception as e:  # whatever a transform raises is its row's answer
            return None, f"{type(e).__name__}: {e}"[:500]

    def rows(part: pd.Series) -> list[tuple[str | None, str | None]]:
        if not batch:
            return [one(t, transform) for t in part]
        full = part[part.notna()]
        try:
            got = iter([one(t, lambda x: x) for t in transform(full)] if len(full) else [])
            return [(None, None) if t is None else next(got) for t in part]
        except Exception:
            return [one(t, lambda x: transform(pd.Series([x])).iloc[0]) for t in part]

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame(rows(part), columns=["text", "error"], dtype=object)

    udf = F.pandas_udf(run, "text string, error string").asNondeterministic()  # a failure may pass, so calls aren't merged or repeated
    call = lambda c: udf(c)
    call.guarded = True
    return call


def _chained(rows: DataFrame, transforms: list, verdict) -> DataFrame:
    """rows (__text) with normalized and normalize_error, the first failure of a transform; a failure leaves the text as it was."""
    out = rows.withColumn("normalized", F.col("__text")).withColumn("normalize_error", F.lit(None).cast("string"))
    for transform in transforms:
        out = out.withColumn("__new", transform(F.col("normalized")))
        if getattr(transform, "guarded", False):
            out = out.withColumn("normalize_error", F.coalesce("normalize_error", "__new.error")).withColumn("__new", F.col("__new.text"))
        out = out.withColumn("normalized", rewritten(F.col("normalized"), F.col("__new"), verdict(F.col("normalized"), F.col("__new")))).drop("__new")
    return out


def normalized(rows: DataFrame, text_col: str, transforms: list, opt_in: Column, verdict=word_verdict) -> DataFrame:
    """rows with normalized and normalize_error: the transforms in order, each accepted or undone by the verdict, where the row opts in.

    Each distinct text is transformed once. A transform is a Column function, or a Python function made safe by guarded(): a text on which
    it raises stays as it was, with the failure in normalize_error, and the later transforms go on from there. Failures aren't shared: rows
    of a text that failed are tried once more, each by itself. A null result is a refusal; null and repeated texts are no failure.

    Hashes tell which texts may stand in several rows; only these are shuffled and joined. All others, and what is tried again, are done
    within their row.
    """
    chosen, text, own = rows.where(opt_in), F.col(text_col), F.xxhash64(text_col)
    again = chosen.where(text.isNotNull()).groupBy(own.alias("__again")).count().where("count > 1").select("__again")
    again = broadcast_if_small(written(again, "repeated-texts"))
    alone = _chained(chosen.join(again, own == F.col("__again"), "left_anti").withColumn("__text", text), transforms, verdict).drop("__text")
    shared = chosen.join(again, own == F.col("__again"), "left_semi")
    distinct = _chained(shared.select(text.alias("__text")).distinct(), transforms, verdict)
    done = alone.unionByName(shared.join(distinct, text == F.col("__text"), "left").drop("__text"))
    if any(getattr(t, "guarded", False) for t in transforms):
        first = done.withColumnsRenamed({"normalized": "__first", "normalize_error": "__failed"})
        second = _chained(first.withColumn("__text", F.when(F.col("__failed").isNotNull(), text)), transforms, verdict)
        done = second.withColumn("normalized", F.when(F.col("__failed").isNull(), F.col("__first")).otherwise(F.col("normalized"))).drop("__text", "__first", "__failed")
    others = rows.where(~F.coalesce(opt_in, F.lit(False))).withColumn("normalized", F.col(text_col)).withColumn("normalize_error", F.lit(None).cast("string"))
    return done.unionByName(others)
