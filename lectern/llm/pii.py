r"""Personal data by weak supervision, in DataFrame functions only.

Base spans are the matches of four regular expressions that pass their checks. Looser candidates (numbers that fail a check, written-out
e-mail addresses, phone numbers without a country code, keys and tokens) are added by a model: a regex, a gazetteer and a context
labeler vote on every span, expectation-maximisation over the counts of vote patterns estimates how reliable each labeler
is, and the posteriors train a naive Bayes classifier over the span's surface, which decides. Strict and loose candidates of a
kind are estimated apart: that nearly all of what a strict pattern finds is personal says nothing of the loose ones.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.store import broadcast_if_small, table, written

KINDS = ("email", "ip", "card", "phone")
ADDED = ("secret",)  # found by the model only
# The patterns of the contract, with possessive quantifiers and with starts only where a run of their first characters starts
# (or the last match ended): the same matches, but no backtracking over long runs and no recursion.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[](?:at|AT)[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[](?:dot|DOT)[)\]])\x20?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+().-])\(?[0-9]{2,5}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])",
    "secret": r"(?<![A-Za-z0-9_+/=-])(?:[A-Za-z]{2,4}[-_])?+[A-Za-z0-9]{20,}+(?![A-Za-z0-9_+/=-])",
}
MAYBE = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"(?:[0-9][\x20-]?){12}[0-9]", "phone": r"\+[0-9]"}
LOOSE_MAYBE = {"email": r"[(\[](?:at|AT)[)\]]", "phone": r"[0-9][\x20.-][0-9]{3,4}(?![0-9])", "secret": "[A-Za-z0-9]{20}"}
# Generic top-level domains (any two letters are a country's), first digits of card numbers by issuer, and starts of keys.
DOMAINS = "aero app art asia biz blog cat cloud com coop dev edu email eu gov info int io jobs mil mobi museum name net news online org page post pro shop site store tech tel travel xyz"
ISSUERS = "2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|30[0-5]|34|35(?:2[89]|[3-8])|3[6-9]|4|5[0-8]|6011|62|6304|64[4-9]|65|67"
KEY_STARTS = "sk- pk- rk- sk_ pk_ ghp_ gho_ ghu_ ghs_ ghr_ xoxb- xoxp- xoxa- AKIA ASIA AIza"
# E.164 calling codes by zone; no code is the start of another.
CODES = "1|7|2(?:0|7|[1-689][0-9])|3(?:[0-469]|[578][0-9])|4(?:[013-9]|2[0-9])|5(?:[1-8]|[09][0-9])|6(?:[0-6]|[7-9][0-9])|8(?:[1246]|[05789][0-9])|9(?:[0-58]|[679][0-9])"
# Words that stand before such data.
CONTEXT = {
    "email": "mail email e-mail contact contacto kontakt courriel correo write",
    "ip": "ip host server address adresse serveur servidor",
    "card": "card visa mastercard karte carte tarjeta credit",
    "phone": "tel phone telefon telephone telefono call fax mobile handy",
    "secret": "token key apikey secret password passwd pwd bearer auth",
}
AGAINST = "version isbn token id no nr serial order page checksum commit sha md5 hash"
# How the regex labeler knows a loose candidate: usual spellings of addresses, of national numbers, and of keys.
USUAL = {
    "email": r"[)\]]\x20?[A-Za-z]{2,6}$|\.[A-Za-z]{2,6}$",
    "phone": r"^\([0-9]{3,5}\)[\x20.-]|^0[0-9]{1,4}[\x20.-]|^[0-9]{3}([\x20.-])[0-9]{3}\1[0-9]{4}$",
    "secret": r"^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})$|^(?:" + "|".join(KEY_STARTS.split()) + ")",
}


def located(text: Column, pattern: str, when: Column) -> Column:
    """array<struct<start, end, found>> of a pattern's matches, in code points; running sums go in blocks of 1000, so work stays near linear."""
    found = F.when(when, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    gaps = F.when(F.size(found) > 0, F.split(text, pattern, -1))
    parts = F.transform(found, lambda m, i: F.struct(m.alias("found"), F.length(F.get(gaps, i)).alias("gap"), F.length(m).alias("size")))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, p: s + p.gap + p.size)
    none = F.array().cast("array<struct<start:int,end:int,found:string>>")

    def block(p: Column, first: Column, offset: Column) -> Column:
        step = lambda acc, x: F.struct(
            (acc.at + x.gap + x.size).alias("at"),
            F.concat(acc.out, F.array(F.struct((acc.at + x.gap).alias("start"), (acc.at + x.gap + x.size).alias("end"), x.found.alias("found")))).alias("out"),
        )
        return F.aggregate(F.slice(p, first, F.lit(1000)), F.struct(offset.alias("at"), none.alias("out")), step, lambda acc: acc.out)

    firsts = F.sequence(F.lit(1), F.size(parts), F.lit(1000))
    blocks = F.transform(firsts, lambda f: block(parts, f, total(F.slice(parts, F.lit(1), f - 1))))
    return F.when(F.size(parts) > 0, F.flatten(blocks)).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def add(s: Column, i: Column) -> Column:
        d = F.expr("0") + F.try_to_number(F.substring(digits, i, F.lit(1)), F.lit("9")).cast("int")
        twice = F.when((F.length(digits) - i) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        return s + twice

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(m, r"\."), small)
    n = F.length(_digits(m))
    if kind == "card":
        return F.when(n.between(13, 19), luhn(_digits(m))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _in(words: str, c: Column) -> Column:
    return c.isin(*words.split())


def _gazetteer(kind: str, m: Column) -> Column:
    """1, 0 or null (abstains)."""
    if kind == "email":
        last = F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)$", 1))
        return F.when(_in(DOMAINS, last) | last.rlike("^[a-z]{2}$"), 1)
    if kind == "ip":
        return F.when(F.regexp_extract(m, r"^([0-9]+)\.", 1).isin("0", "255"), 0)
    if kind == "card":
        return F.when(_digits(m).rlike(f"^(?:{ISSUERS})"), 1).otherwise(0)
    if kind == "secret":
        return F.when(m.rlike(f"^(?:{'|'.join(KEY_STARTS.split())})"), 1).when(~m.rlike("[0-9]") | ~m.rlike("[A-Za-z]"), 0)
    return F.when(m.rlike(rf"^\+(?:{CODES})[^0-9]"), 1).when(F.length(_digits(m)) < 9, 0)


def _candidates(text: Column, kind: str, base: Column, loose: Column) -> Column:
    """Every span of the kind with its votes and its surface: array<struct>."""

    def described(s: Column, strict: Column, regex: Column, group: str) -> Column:
        before = F.lower(F.regexp_extract(F.substring(text, F.greatest(s.start - 23, F.lit(1)), F.least(s.start, F.lit(24))), r"([\p{L}-]+)[^\p{L}]*$", 1))
        context = F.when(_in(CONTEXT[kind], before), 1).when(_in(AGAINST, before), 0)
        shape = F.concat_ws("|", F.least(F.length(_digits(s.found)), F.lit(20)), F.least(F.floor(F.length(s.found) / 4), F.lit(10)), F.regexp_replace(F.regexp_replace(s.found, r"[A-Za-z0-9]+", ""), r"(.)\1+", "$1").substr(1, 4))
        return F.struct(F.lit(kind).alias("kind"), F.lit(group).alias("group"), s.start.alias("start"), s.end.alias("end"), strict.alias("base"), regex.cast("int").alias("regex"), _gazetteer(kind, s.found).cast("int").alias("gazetteer"), context.cast("int").alias("context"), shape.alias("shape"))

    found = F.array()
    if kind in KINDS:
        found = F.transform(base, lambda s: described(s, passes(kind, s.found), F.when(passes(kind, s.found), 1).otherwise(0), kind))
    if kind == "card":
        found = F.filter(found, lambda s: s.base | (F.split(s["shape"], r"\|")[0].try_cast("int") >= 13))
    if kind not in LOOSE:
        return found
    more = F.transform(loose, lambda s: described(s, F.lit(False), F.when(s.found.rlike(USUAL[kind]), 1), f"loose {kind}"))
    return F.concat(found, more) if kind in KINDS else more


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and spans: array<struct<kind, group, start, end, base, regex, gazetteer, context, shape>> of each row."""
    text = F.col("__text")
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    for kind in KINDS:
        maybe = F.instr(text, MAYBE[kind]) > 0 if kind == "email" else text.rlike(MAYBE[kind])
        rows = rows.withColumn(f"__{kind}", located(text, BASE[kind], maybe))
    for kind, maybe in LOOSE_MAYBE.items():
        rows = rows.withColumn(f"__loose_{kind}", located(text, LOOSE[kind], text.rlike(maybe)))
    found = [_candidates(text, k, F.col(f"__{k}") if k in KINDS else F.array(), F.col(f"__loose_{k}") if k in LOOSE else F.array()) for k in (*KINDS, *ADDED)]
    rows = rows.withColumn("__all", F.concat(*found))
    base = F.filter("__all", lambda s: s.base)
    clear = F.filter("__all", lambda s: s.base | ~F.exists(base, lambda b: (b.start < s.end) & (s.start < b.end)))
    return rows.select(id_col, F.when(F.size("__all") > 0, clear).otherwise(F.col("__all")).alias("spans"))


def reliabilities(patterns: list[tuple[tuple[int | None, ...], int]], rounds: int = 100, prior: float = 0.5, most: float = 0.99) -> tuple[float, list[tuple[float, float]]]:
    """(P(personal), [(P(vote 1 | personal), P(vote 0 | not))]) by EM from counts of vote patterns; labelers start at, and are drawn to, 0.8; the first is most at most."""
    size = len(patterns[0][0]) if patterns else 0
    coins = [(0.8, 0.8)] * size
    for _ in range(rounds):
        mass, total, seen = 1.0, 2.0, [[8.0, 10.0, 8.0, 10.0] for _ in range(size)]
        for votes, n in patterns:
            p = belief(votes, prior, coins)
            mass, total = mass + p * n, total + n
            for k, v in enumerate(votes):
                if v is not None:
                    for at, x in enumerate((p * v, p, (1 - p) * (1 - v), 1 - p)):
                        seen[k][at] += x * n
        prior = min(most, max(0.01, mass / total))
        coins = [(max(0.5, a / b), max(0.5, c / d)) for a, b, c, d in seen]
    return prior, coins


def belief(votes: tuple[int | None, ...], prior: float, coins: list[tuple[float, float]]) -> float:
    odds = math.log(prior / (1 - prior))
    for v, (yes, no) in zip(votes, coins, strict=True):
        yes, no = min(yes, 0.99), min(no, 0.99)
        odds += 0.0 if v is None else math.log(yes / (1 - no)) if v else math.log((1 - yes) / no)
    return 1 / (1 + math.exp(-odds))


#: The largest share of personal data that is believed among loose candidates, so that votes decide even where nearly all are personal.
MOST_LOOSE = 0.7
#: Spans of unknown surface or votes that every feature value is worth beside those counted, split by class as all spans are.
SMOOTHING = 1.0


def log_ratio(seen: tuple[float, float], whole: tuple[float, float]) -> float:
    """log P(value | personal) / P(value | not) from the masses of a value and of all; 0 for a value never seen."""
    total = sum(whole)
    return math.log((seen[0] + SMOOTHING * whole[0] / total) / whole[0]) - math.log((seen[1] + SMOOTHING * whole[1] / total) / whole[1])


def vote_weights(counts: list) -> tuple[dict[str, float], dict[str, float], dict[str, tuple[float, float]]]:
    """By "group|regex|gazetteer|context" the belief and the log odds without the shape, by group both classes' mass: from counts of votes."""
    beliefs, odds, masses = {}, {}, {}
    for group in sorted({r["group"] for r in counts}):
        own = [((r["regex"], r["gazetteer"], r["context"]), r["count"]) for r in counts if r["group"] == group]
        own.sort(key=str)
        prior, coins = reliabilities(own, most=MOST_LOOSE if group.startswith("loose") else 0.99)
        seen: dict = defaultdict(lambda: [0.0, 0.0])
        whole = [1.0, 1.0]
        for votes, n in own:
            p = belief(votes, prior, coins)
            for side, x in enumerate((p * n, (1 - p) * n)):
                whole[side] += x
                for k, v in enumerate(votes):
                    seen[k, v][side] += x
            beliefs["|".join(map(str, (group, *votes)))] = p
        masses[group] = (whole[0], whole[1])
        for votes, _ in own:
            odds["|".join(map(str, (group, *votes)))] = math.log(whole[0] / whole[1]) + sum(log_ratio(seen[k, v], whole) for k, v in enumerate(votes))
    return beliefs, odds, masses


def chosen(counts: DataFrame, threshold: float) -> DataFrame:
    """(group, votes, shape) of the patterns, other than base spans', whose probability is threshold or more.

    Naive Bayes trained on the beliefs of the labelers. counts: group, base, regex, gazetteer, context, shape and count, of which only
    the sums without shapes, a few dozen, come to the driver; each shape's mass is a sum over its votes.
    """
    sums = counts.groupBy("group", "regex", "gazetteer", "context").agg(F.sum("count").alias("count")).collect()
    beliefs, odds, masses = vote_weights(sums)
    of = lambda known, key: F.create_map(*[F.lit(x) for k, v in sorted(known.items() or {"": 0.0}.items()) for x in (k, v)])[key]
    votes = votes_of(F.col("group"), F.col("regex"), F.col("gazetteer"), F.col("context"))
    shapes = counts.select("group", "shape", F.struct(votes.alias("votes"), "base", "count", of(beliefs, votes).alias("belief")).alias("v")).groupBy("group", "shape").agg(F.array_sort(F.collect_list("v")).alias("all"))
    yes, no = (of({k: m[side] for k, m in masses.items()}, F.col("group")) for side in (0, 1))
    mass = lambda part: F.aggregate("all", F.lit(0.0), lambda s, v: s + part(v.belief) * v["count"])  # noqa: E731  in order, so the same in each run
    weight = F.log((mass(lambda p: p) + SMOOTHING * yes / (yes + no)) / yes) - F.log((mass(lambda p: 1 - p) + SMOOTHING * no / (yes + no)) / no)
    found = shapes.withColumn("weight", weight).select("group", "shape", "weight", F.explode("all").alias("v")).where(~F.col("v.base"))
    return found.where(of(odds, F.col("v.votes")) + F.col("weight") >= math.log(threshold / (1 - threshold))).select("group", F.col("v.votes").alias("votes"), "shape")


def votes_of(group: Column, *votes: Column) -> Column:
    return F.concat_ws("|", group, *[F.coalesce(v.cast("string"), F.lit("None")) for v in votes])


def personal_data(docs: DataFrame, threshold: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and found: array<struct<kind, start, end, base>> of each row, in order of kind and start (code points, end exclusive).

    All base spans are in it, and other candidates that don't overlap one where the classifier's probability is threshold or
    more; their kinds are the four and, last, secret. Null and empty texts have none; repeated rows are answered each; an empty table trains nothing and gives no
    rows. Texts are read once and never shuffled; spans and counts of their patterns are written to the shared folder. Only counts of
    votes come to the driver; the patterns of votes and shape that are chosen are joined to the other candidates.
    """
    rows = written(spans(docs, id_col, text_col).withColumn("__row", F.monotonically_increasing_id()), "spans")
    by = ["group", "base", "regex", "gazetteer", "context", "shape"]
    counts = written(rows.select(F.explode("spans").alias("s")).select("s.*").groupBy(*by).count(), "patterns")
    patterns = broadcast_if_small(written(chosen(counts, threshold), "chosen"), 200_000)
    others = rows.select("__row", F.explode(F.filter("spans", lambda s: ~s.base)).alias("s"))
    others = others.select("__row", "s.*").withColumn("votes", votes_of(F.col("group"), *[F.col(c) for c in by[2:5]]))
    added = others.join(patterns, ["group", "votes", "shape"], "left_semi").groupBy("__row").agg(F.collect_list(F.struct("kind", "start", "end", "base")).alias("added"))
    base = F.transform(F.filter("spans", lambda s: s.base), lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"), s.base.alias("base")))
    kept = F.when(F.col("added").isNull(), base).otherwise(F.concat(base, "added"))
    rank = F.create_map(*[F.lit(x) for i, k in enumerate((*KINDS, *ADDED)) for x in (k, i)])
    ordered = F.array_sort(F.transform(kept, lambda s: F.struct(rank[s.kind].alias("rank"), s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"), s.base.alias("base"))))
    return rows.join(added, "__row", "left").select(id_col, F.transform(ordered, lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"), s.base.alias("base"))).alias("found"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s.base)
    said = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s.base & (s.kind == kind))).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("found")).alias("spans"))
