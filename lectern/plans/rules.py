"""Queries over gates, costs, languages, signals and measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import dictionaries as D
from lectern.functions import notation as N
from lectern.operators import language as V
from lectern.operators import rules as R
from lectern.operators import text as T
from lectern.plans.text import CHUNKS_SQL, DOCS, _docs, sanitize_sql, table


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with a rewrite: the same, repunctuated, cut, doubled, or with a talkative opening."""
    t, k = F.col("text"), F.col("doc_id") % 6
    candidate = F.when(k == 0, t).when(k == 1, F.translate(t, ".,", "!;")).when(k == 2, F.substring(t, 1, 40)).when(k == 3, F.concat(t, F.lit(" "), t, F.lit(" "), t)).when(k == 4, F.concat(F.lit("Here is "), t)).otherwise(" ")
    original = F.when(F.col("doc_id") % 13 == 0, "").when(F.col("doc_id") % 13 == 1, F.lit(None)).otherwise(t)
    return table(spark, sf_dir, "documents").select("doc_id", original.alias("original"), candidate.alias("candidate"))


PAIRS = "pairs AS (SELECT doc_id, CASE doc_id % 13 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE text END AS original, CASE doc_id % 6 WHEN 0 THEN text WHEN 1 THEN translate(text, '.,', '!;') WHEN 2 THEN substr(text, 1, 40) WHEN 3 THEN text || ' ' || text || ' ' || text WHEN 4 THEN 'Here is ' || text ELSE ' ' END AS candidate FROM documents)\n"
VERDICT = "CASE WHEN coalesce(trim(original), '') = '' THEN 'original' WHEN trim(candidate) = '' THEN 'blank' WHEN candidate LIKE 'Here is%' THEN 'preamble' WHEN {} ELSE 'accepted' END"
SIZE = VERDICT.format("length(trim(candidate, chr(32)||chr(9)||chr(10)||chr(13))) / nullif(length(original), 0) NOT BETWEEN 0.85 AND 2.0 THEN 'size'")
WORD = VERDICT.format(r"regexp_extract_all(lower(original), '[\p{L}\p{M}\p{N}_]+') <> regexp_extract_all(lower(candidate), '[\p{L}\p{M}\p{N}_]+') THEN 'words'")


def rewrite_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = R.size_verdict(F.col("original"), F.col("candidate"))
    return _pairs(spark, sf_dir).select("doc_id", verdict.alias("verdict"), F.sha2(R.rewritten(F.col("original"), F.col("candidate"), verdict), 256).alias("sha"))


def word_identity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("doc_id", R.word_verdict(F.col("original"), F.col("candidate")).alias("verdict"))


def rewrite_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).withColumn("verdict", R.size_verdict(F.col("original"), F.col("candidate")))
    return rows.groupBy("verdict").agg(F.count("*").alias("n"), F.round(F.avg(F.length("candidate") / F.nullif(F.length("original"), F.lit(0))), 4).alias("mean_ratio"))


def enrich_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.enrich_once(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", lambda t: F.concat(F.lit("["), F.sha2(t, 256), F.lit("]")))
    return rows.select("doc_id", "enriched")


def cost_by_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = spark.createDataFrame(list(D.PRICES.items()), "provider string, usd double").where("usd IS NOT NULL")
    docs = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.length(N.sanitize(F.col("text")))).alias("n_chars"))
    return docs.crossJoin(F.broadcast(prices)).select("source", "provider", F.round(F.col("n_chars") * F.col("usd") / 1e6, 4).alias("usd"))


_VALUES = ", ".join(f"('{k}', {v})" for k, v in D.PRICES.items() if v)


def cost_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates are characters of the sanitised text times the rate: speech, and a chain of two rewriting steps where opted in."""
    speech = F.when(F.col("doc_id") % 7 == 0, F.lit(0.0)).otherwise(F.lit(0.000016))
    rewriting = R.chain_rate(F.lit(0.000006), F.when(F.col("doc_id") % 7 != 0, F.lit(0.000004)), F.when(F.col("doc_id") % 7 == 0, F.lit(-0.000006)))
    rows = table(spark, sf_dir, "documents").withColumn("estimate", R.cost_estimate(F.col("text"), speech, rewriting, F.col("doc_id") % 3 == 0))
    cap = F.when(F.col("doc_id") % 2 == 0, F.lit(0.03))
    return rows.select("doc_id", F.round("estimate", 6).alias("estimate"), R.cost_gate(F.col("estimate"), cap, F.col("doc_id") % 5 == 0).alias("decision"))


def markup_surcharge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.sentences(_docs(spark, sf_dir)).groupBy("doc").agg(F.sum(F.length("text")).alias("n_chars"), F.count("*").alias("n"))
    cost = lambda extra: F.round((F.col("n_chars") + F.col("n") * extra) * 16 / 1e6, 6)
    return rows.select("doc", cost(0).alias("plain"), cost(21).alias("pause_each"), cost(54).alias("style_each"), cost(75).alias("both_each"))


def language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    voice = F.element_at(F.array(*[F.lit(v) for v in ("af_sky", "ef_dora", "ff_siwis", "none")]), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").withColumn("code", R.language_code(F.col("lang"))).withColumn("voice", voice)
    return rows.select("doc_id", "code", R.valid_voice(F.col("code"), F.col("voice")).alias("valid"), R.voice_or_default(F.col("code"), F.col("voice")).alias("voice"))


_codes = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in D.LANGUAGE_CODES.items()) + " END"
_default = "CASE code " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in D.VOICES.items()) + " END"
CODES_SQL = f"WITH d AS (SELECT doc_id, {_codes} AS code, ['af_sky', 'ef_dora', 'ff_siwis', 'none'][doc_id % 4 + 1] AS v FROM documents), w AS (SELECT doc_id, code, CASE WHEN (code, v) IN (('a', 'af_sky'), ('e', 'ef_dora'), ('f', 'ff_siwis')) THEN v END AS valid FROM d) SELECT doc_id, code, valid, coalesce(valid, {_default}) AS voice FROM w"


def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("code", F.when(F.length("text") >= 60, F.element_at(F.array(*[F.lit(c) for c in "efp"]), (F.length("text") % 3 + 1).cast("int"))))
    return R.carried_forward(rows, "conv_id", "turn", "code").select("conv_id", "turn", "carried")


def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of each document have each language code: trigram profiles of labelled text, and the language of most summed weight.

    A language without a code counts as a; lines under 40 characters, and lines that share nothing with a profile, have a null code.
    Profiles (trigram, language, weight) hold the trigrams that make up a thousandth of a language's text, so a thousand each at most.
    """
    d = table(spark, sf_dir, "documents")
    found = V.line_languages(d, V.profiles(d))
    code = F.when(F.col("lang").isNotNull(), F.coalesce(R.language_code(F.col("lang")), F.lit("a")))
    return found.groupBy("doc_id", code.alias("code")).agg(F.count("*").alias("n_lines"))


DETECT_SQL = """
WITH g AS (SELECT lang, substr(t, i, 3) AS g FROM (SELECT lang, lower(text) AS t, unnest(range(1, greatest(length(text) - 1, 1))) AS i FROM documents)),
c AS (SELECT lang, g, count(*) AS n FROM g GROUP BY 1, 2), p AS (SELECT lang, g, n * 100000 // total AS w FROM c JOIN (SELECT lang, sum(n)::BIGINT AS total FROM c GROUP BY 1) USING (lang) WHERE n * 1000 >= total),
a AS (SELECT doc_id, i AS line, lower(l[i]) AS t FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
m AS (SELECT doc_id, line, substr(t, i, 3) AS g FROM (SELECT doc_id, line, t, unnest(range(1, greatest(length(t) - 1, 1))) AS i FROM a WHERE length(trim(t)) >= 40)),
s AS (SELECT doc_id, line, lang, sum(w) AS score FROM m JOIN p USING (g) GROUP BY 1, 2, 3),
b AS (SELECT doc_id, line, lang FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY score DESC, lang DESC) = 1)
SELECT doc_id, CASE lang WHEN 'en' THEN 'a' WHEN 'es' THEN 'e' WHEN 'fr' THEN 'f' WHEN 'hi' THEN 'h' WHEN 'it' THEN 'i' WHEN 'pt' THEN 'p' WHEN 'ja' THEN 'j' WHEN 'zh-cn' THEN 'z' WHEN 'zh-tw' THEN 'z' ELSE CASE WHEN lang IS NOT NULL THEN 'a' END END AS code, count(*) AS n_lines
FROM a LEFT JOIN b USING (doc_id, line) GROUP BY 1, 2
"""


def trim_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    quiet = F.transform("embedding", lambda x, i: F.when((i < F.col("vec_id") % 9) | (i > 60), F.lit(0.0).cast("float")).otherwise(x))
    cut = R.trim_edges(quiet, rate=200)
    return e.select("vec_id", F.size(cut).cast("long").alias("n"), F.round(F.aggregate(cut, F.lit(0.0), lambda s, x: s + F.abs(x)), 3).alias("sound"))


TRIM_SQL = """
WITH q AS (SELECT vec_id, list_transform(embedding, lambda x, i: CASE WHEN i - 1 < vec_id % 9 OR i - 1 > 60 THEN 0::FLOAT ELSE x END) AS v FROM embeddings),
f AS (SELECT vec_id, v, list_transform(v, lambda x: abs(x)::DOUBLE > 0.02::DOUBLE * list_max(list_transform(v, lambda y: abs(y)))::DOUBLE) AS loud FROM q),
c AS (SELECT vec_id, CASE WHEN list_contains(loud, true) THEN list_slice(v, greatest(list_position(loud, true) - 3, 1), least(len(v) + 1 - list_position(list_reverse(loud), true) + 3, len(v))) ELSE v END AS cut FROM f)
SELECT vec_id, len(cut) AS n, round(list_sum(list_transform(cut, lambda x: abs(x)::DOUBLE)), 3) AS sound FROM c
"""


def concat_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.concat("embedding", R.silence(F.lit(5), 2000)).alias("part"))
    rows = R.joined_signal(parts, "label", "vec_id", "part", 2000)
    end, first = F.max(F.col("start") + F.size("part")), F.min_by(F.get("part", F.lit(0)), "start")
    return rows.groupBy("label").agg(end.alias("n"), F.round(end / 2000, 4).alias("seconds"), F.round(first.cast("double"), 4).alias("first"), F.sum("start").alias("starts"))


def expressive_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.sentences(_docs(spark, sf_dir, F.col("lang")))
    asks, calls = F.contains("text", F.lit("?")), F.contains("text", F.lit("!"))
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count(F.when(asks & ~calls, 1)).alias("asking"), F.count(F.when(calls & ~asks, 1)).alias("calling"))


def breath_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = F.array_max(F.transform(F.split("text", "[,;:]", -1), F.length))
    bin_ = F.when(run <= 120, "<=120").when(run <= 200, "120-200").when(run <= 300, "200-300").otherwise(">300")
    return T.sentences(_docs(spark, sf_dir)).groupBy(bin_.alias("run")).agg(F.count("*").alias("n"))


def routing_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters to the paid tier: whole chunks with an expressive sentence, or those sentences alone."""
    rows = _docs(spark, sf_dir).select("doc", F.inline(F.array(R.routing_cost(F.col("text")))))  # a generator: the costs of a row are worked out once
    return rows.where("n_chars > 0")


def timing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_linenumber").alias("repetition"), F.col("l_quantity").alias("seconds"), F.col("l_extendedprice").alias("audio_seconds"))
    rows = R.timing_summary(runs, ["l_suppkey"])
    return rows.select("l_suppkey", "repetitions", F.round("total", 4).alias("mean_total"), F.round("sec_per_item", 4).alias("mean_each"), F.round("audio_ratio", 4).alias("mean_ratio"))


def clause_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.sentences(_docs(spark, sf_dir)).select("doc", "paragraph", "sentence", F.explode(T.split_clauses(F.col("text"), 120)).alias("piece"))
    return rows.groupBy("doc").agg(F.count("*").alias("n_pieces"), F.sum(F.length("piece")).alias("n_chars"))


CLAUSE_SQL = "WITH RECURSIVE " + DOCS + r""",
c AS (SELECT doc, paragraph, sentence, text, string_split(regexp_replace(text, '([,;:])\s+', '\1' || chr(30), 'g'), chr(30)) AS l FROM sents),
fold AS (SELECT doc, paragraph, sentence, l, 1 AS i, 0 AS piece, length(l[1]) AS size FROM c WHERE length(text) > 120
  UNION ALL SELECT doc, paragraph, sentence, l, i + 1, CASE WHEN size + 1 + length(l[i + 1]) <= 120 THEN piece ELSE piece + 1 END, CASE WHEN size + 1 + length(l[i + 1]) <= 120 THEN size + 1 + length(l[i + 1]) ELSE length(l[i + 1]) END FROM fold WHERE i < len(l)),
p AS (SELECT doc, max(size) AS n FROM fold GROUP BY doc, paragraph, sentence, piece UNION ALL SELECT doc, length(text) FROM c WHERE length(text) <= 120)
SELECT doc, count(*) AS n_pieces, sum(n)::BIGINT AS n_chars FROM p GROUP BY doc
"""

_S = "WITH " + DOCS
QUERIES = {
    "rewrite_gate": (rewrite_gate, f"WITH {PAIRS}, v AS (SELECT *, {SIZE} AS verdict FROM pairs) SELECT doc_id, verdict, sha256(CASE WHEN verdict = 'accepted' THEN trim(candidate, chr(32)||chr(9)||chr(10)||chr(13)) ELSE original END) AS sha FROM v"),
    "word_identity_gate": (word_identity_gate, f"WITH {PAIRS} SELECT doc_id, {WORD} AS verdict FROM pairs"),
    "rewrite_audit": (rewrite_audit, f"WITH {PAIRS} SELECT {SIZE} AS verdict, count(*) AS n, round(avg(length(candidate) / nullif(length(original), 0)), 4) AS mean_ratio FROM pairs GROUP BY 1"),
    "enrich_once": (enrich_once, "SELECT doc_id, '[' || sha256(text) || ']' AS enriched FROM documents"),
    "cost_by_provider": (cost_by_provider, f"SELECT source, provider, round(sum(length({sanitize_sql('text')})) * usd / 1e6, 4) AS usd FROM documents, (VALUES {_VALUES}) AS p(provider, usd) GROUP BY source, provider, usd"),
    "cost_gate": (cost_gate, "WITH e AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 0.0::DOUBLE ELSE length(SANE) * (0.000016::DOUBLE + CASE WHEN doc_id % 3 = 0 THEN 0.00001::DOUBLE ELSE 0.0::DOUBLE END) END AS e FROM documents) SELECT doc_id, round(e, 6) AS estimate, CASE WHEN e > 0 AND doc_id % 2 = 0 AND e > 0.03::DOUBLE THEN 'degrade' WHEN e > 0 AND doc_id % 5 <> 0 THEN 'pending_confirmation' ELSE 'proceed' END AS decision FROM e".replace("SANE", sanitize_sql("text"))),
    "markup_surcharge": (markup_surcharge, _S + ", t AS (SELECT doc, sum(length(text))::BIGINT AS c, count(*) AS n FROM sents GROUP BY doc) SELECT doc, round(c * 16 / 1e6, 6) AS plain, round((c + n * 21) * 16 / 1e6, 6) AS pause_each, round((c + n * 54) * 16 / 1e6, 6) AS style_each, round((c + n * 75) * 16 / 1e6, 6) AS both_each FROM t"),
    "language_codes": (language_codes, CODES_SQL),
    "carry_forward": (carry_forward, "SELECT conv_id, turn, coalesce(last_value(CASE WHEN length(text) >= 60 THEN ['e', 'f', 'p'][length(text) % 3 + 1] END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 'a') AS carried FROM conversations"),
    "language_detect": (language_detect, DETECT_SQL),
    "trim_edges": (trim_edges, TRIM_SQL),
    "concat_signal": (concat_signal, "SELECT label, sum(n)::BIGINT AS n, round(sum(n) / 2000, 4) AS seconds, round(arg_min(embedding[1], vec_id)::DOUBLE, 4) AS first, sum(before)::BIGINT AS starts FROM (SELECT label, vec_id, embedding, len(embedding) + 10 AS n, coalesce(sum(len(embedding) + 10) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM embeddings) GROUP BY label"),
    "expressive_profile": (expressive_profile, _S + " SELECT lang, count(*) AS n, count(*) FILTER (WHERE contains(s.text, '?') AND NOT contains(s.text, '!')) AS asking, count(*) FILTER (WHERE contains(s.text, '!') AND NOT contains(s.text, '?')) AS calling FROM sents s JOIN documents d ON s.doc = d.doc_id GROUP BY lang"),
    "breath_histogram": (breath_histogram, _S + ", r AS (SELECT list_max(list_transform(string_split_regex(text, '[,;:]'), lambda x: length(x))) AS r FROM sents) SELECT CASE WHEN r <= 120 THEN '<=120' WHEN r <= 200 THEN '120-200' WHEN r <= 300 THEN '200-300' ELSE '>300' END AS run, count(*) AS n FROM r GROUP BY 1"),
    "routing_cost": (routing_cost, CHUNKS_SQL.replace("SELECT doc, chunk::BIGINT AS sequence, length(text)::BIGINT AS n_chars, sha256(text) AS sha FROM texts", "SELECT doc, n_chars, coalesce(by_chunk, 0)::BIGINT AS by_chunk, by_sentence FROM (SELECT doc, sum(length(text))::BIGINT AS n_chars, coalesce(sum(length(text)) FILTER (WHERE regexp_matches(text, '[?!]')), 0)::BIGINT AS by_sentence FROM sents GROUP BY doc) LEFT JOIN (SELECT doc, sum(length(text)) AS by_chunk FROM texts WHERE regexp_matches(text, '[?!]') GROUP BY doc) USING (doc)")),
    "timing_summary": (timing_summary, "WITH r AS (SELECT l_suppkey, l_linenumber, sum(l_quantity) AS total, avg(l_quantity) AS each, sum(l_extendedprice) / sum(l_quantity) AS ratio FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, count(*) AS repetitions, round(avg(total), 4) AS mean_total, round(avg(each), 4) AS mean_each, round(avg(ratio), 4) AS mean_ratio FROM r GROUP BY 1"),
    "clause_budget": (clause_budget, CLAUSE_SQL),
}
