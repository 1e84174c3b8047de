"""Queries over the remaining operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import rules as R
from lectern.operators import text as T
from lectern.plans.state import _STATUS, STATUSES
from lectern.plans.text import DOCS, _docs, table


def register_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col("doc_id") % len(v) + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("source")).alias("filename"), F.when(F.col("doc_id") % 7 == 0, "xx").otherwise(F.col("lang")).alias("language"), pick("af_heart", "ff_siwis", "nobody").alias("voice"))
    return R.registered(rows)


UPLOAD_SQL = """
SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN doc_id::VARCHAR ELSE source END AS title, 'uploaded' AS status, CASE WHEN doc_id % 7 <> 0 AND lang IN ('en', 'es', 'fr', 'hi', 'it', 'pt', 'ja', 'zh-cn', 'zh-tw') THEN lang END AS language,
  CASE WHEN doc_id % 7 <> 0 AND lang = 'en' AND doc_id % 3 = 0 THEN 'af_heart' WHEN doc_id % 7 <> 0 AND lang = 'fr' AND doc_id % 3 = 1 THEN 'ff_siwis' END AS voice FROM documents
"""


def page_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.paginated(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"), 4)
    return rows.select("doc", F.col("page_number").cast("long").alias("page_number"), F.sha2("text", 256).alias("sha"))


PAGES_SQL = """
SELECT doc, (i - 1) // 4 + 1 AS page_number, sha256(string_agg(l[i], chr(10) ORDER BY i)) AS sha
FROM (SELECT doc, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id AS doc, string_split(text, chr(10)) AS l FROM documents)) GROUP BY 1, 2
"""


def status_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    status = F.element_at(F.array(*[F.lit(s) for s in STATUSES]), (k % 9 + 1).cast("int"))
    text = R.status_message(status, k % 4, F.when(k % 5 != 0, k % 4 + 2), F.when(k % 2 == 0, F.round(F.col("n_chars") / 10, 2)), k % 6 == 4)
    return d.select("doc_id", text.alias("message"))


MESSAGES_SQL = f"""
WITH b AS (SELECT doc_id, {_STATUS} AS status, doc_id % 4 AS done, CASE WHEN doc_id % 5 <> 0 THEN doc_id % 4 + 2 END AS total, CASE WHEN doc_id % 2 = 0 THEN round(n_chars / 10, 2) END AS est, doc_id % 6 = 4 AS deg FROM documents),
p AS (SELECT *, CASE WHEN total IS NULL THEN 'Status: ' || CASE status WHEN 'uploaded' THEN 'Na fila — aguardando processamento' WHEN 'extracting' THEN 'Extraindo' WHEN 'processing' THEN 'Processando' WHEN 'synthesizing' THEN 'Sintetizando' ELSE status END ELSE 'Sintetizando: ' || done || ' de ' || total || ' chunks' END AS progress FROM b)
SELECT doc_id, CASE status
  WHEN 'pending_confirmation' THEN 'Aguardando confirmação de custo — este livro deve custar ' || CASE WHEN est > 0 THEN 'US$ ' || translate(format('{{:,.2f}}', est), ',.', '.,') ELSE '?' END || '.'
  WHEN 'paused' THEN CASE WHEN done > 0 THEN 'Pausado — tocando o que já foi sintetizado.' ELSE 'Pausado.' END
  WHEN 'error' THEN CASE WHEN done > 0 THEN 'Erro no processamento — tocando os ' || done || ' trecho(s) já sintetizados.' ELSE 'Erro: processamento falhou.' END
  WHEN 'ready' THEN CASE WHEN done = 0 THEN 'Nenhum áudio disponível.' WHEN deg THEN 'Pronto — processado com voz local (custo acima do teto).' ELSE 'Pronto.' END
  ELSE progress || CASE WHEN done > 0 THEN ' — tocando o que já está pronto' ELSE '' END END AS message FROM p
"""


def normalizer_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents opt in by id; the first transform keeps the words and is accepted, the second drops one and is undone, the third raises on every text of an odd length."""

    def fragile(text: str) -> str:
        if len(text) % 2:
            raise ValueError("odd")
        return text.replace(";", "!")

    steps = [lambda t: F.translate(t, ",", ";"), lambda t: F.regexp_replace(t, r"^\S+\s", ""), R.guarded(fragile)]
    rows = R.normalized(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", steps, F.col("doc_id") % 2 == 0)
    return rows.select("doc_id", F.sha2("normalized", 256).alias("sha"), F.col("normalize_error").isNotNull().alias("failed"))


CHAIN_SQL = r"""
WITH s AS (SELECT doc_id, text, trim(translate(text, ',', ';'), chr(32)||chr(9)||chr(10)||chr(13)) AS one FROM documents),
t AS (SELECT *, regexp_replace(one, '^\S+\s', '') AS two, regexp_extract_all(lower(one), '[\p{L}\p{M}\p{N}_]+') AS w FROM s)
SELECT doc_id, sha256(CASE WHEN doc_id % 2 <> 0 THEN text WHEN length(done) % 2 = 0 THEN replace(done, ';', '!') ELSE done END) AS sha, doc_id % 2 = 0 AND length(done) % 2 = 1 AS failed
FROM (SELECT *, CASE WHEN trim(two) <> '' AND regexp_extract_all(lower(two), '[\p{L}\p{M}\p{N}_]+') = w THEN two ELSE one END AS done FROM t)
"""


def budget_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences within 50 characters; English ones are exempt."""
    rows = _docs(spark, sf_dir, F.when(F.col("lang") == "en", "a").otherwise("e").alias("code"))
    return T.split_budget(T.sentences(rows).select("doc", "paragraph", "sentence", "text", "code"), 50, code=F.col("code")).withColumn("piece_no", F.col("piece_no").cast("long"))


BUDGET_SQL = "WITH RECURSIVE " + DOCS + r""",
s AS (SELECT doc, paragraph, sentence, s.text, CASE WHEN lang = 'en' THEN 'a' ELSE 'e' END AS code FROM sents s JOIN documents ON doc = doc_id),
p AS (
  SELECT *, '' AS path, text AS t, code <> 'a' AND length(text) > 50 AND contains(text, ' ') AS again FROM s
  UNION ALL
  SELECT doc, paragraph, sentence, text, code, path || lpad(i::VARCHAR, 4, '0'), parts[i], length(parts[i]) > 50 AND contains(parts[i], ' ') FROM (
    SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM (
      SELECT *, CASE WHEN len(clauses) > 1
        THEN string_split(list_reduce(clauses, lambda a, c: a || CASE WHEN length(regexp_extract(a, '[^\x1E]*$')) + 1 + length(c) <= 50 THEN ' ' ELSE chr(30) END || c), chr(30))
        ELSE list_filter([trim(substr(t, 1, cut_at)), trim(substr(t, cut_at + 1))], lambda c: c <> '') END AS parts
      FROM (
        SELECT *, CASE WHEN mark + 1 < length(t) THEN mark + 1 ELSE blank END AS cut_at FROM (
          SELECT *, string_split(regexp_replace(t, '([,;:])\s+', '\1' || chr(30), 'g'), chr(30)) AS clauses,
            list_min(list_transform(list_filter(range(1, length(t)), lambda k: contains(',;:', substr(t, k + 1, 1))), lambda k: abs(k - length(t) // 2) * 100000 + k)) % 100000 AS mark,
            list_min(list_transform(list_filter(range(1, length(t)), lambda k: substr(t, k + 1, 1) = ' '), lambda k: abs(k - length(t) // 2) * 100000 + k)) % 100000 AS blank
          FROM p WHERE again)))))
SELECT doc, paragraph::INTEGER AS paragraph, sentence::INTEGER AS sentence, text, code, row_number() OVER (PARTITION BY doc, paragraph, sentence ORDER BY path) - 1 AS piece_no, t AS piece FROM p WHERE NOT again
"""


QUERIES = {
    "register_upload": (register_upload, UPLOAD_SQL),
    "page_source": (page_source, PAGES_SQL),
    "status_messages": (status_messages, MESSAGES_SQL),
    "normalizer_chain": (normalizer_chain, CHAIN_SQL),
    "budget_split": (budget_split, BUDGET_SQL),
}
