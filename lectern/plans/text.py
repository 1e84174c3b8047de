"""Queries over the text operators, each with an independent SQL form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import dictionaries as D
from lectern.functions import notation as N
from lectern.llm.store import written
from lectern.operators import text as T
from lectern.operators.order import spread
from lectern.operators.terms import substituted
from lectern.sources import dictionary


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows  # its texts are worked on row by row


def _broken(docs: DataFrame) -> DataFrame:
    """Documents as pages of their source, with a hyphen break and a paragraph break put in by rule."""
    text = F.regexp_replace("text", r"^(\S{4})(\p{Ll})", "$1-\n$2")
    text = F.when(F.col("doc_id") % 3 == 0, F.regexp_replace(text, r"\. ", ".\n\n")).otherwise(text)
    return docs.select(F.col("source").alias("unit"), F.col("doc_id").alias("page"), text.alias("text"))


BROKEN = """
broken AS (SELECT source AS unit, doc_id AS page, CASE WHEN doc_id % 3 = 0 THEN replace(t, '. ', '.' || chr(10) || chr(10)) ELSE t END AS text
  FROM (SELECT source, doc_id, regexp_replace(text, '^(\\S{4})(\\p{Ll})', '\\1-' || chr(10) || '\\2') AS t FROM documents))
"""
LINES = BROKEN + """,
lines AS (SELECT unit, page, i - 1 AS line_no, l[i] AS line, trim(l[i], chr(32)||chr(9)||chr(13)||chr(11)||chr(12)) AS bare
  FROM (SELECT unit, page, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT unit, page, string_split(text, chr(10)) AS l FROM broken))),
rep AS (SELECT unit, bare, count(DISTINCT page) AS n_pages FROM lines WHERE bare <> '' GROUP BY unit, bare HAVING count(DISTINCT page) >= 2)
"""


def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.repeated_lines(T.lines_of(_broken(table(spark, sf_dir, "documents"))))


def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned text of each document, with words and sentences cut by the ends of its pages (a line, then three lines each)."""
    docs = _broken(table(spark, sf_dir, "documents")).select(F.col("page").alias("unit"), F.split("text", "\n", -1).alias("lines"))
    numbers = F.sequence(F.lit(0), F.floor((F.size("lines") + 1) / 3).cast("int"))
    page = lambda k: F.array_join(F.slice("lines", F.greatest(3 * k - 2, F.lit(0)) + 1, F.when(k == 0, 1).otherwise(3)), "\n")
    text = T.clean_text(F.transform(numbers, page))
    return docs.select("unit", text.alias("text")).select("unit", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("sha"))


CLEAN_SQL = "WITH " + BROKEN.replace("source AS unit, doc_id AS page", "doc_id AS unit") + r""",
lines AS (SELECT unit, (i + 1) // 3 AS page, i - 1 AS line_no, l[i] AS line, trim(l[i], chr(32)||chr(9)||chr(13)||chr(11)||chr(12)) AS bare
  FROM (SELECT unit, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT unit, string_split(text, chr(10)) AS l FROM broken))),
rep AS (SELECT unit, bare FROM lines WHERE bare <> '' GROUP BY unit, bare HAVING count(DISTINCT page) >= 2),
left_over AS (SELECT * FROM lines WHERE NOT EXISTS (SELECT 1 FROM rep WHERE rep.unit = lines.unit AND rep.bare = lines.bare)),
j AS (SELECT *, rtrim(line, chr(32)||chr(9)) LIKE '%-' AND coalesce(regexp_matches(lead(bare) OVER w, '^\p{Ll}'), false) AS joins FROM left_over WINDOW w AS (PARTITION BY unit ORDER BY line_no)),
k AS (SELECT *, coalesce(lag(joins) OVER (PARTITION BY unit ORDER BY line_no), false) AS joined FROM j),
g AS (SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY unit ORDER BY line_no) AS grp FROM k),
h AS (SELECT unit, min(line_no) AS line_no, string_agg(CASE WHEN joins THEN regexp_replace(rtrim(CASE WHEN joined THEN ltrim(line) ELSE line END), '-$', '') WHEN joined THEN ltrim(line) ELSE line END, '' ORDER BY line_no) AS line FROM g GROUP BY unit, grp),
b AS (SELECT unit, line_no, trim(line, chr(32)||chr(9)||chr(13)||chr(11)||chr(12)) AS bare FROM h),
s AS (SELECT *, lag(bare) OVER (PARTITION BY unit ORDER BY line_no) AS before FROM b),
o AS (SELECT *, sum(CASE WHEN before IS NULL OR bare = '' OR before = '' OR regexp_matches(before, '[.!?:;"”»)]$') THEN 1 ELSE 0 END) OVER (PARTITION BY unit ORDER BY line_no) AS grp FROM s),
p AS (SELECT unit, grp, string_agg(bare, ' ' ORDER BY line_no) AS line FROM o GROUP BY unit, grp),
f AS (SELECT unit, trim(string_agg(line, chr(10) ORDER BY grp), chr(10)) AS text FROM p GROUP BY unit)
SELECT broken.unit, length(coalesce(f.text, ''))::BIGINT AS n_chars, sha256(coalesce(f.text, '')) AS sha FROM broken LEFT JOIN f USING (unit)
"""


def clean_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned pieces of each source, its documents being its pages: units too long for a row."""
    rows = T.clean_lines(_broken(table(spark, sf_dir, "documents")))
    return rows.select("unit", F.col("line").cast("long").alias("line"), F.length("piece").cast("long").alias("n_chars"), F.sha2("piece", 256).alias("sha"))


UNITS_SQL = "WITH " + LINES + r""",
numbered AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY page, line_no) - 1 AS pos FROM lines),
left_over AS (SELECT * FROM numbered WHERE NOT EXISTS (SELECT 1 FROM rep WHERE rep.unit = numbered.unit AND rep.bare = numbered.bare)),
j AS (SELECT *, bare LIKE '%-' AND coalesce(regexp_matches(lead(bare) OVER w, '^\p{Ll}'), false) AS joins, lag(bare) OVER w AS ahead FROM left_over WINDOW w AS (PARTITION BY unit ORDER BY pos)),
k AS (SELECT *, coalesce(lag(joins) OVER w, false) AS joined, min(pos) FILTER (WHERE bare <> '') OVER (PARTITION BY unit) AS first, max(pos) FILTER (WHERE bare <> '') OVER (PARTITION BY unit) AS last FROM j WINDOW w AS (PARTITION BY unit ORDER BY pos)),
p AS (SELECT unit, pos, CASE WHEN joined OR pos = first THEN '' WHEN bare = '' OR ahead = '' OR regexp_matches(ahead, '[.!?:;"”»)]$') THEN chr(10) ELSE ' ' END || CASE WHEN joins THEN regexp_replace(bare, '-$', '') ELSE bare END AS piece FROM k WHERE pos BETWEEN first AND last)
SELECT unit, pos::BIGINT AS line, length(piece)::BIGINT AS n_chars, sha256(piece) AS sha FROM p
"""


def _docs(spark: SparkSession, sf_dir: str, *others: Column) -> DataFrame:
    """Documents as narration text: every third one with paragraph breaks, every second with an abbreviation put in."""
    text = F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", r"\n", "\n\n")).otherwise(F.col("text"))
    text = F.when(F.col("doc_id") % 2 == 0, F.replace(text, F.lit(". The "), F.lit(" Dr. The "))).otherwise(text)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), text.alias("text"), *others)


DOCS = r"""
docs AS (SELECT doc_id AS doc, CASE WHEN doc_id % 2 = 0 THEN replace(t, '. The ', ' Dr. The ') ELSE t END AS text
  FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, chr(10), chr(10) || chr(10)) ELSE text END AS t FROM documents)),
paras AS (SELECT doc, i - 1 AS paragraph, trim(regexp_replace(l[i], '\s+', ' ', 'g')) AS text
  FROM (SELECT doc, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc, string_split_regex(text, '\n\s*\n') AS l FROM docs))),
parts AS (SELECT doc, paragraph, i AS part, l[i] AS text
  FROM (SELECT doc, paragraph, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc, paragraph, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(30), 'g'), chr(30)) AS l FROM paras WHERE text <> '')) WHERE l[i] <> ''),
words AS (SELECT *, regexp_extract(lag(text) OVER (PARTITION BY doc, paragraph ORDER BY part), '([A-Za-zÀ-ÿ0-9º°]+)\.$', 1) AS word FROM parts),
marked AS (SELECT *, sum(CASE WHEN coalesce(word, '') <> '' AND (length(word) = 1 OR lower(word) IN (ABBR)) THEN 0 ELSE 1 END) OVER (PARTITION BY doc, paragraph ORDER BY part) AS sentence FROM words),
sents AS (SELECT doc, paragraph, sentence - 1 AS sentence, string_agg(text, ' ' ORDER BY part) AS text FROM marked GROUP BY doc, paragraph, sentence)
""".replace("ABBR", ", ".join(f"'{a}'" for a in D.NO_SENTENCE_END))


def sentence_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc", T.sentence_texts(F.col("text")).alias("own")).where(F.size("own") > 0)
    lengths = F.transform(F.flatten("own"), lambda s: F.length(s).cast("long"))
    total = F.aggregate(lengths, F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select("doc", F.size(lengths).cast("long").alias("n_sentences"), F.size("own").cast("long").alias("n_paragraphs"), total.alias("n_chars"), F.array_max(lengths).alias("longest"))


def false_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the ends at which a document could be cut (after . ! or ? and a blank) are none of a sentence."""
    parts = _docs(spark, sf_dir).select("doc", F.explode(F.flatten(F.transform(T.paragraph_texts(F.col("text")), lambda p: N.cut(p, r"(?U)(?<=[.!?])\s+")))).alias("part"))
    return parts.where("part <> ''").groupBy("doc").agg(F.count("*").alias("n_parts"), F.count(F.when(T.false_boundary(F.col("part")), 1)).alias("n_false"))


def sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.chunks(_docs(spark, sf_dir))
    return rows.select("doc", F.col("sequence").cast("long").alias("sequence"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("sha"))


CHUNKS_SQL = "WITH RECURSIVE " + DOCS + """,
seq AS (SELECT doc, row_number() OVER w AS i, text, length(text) AS n, CASE WHEN lag(paragraph) OVER w = paragraph THEN ' ' ELSE chr(10) || chr(10) END AS gap FROM sents WINDOW w AS (PARTITION BY doc ORDER BY paragraph, sentence)),
fold AS (
  SELECT doc, i, n AS size, 0 AS chunk FROM seq WHERE i = 1
  UNION ALL
  SELECT s.doc, s.i, CASE WHEN f.size + length(s.gap) + s.n <= 1000 THEN f.size + length(s.gap) + s.n ELSE s.n END, f.chunk + CASE WHEN f.size + length(s.gap) + s.n <= 1000 THEN 0 ELSE 1 END
  FROM fold f JOIN seq s ON s.doc = f.doc AND s.i = f.i + 1
), texts AS (
  SELECT doc, chunk, string_agg(CASE WHEN first THEN text ELSE gap || text END, '' ORDER BY i) AS text
  FROM (SELECT s.doc, s.i, s.text, s.gap, f.chunk, row_number() OVER (PARTITION BY s.doc, f.chunk ORDER BY s.i) = 1 AS first FROM seq s JOIN fold f ON s.doc = f.doc AND s.i = f.i) GROUP BY doc, chunk
) SELECT doc, chunk::BIGINT AS sequence, length(text)::BIGINT AS n_chars, sha256(text) AS sha FROM texts
"""


def sanitize_sql(text: str) -> str:
    """SQL for what sanitising does to ordinary text: code fences and numbered lists, which no document has, aside."""
    letters, t = r"\p{L}\p{M}\p{N}_", text
    for pattern, by in (
        (r"(?i)https?://(?:([^\s<>''\"]*[^\s<>''\".,;:!?])([.,;:!?]*)|([.,;:!?]+))", r"link\2\3"),
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "endereço de e-mail"),
        (r"\*\*(.+?)\*\*|\*([^\s*][^*]*?)\*|`([^`]+?)`", r"\1\2\3"),
        (r"(?m)^(?:#{1,6}\s*|>\s?|[-*+]\s+)", ""),
    ):
        t = f"regexp_replace({t}, '{pattern}', '{by}', 'g')"
    row = "CASE WHEN trim(x) NOT LIKE '|%' THEN x WHEN regexp_matches(trim(x), '^\\|[|: -]*\\|$') AND x LIKE '%-%' THEN NULL ELSE array_to_string(list_filter(list_transform(string_split(x, '|'), lambda y: trim(y)), lambda y: y <> ''), ', ') END"
    t = f"array_to_string(list_filter(list_transform(string_split({t}, chr(10)), lambda x: {row}), lambda x: x IS NOT NULL), chr(10))"
    for sign, word in (("R\\$", "reais"), ("(?:US\\$|\\$)", "dólares"), ("€", "euros"), ("£", "libras")):
        t = f"regexp_replace({t}, '{sign}\\s*(\\d[\\d.,]*\\d|\\d)', '\\1 {word}', 'g')"
    for sign, word in D.SYMBOLS.items():
        t = f"replace({t}, '{sign}', '{word}')"
    for short, word in D.ABBREVIATIONS.items():
        t = f"regexp_replace({t}, '(?i)(^|[^{letters}]){short}\\.', '\\1{word}', 'g')"
    for pattern, by in (
        (rf"(^|[^{letters}])(\d{{1,2}})h(\d{{2}})($|[^0-9])", r"\1\2 e \3\4"),
        (rf"(^|[^{letters}])(\d{{1,2}})h($|[^{letters}])", r"\1\2 horas\3"),
        (r"([0-9])\s*–\s*([0-9])", r"\1 a \2"),
    ):
        t = f"regexp_replace({t}, '{pattern}', '{by}', 'g')"
    return t


def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chunks the sanitised text of each document makes, and their characters."""
    sizes = lambda c: F.struct(F.size(c).cast("long").alias("n_chunks"), F.aggregate(c, F.lit(0).cast("long"), lambda s, t: s + F.length(t)).alias("n_chars"))
    return _docs(spark, sf_dir).select("doc", F.inline(F.array(N.let(T.chunk_texts(N.sanitize(F.col("text"))), sizes))))  # a generator: a text is sanitised once


SANE_DOCS = DOCS.replace("SELECT doc_id AS doc, CASE", "SELECT doc, " + sanitize_sql("raw") + " AS text FROM (SELECT doc_id AS doc, CASE", 1).replace("ELSE t END AS text\n", "ELSE t END AS raw\n", 1).replace("FROM documents)),", "FROM documents))),", 1)
COUNTS_SQL = CHUNKS_SQL.replace(DOCS, SANE_DOCS).replace("SELECT doc, chunk::BIGINT AS sequence, length(text)::BIGINT AS n_chars, sha256(text) AS sha FROM texts", "SELECT docs.doc, count(texts.text) AS n_chunks, coalesce(sum(length(texts.text)), 0)::BIGINT AS n_chars FROM docs LEFT JOIN texts USING (doc) GROUP BY docs.doc")


def pause_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc", T.pause_segments(F.col("text")).alias("own")).where(F.size("own") > 0)
    sum_of = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    pause = F.transform("own", lambda s: s.pause_ms)
    return rows.select("doc", F.size("own").cast("long").alias("n_segments"), sum_of(pause).alias("pause_ms"), sum_of(F.transform(pause, lambda p, i: p * i)).alias("weighted"))


PAUSES_SQL = "WITH " + DOCS + """,
p AS (SELECT doc, row_number() OVER w - 1 AS segment, CASE WHEN lead(paragraph) OVER w IS NULL THEN 0 WHEN lead(paragraph) OVER w <> paragraph THEN 800 WHEN right(text, 1) = '!' THEN 520 WHEN right(text, 1) = '?' THEN 470 ELSE 420 END AS pause_ms FROM sents WINDOW w AS (PARTITION BY doc ORDER BY paragraph, sentence))
SELECT doc, count(*) AS n_segments, sum(pause_ms)::BIGINT AS pause_ms, sum(pause_ms * segment)::BIGINT AS weighted FROM p GROUP BY doc
"""


def request_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "conversations")).select("conv_id", "turn", F.posexplode(T.split_words(F.col("text"), 80)).alias("piece", "text"))
    return rows.select("conv_id", "turn", F.col("piece").cast("long").alias("piece"), "text")


SPLIT_SQL = r"""
WITH RECURSIVE w AS (SELECT conv_id, turn, text, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS l FROM conversations),
fold AS (
  SELECT conv_id, turn, l, 1 AS i, 0 AS piece, l[1] AS cur FROM w WHERE NOT (length(text) <= 80 OR len(l) <= 1)
  UNION ALL
  SELECT conv_id, turn, l, i + 1, CASE WHEN length(cur) + 1 + length(l[i + 1]) <= 80 THEN piece ELSE piece + 1 END, CASE WHEN length(cur) + 1 + length(l[i + 1]) <= 80 THEN cur || ' ' || l[i + 1] ELSE l[i + 1] END
  FROM fold WHERE i < len(l))
SELECT conv_id, turn, 0::BIGINT AS piece, text FROM w WHERE text IS NOT NULL AND (length(text) <= 80 OR len(l) <= 1)
UNION ALL SELECT conv_id, turn, piece::BIGINT, arg_max(cur, i) FROM fold GROUP BY conv_id, turn, piece
"""


def sanitize_notation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence in notation is built from each line item and sanitised; SQL builds the spoken sentence from the columns."""
    li = spread(table(spark, sf_dir, "lineitem").where("l_shipdate IS NOT NULL"))
    day = F.date_format("l_shipdate", "dd/MM/yyyy")
    price = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    text = F.concat(F.lit("Em "), day, F.lit(" o prof. leu as págs. "), "l_partkey", F.lit("-"), F.col("l_partkey") + F.col("l_linenumber"), F.lit(" às "), F.col("l_linenumber") + 8, F.lit("h30, por R$ "), price, F.lit(" & "), "l_linenumber", F.lit("% de US$ "), F.col("l_suppkey"), F.lit("."))
    return li.select("l_orderkey", "l_linenumber", N.sanitize(text).alias("text"))


NOTATION_SQL = f"""
SELECT l_orderkey, l_linenumber, concat('Em ', lpad(day(l_shipdate)::VARCHAR, 2, '0'), ' de ', {D.MONTHS!r}[month(l_shipdate)], ' de ', year(l_shipdate), ' o professor leu as páginas ', l_partkey, ' a ', l_partkey + l_linenumber, ' às ', l_linenumber + 8, ' e 30, por ', l_extendedprice::DECIMAL(18,2), ' reais e ', l_linenumber, 'por cento de ', l_suppkey, ' dólares.') AS text
FROM lineitem WHERE l_shipdate IS NOT NULL
"""


def sanitize_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown is wrapped around each document's first word and sanitised; SQL writes what must come out."""
    w = F.concat(F.lit("w"), F.regexp_extract("text", "[A-Za-z]+", 0))
    text = F.concat_ws("\n", F.concat(F.lit("# "), w), F.concat(F.lit("> **"), w, F.lit("** e *"), w, F.lit("* `"), w, F.lit("`")), F.lit("```py"), w, F.lit("~~~"), F.lit("```"), F.concat(F.lit("1. "), w), F.concat(F.lit("2) "), w), F.lit("prosa"), F.concat(F.lit("3. "), w), F.concat(F.lit("| "), w, F.lit(" | b |")), F.lit("|---|:-:|"), F.concat(F.lit("https://x.com/"), w, F.lit(". a@b.com")), F.lit("~~~"), w)
    return table(spark, sf_dir, "documents").select("doc_id", N.sanitize(text).alias("text"))


MARKUP_SQL = """
SELECT doc_id, concat_ws(chr(10), w, w || ' e ' || w || ' ' || w, 'trecho de código omitido', w, w, 'prosa', '3. ' || w, w || ', b', 'link. endereço de e-mail', 'trecho de código omitido') AS text
FROM (SELECT doc_id, 'w' || regexp_extract(text, '[A-Za-z]+') AS w FROM documents)
"""


def sanitize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain over the whole text of every document."""
    rows = table(spark, sf_dir, "documents").select("doc_id", N.sanitize(F.col("text")).alias("text"))
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("sha"))


DOCUMENTS_SQL = f"SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(t) AS sha FROM (SELECT doc_id, {sanitize_sql('text')} AS t FROM documents)"


def _term_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a dictionary file: every part's first name word with a spelling, some of them comments or broken."""
    name = F.substring_index("p_name", " ", 1)
    line = F.when(F.col("n") % 5 == 0, F.concat(F.lit("# "), "word")).when(F.col("n") % 7 == 0, F.col("word")).otherwise(F.concat("word", F.lit(': "'), F.upper("word"), F.lit(' $1"')))
    return table(spark, sf_dir, "part").select(name.alias("word")).groupBy("word").agg(F.count("*").alias("n")).select(line.alias("value"))


def term_substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments of a text with the terms of a dictionary, read as lines, put in by one pass."""
    names = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(", ("), F.upper("p_name"), F.lit(")")).alias("text"))
    return substituted(names, dictionary.terms_of(_term_lines(spark, sf_dir)))


TERMS_SQL = """
WITH w AS (SELECT split_part(p_name, ' ', 1) AS word, count(*) AS n FROM part GROUP BY 1),
t AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS word, substr(p_name, length(split_part(p_name, ' ', 1)) + 1) AS rest FROM part)
SELECT p_partkey, CASE WHEN n % 5 <> 0 AND n % 7 <> 0 THEN upper(word) || ' $1' ELSE word END || rest || ', (' || upper(word) || CASE WHEN n % 5 <> 0 AND n % 7 <> 0 THEN ' $1' ELSE '' END || upper(rest) || ')' AS text
FROM t JOIN w USING (word)
"""

def term_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a spelling put in for half of all their words: a dictionary that grows with the corpus, far beyond a pattern."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w{4,}"), F.lit(0))).alias("term")).where("length(term) % 2 = 0").distinct()
    terms = written(words.select("term", F.concat(F.lit("<"), "term", F.lit("$1>")).alias("spoken")), "dictionary")
    rows = substituted(docs, terms, pattern_terms=100)
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("sha"))


DICTIONARY_SQL = r"""
WITH t AS (SELECT doc_id, i, l[i] AS w FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_]') AS l FROM documents))),
s AS (SELECT doc_id, string_agg(CASE WHEN length(w) >= 4 AND length(w) % 2 = 0 THEN '<' || lower(w) || '$1>' ELSE w END, '' ORDER BY i) AS text FROM t GROUP BY doc_id)
SELECT doc_id, length(coalesce(s.text, ''))::BIGINT AS n_chars, sha256(coalesce(s.text, '')) AS sha FROM documents LEFT JOIN s USING (doc_id)
"""

QUERIES = {
    "repeated_lines": (repeated_lines, "WITH " + LINES + "SELECT unit, bare, n_pages FROM rep"),
    "clean_pages": (clean_pages, CLEAN_SQL),
    "clean_units": (clean_units, UNITS_SQL),
    "sentence_profile": (sentence_profile, "WITH " + DOCS + "SELECT doc, count(*) AS n_sentences, count(DISTINCT paragraph) AS n_paragraphs, sum(length(text))::BIGINT AS n_chars, max(length(text))::BIGINT AS longest FROM sents GROUP BY doc"),
    "sentence_chunks": (sentence_chunks, CHUNKS_SQL),
    "false_boundaries": (false_boundaries, "WITH " + DOCS + ", e AS (SELECT doc, regexp_extract(text, '([A-Za-zÀ-ÿ0-9º°]+)\\.$', 1) AS word FROM parts) SELECT doc, count(*) AS n_parts, count(*) FILTER (WHERE word <> '' AND (length(word) = 1 OR lower(word) IN (ABBR))) AS n_false FROM e GROUP BY doc".replace("ABBR", ", ".join(f"'{a}'" for a in D.NO_SENTENCE_END))),
    "chunk_counts": (chunk_counts, COUNTS_SQL),
    "pause_segments": (pause_segments, PAUSES_SQL),
    "request_split": (request_split, SPLIT_SQL),
    "sanitize_notation": (sanitize_notation, NOTATION_SQL),
    "sanitize_markup": (sanitize_markup, MARKUP_SQL),
    "sanitize_documents": (sanitize_documents, DOCUMENTS_SQL),
    "term_substitution": (term_substitution, TERMS_SQL),
    "term_dictionary": (term_dictionary, DICTIONARY_SQL),
}
