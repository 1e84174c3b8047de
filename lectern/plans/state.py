"""Queries over state tables: jobs from orders, progress and heartbeats from events, chunks from documents' lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import state as S
from lectern.plans.text import table
from lectern.sources.stored import Added, InsertOnly, read_generations, replace_partitions
from lectern.streaming.live import scratch


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "F", "done").otherwise("running")
    stage = F.element_at(F.array(F.lit("process"), F.lit("extract"), F.lit("synthesize")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("job"), F.col("o_custkey").alias("book"), stage.alias("stage"), status.alias("status"), (5 - F.substring("o_orderpriority", 1, 1).cast("int")).cast("long").alias("priority"), F.col("o_orderkey").alias("seq"), F.lit(None).cast("string").alias("error_message"))


JOBS = "jobs AS (SELECT o_orderkey AS job, o_custkey AS book, ['process', 'extract', 'synthesize'][o_orderkey % 3 + 1] AS stage, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'done' ELSE 'running' END AS status, 5 - CAST(o_orderpriority[1] AS BIGINT) AS priority, o_orderkey AS seq FROM orders)\n"


def queue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.queue_order(_jobs(spark, sf_dir), 20).select("stage", F.col("place").cast("long").alias("place"), "job", "priority")


def latest_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.latest(_jobs(spark, sf_dir), ["book"], [F.col("seq")]).select("book", "job", "status")


def yield_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.yields(_jobs(spark, sf_dir))


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.requeued(_jobs(spark, sf_dir)).groupBy("stage", "status", "orphaned").agg(F.count("*").alias("n"), F.min("seq").alias("first"))


def prioritize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.prioritized(_jobs(spark, sf_dir), F.col("job") % 100 == 1).select("job", "priority")


def status_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("job")).agg(F.count("*").alias("n"))
    updates = li.select("job", F.when(F.col("n") > 1, "failed").otherwise("done").alias("new_status"), F.when(F.col("n") > 1, F.concat(F.lit("returned "), "n")).alias("message"))
    return S.transitions(_jobs(spark, sf_dir), updates).groupBy("status").agg(F.count("*").alias("n"), F.count("error_message").alias("n_messages"), F.max("error_message").alias("last_message"))


def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("book"), "c_name")
    last = S.latest(_jobs(spark, sf_dir), ["book"], [F.col("seq")]).select("book", "job", "status")
    return keys.join(last, "book", "left")


def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("book"), (F.col("event_id") % 50).alias("sequence"), F.col("value").alias("position"), "ts", "event_id")


def latest_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.latest(_progress(spark, sf_dir), ["book"], [F.col("ts"), F.col("event_id")]).select("book", "sequence", "position", "ts")


def liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats = table(spark, sf_dir, "events").select(F.col("user_id").alias("worker"), "ts")
    return S.liveness(beats, None, 3600)


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    names = F.array(*[F.lit(s) for s in STATUSES])
    return d.select(F.col("doc_id").alias("book"), F.element_at(names, (F.col("doc_id") % 9 + 1).cast("int")).alias("status"), F.when(F.col("doc_id") % 4 != 0, F.size(F.split("text", "\n", -1)) + 1).cast("long").alias("chunk_total"), F.concat(F.lit("e"), "doc_id").alias("error"), F.when(F.col("doc_id") % 3 != 0, F.round(F.col("n_chars") / 1000, 3)).alias("estimated_cost"), (F.col("doc_id") % 5 == 0).alias("cost_confirmed"), (F.col("doc_id") % 7 == 0).alias("cost_degraded"))


STATUSES = ["uploaded", "extracting", "processing", "synthesizing", "ready", "error", "paused", "pending_confirmation", "other"]


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book"), F.posexplode(F.split("text", "\n", -1)).alias("idx", "text"))
    return S.numbered(lines.withColumn("chapter", F.floor(F.col("idx") / 5)))


CHUNKS = "chunks AS (SELECT book, i - 1 AS sequence, (i - 1) // 5 AS chapter, l[i] AS text FROM (SELECT doc_id AS book, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))\n"


def status_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _chunks(spark, sf_dir).where("length(text) % 3 <> 0").groupBy("book").agg(F.count("*").alias("n"))
    rows = _books(spark, sf_dir).join(done, "book", "left").withColumn("chunks_done", F.coalesce("n", F.lit(0)))
    shown = F.when(F.col("chunk_total").isNotNull() & ~F.col("status").isin("ready", "paused"), F.least("chunks_done", "chunk_total"))
    return rows.select("book", "status", "chunks_done", "chunk_total", "estimated_cost", "cost_confirmed", "cost_degraded", F.when(F.col("status") == "error", F.col("error")).alias("error_message"), shown.alias("shown"), *S.status_flags(F.col("status")))


def navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.navigation(_chunks(spark, sf_dir), F.length("text") % 10)
    return rows.select("book", F.col("sequence").cast("long"), F.col("previous").cast("long"), F.col("next").cast("long"))


def position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spoken position of each book's latest progress, with the first chunk of its chapter."""
    rows = _chunks(spark, sf_dir)
    per_chapter = rows.groupBy("book", "chapter").agg(F.min("sequence").alias("first"))
    per_book = rows.groupBy("book").agg(F.count("*").alias("total"), F.countDistinct("chapter").alias("n_chapters"))
    at = S.latest(_progress(spark, sf_dir), ["book"], [F.col("ts"), F.col("event_id")]).select("book", "sequence")
    here = at.join(rows.select("book", "sequence", "chapter"), ["book", "sequence"], "left").join(per_chapter, ["book", "chapter"], "left").join(per_book, "book")
    part = F.when(F.col("chapter").isNotNull(), F.concat(F.lit("Capítulo "), F.col("chapter") + 1, F.lit(" de "), "n_chapters"))
    return here.select("book", F.concat_ws(" · ", part, F.concat(F.lit("trecho "), F.col("sequence") + 1, F.lit(" de "), "total")).alias("text"), F.col("first").cast("long").alias("first_chunk"))


POSITION_SQL = "WITH " + CHUNKS + """,
here AS (SELECT user_id AS book, event_id % 50 AS sequence FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
b AS (SELECT book, count(*) AS total, count(DISTINCT chapter) AS n FROM chunks GROUP BY book),
c AS (SELECT book, chapter, min(sequence) AS first FROM chunks GROUP BY book, chapter)
SELECT here.book, concat_ws(' · ', CASE WHEN chunks.chapter IS NOT NULL THEN 'Capítulo ' || (chunks.chapter + 1) || ' de ' || n END, 'trecho ' || (here.sequence + 1) || ' de ' || total) AS text, first::BIGINT AS first_chunk
FROM here JOIN b USING (book) LEFT JOIN chunks ON chunks.book = here.book AND chunks.sequence = here.sequence LEFT JOIN c ON c.book = here.book AND c.chapter = chunks.chapter
"""


def content_hash_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    return S.known_content(d.where("doc % 2 = 0"), d.where("doc % 2 = 1")).select("doc", "hash")


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).where("length(text) % 3 = 0").select("book", "sequence")


def resume_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = S.resume_plan(_chunks(spark, sf_dir).select("book", "sequence"), _stored(spark, sf_dir))
    return left.groupBy("book").agg(F.count("*").alias("n_left"), F.min("sequence").cast("long").alias("next"))


def resume_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _stored(spark, sf_dir).withColumn("sequence", F.col("sequence") + F.when(F.col("book") % 5 == 0, 3).otherwise(0))
    return S.resume_consistency(_chunks(spark, sf_dir).select("book", "sequence"), stored)


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _progress(spark, sf_dir).select("book", "sequence", F.lit("fetched").alias("origin"))
    known = _stored(spark, sf_dir).select("book", F.col("sequence").cast("long").alias("sequence"), F.lit("known").alias("origin"))
    return S.merged_arrivals(known, rows).groupBy("origin").agg(F.count("*").alias("n"), F.sum("sequence").alias("total"))


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = _books(spark, sf_dir).where(~F.col("status").isin("extracting", "processing", "synthesizing") & (F.col("book") % 4 == 0)).select("book")
    jobs = S.without_keys(_jobs(spark, sf_dir).select("book"), gone, "book").select(F.lit("jobs").alias("t"), "book")
    chunks = S.without_keys(_chunks(spark, sf_dir).select("book"), gone, "book").select(F.lit("chunks").alias("t"), "book")
    books = S.without_keys(_books(spark, sf_dir).select("book"), gone, "book").select(F.lit("books").alias("t"), "book")
    progress = S.without_keys(_progress(spark, sf_dir).select("book"), gone, "book").select(F.lit("progress").alias("t"), "book")
    return jobs.unionAll(chunks).unionAll(progress).unionAll(books).groupBy("t").agg(F.count("*").alias("n"), F.countDistinct("book").alias("n_books"))


def chapter_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chunks(spark, sf_dir).groupBy("book", "chapter").agg(F.count("*").alias("n"))
    new = rows.where("book % 3 = 0").select("book", (F.col("chapter") + 100).alias("chapter"), F.lit(1).cast("long").alias("n"))
    return S.replaced(rows, new, "book").groupBy("book").agg(F.count("*").alias("n_chapters"), F.sum("n").alias("n"), F.min("chapter").alias("first"))


def chunk_sink_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that an insert-only sink would refuse."""
    return _progress(spark, sf_dir).groupBy("book", "sequence").agg(F.count("*").alias("n")).where("n > 1")


def chunk_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals written to a sink that holds each (book, sequence) once: what the sink then has."""
    before = _stored(spark, sf_dir).select("book", F.col("sequence").cast("long").alias("sequence"), F.lit(None).cast("double").alias("position"), F.lit(0).cast("long").alias("order"))
    new = _progress(spark, sf_dir).select("book", "sequence", "position", F.col("event_id").alias("order"))
    sink = InsertOnly(spark, scratch(spark), before.drop("order").schema, ["book", "sequence"])
    for rows, token in ((before, "first"), (new, "second"), (new, "second"), (new, "third")):  # a repeated token, and the same rows under another one
        sink.append(rows, token)
    return sink.read().groupBy("book").agg(F.count("*").alias("n_chunks"), F.round(F.sum("position"), 2).alias("total"))


def chapter_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters in a folder for each book's part; those of some parts are written again, shorter, twice over."""
    chapters = _chunks(spark, sf_dir).groupBy("book", "chapter").agg(F.count("*").alias("n")).withColumn("part", F.col("book") % 16)
    folder = scratch(spark)
    replace_partitions(chapters, folder, "part")
    for _ in range(2):
        replace_partitions(chapters.where("part % 3 = 0 AND chapter < 2").withColumn("n", -F.col("n")), folder, "part")
    return spark.read.parquet(folder).select("book", "chapter", "n", F.col("part").cast("long").alias("part"))


def two_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stored before and after columns were added, read together."""
    events, folder = table(spark, sf_dir, "events").select("event_id", "event_type", "value"), scratch(spark)
    events.where("event_id % 3 = 0").write.parquet(f"{folder}/generation=1")
    newer = events.where("event_id % 3 <> 0").withColumn("priority", (F.col("event_id") % 5).cast("int")).withColumn("note", F.when(F.col("event_id") % 2 == 0, F.col("event_type")))
    newer.write.parquet(f"{folder}/generation=2")
    rows = read_generations(spark, folder, [Added("priority", "int", 2, 0, True), Added("note", "string", 2, "old"), Added("later", "double", 3, 1.5)])
    return rows.groupBy("event_type", "priority", "note", "later").agg(F.count("*").alias("n"))


def confirm_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of even books are confirmed: the books that changed, with the jobs they got."""
    before = _books(spark, sf_dir).select("book", "status", "cost_confirmed")
    after, jobs = S.confirmed(before, _jobs(spark, sf_dir), before.where("book % 2 = 0"))
    new = jobs.where("job IS NULL").select("book", F.col("status").alias("job_status"), "stage", "seq")
    return after.join(new, "book", "left").groupBy("status", "cost_confirmed", "job_status", "stage").agg(F.count("*").alias("n"), F.sum("book").alias("books"), F.max("seq").alias("seq"))


def schema_evolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.add_column(S.add_column(table(spark, sf_dir, "events").drop("props"), "priority", "int", 0, True), "value", "double", 1.0)
    return rows.groupBy("event_type", "priority").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def enum_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.checked(table(spark, sf_dir, "events"), "event_type", ["click", "view", "purchase"]).groupBy("event_type", "accepted").agg(F.count("*").alias("n"))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with their urls."""
    return S.chunk_listing(_chunks(spark, sf_dir)).select("book", F.col("sequence").cast("long").alias("sequence"), "url")


def book_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books, the last created first."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"), "o_totalprice")
    return S.book_listing(rows)


def chapter_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters of each book in order, without their texts."""
    rows = _chunks(spark, sf_dir).groupBy("book", "chapter").agg(F.first("text").alias("text"), F.min("sequence").alias("start_page"), F.max("sequence").alias("end_page"))
    rows = rows.select("book", F.concat(F.lit("c"), "chapter").alias("id"), F.concat(F.lit("Capítulo "), F.col("chapter") + 1).alias("title"), F.col("chapter").cast("long").alias("chapter_order"), F.col("start_page").cast("long").alias("start_page"), F.col("end_page").cast("long").alias("end_page"), "text")
    return S.chapter_listing(rows)


def engine_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("book"), F.col("l_linestatus").alias("engine")).agg(F.count("*").alias("n_chunks"), F.round(F.sum("l_quantity"), 2).alias("seconds"))


def _chunks_sql(sql: str) -> str:
    return "WITH " + CHUNKS + sql


_STATUS = "CASE doc_id % 9 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(STATUSES)) + " END"
_LABEL = "CASE status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.D.STATUS_LABELS.items()) + " ELSE status END"
QUERIES = {
    "queue_order": (queue_order, "WITH " + JOBS + "SELECT * FROM (SELECT stage, row_number() OVER (PARTITION BY stage ORDER BY priority DESC, seq) AS place, job, priority FROM jobs WHERE status = 'queued') WHERE place <= 20"),
    "latest_job": (latest_job, "WITH " + JOBS + "SELECT book, max(job) AS job, arg_max(status, seq) AS status FROM jobs GROUP BY book"),
    "yield_flags": (yield_flags, "WITH " + JOBS + "SELECT job, coalesce((SELECT max(priority) FROM jobs WHERE status = 'queued') > priority, false) AS should_yield FROM jobs"),
    "orphans": (orphans, "WITH " + JOBS + "SELECT stage, CASE WHEN status = 'running' THEN 'queued' ELSE status END AS status, status = 'running' AS orphaned, count(*) AS n, min(seq) AS first FROM jobs GROUP BY 1, 2, 3"),
    "prioritize": (prioritize, "WITH " + JOBS + "SELECT job, CASE WHEN job % 100 = 1 THEN (SELECT max(priority) + 1 FROM jobs) ELSE priority END AS priority FROM jobs"),
    "status_transition": (status_transition, "WITH " + JOBS + ", u AS (SELECT l_orderkey AS job, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), t AS (SELECT CASE WHEN n > 1 THEN 'failed' WHEN n = 1 THEN 'done' ELSE status END AS status, CASE WHEN n > 1 THEN 'returned ' || n END AS m FROM jobs LEFT JOIN u USING (job)) SELECT status, count(*) AS n, count(m) AS n_messages, max(m) AS last_message FROM t GROUP BY status"),
    "lookup": (lookup, "WITH " + JOBS + ", l AS (SELECT book, max(job) AS job, arg_max(status, seq) AS status FROM jobs GROUP BY book) SELECT c_custkey AS book, c_name, job, status FROM customer LEFT JOIN l ON book = c_custkey"),
    "latest_progress": (latest_progress, "SELECT user_id AS book, event_id % 50 AS sequence, value AS position, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"),
    "liveness": (liveness, "SELECT user_id AS worker, max(ts) AS last_beat, (SELECT max(ts) FROM events) - max(ts) <= INTERVAL 3600 SECONDS AS alive FROM events GROUP BY 1"),
    "status_view": (status_view, _chunks_sql(f", b AS (SELECT doc_id AS book, {_STATUS} AS status, CASE WHEN doc_id % 4 <> 0 THEN len(string_split(text, chr(10))) + 1 END AS chunk_total, CASE WHEN doc_id % 3 <> 0 THEN round(n_chars / 1000, 3) END AS estimated_cost, doc_id % 5 = 0 AS cost_confirmed, doc_id % 7 = 0 AS cost_degraded FROM documents), d AS (SELECT book, count(*) AS n FROM chunks WHERE length(text) % 3 <> 0 GROUP BY book) SELECT book, status, coalesce(n, 0) AS chunks_done, chunk_total, estimated_cost, cost_confirmed, cost_degraded, CASE WHEN status = 'error' THEN 'e' || book END AS error_message, CASE WHEN chunk_total IS NOT NULL AND status NOT IN ('ready', 'paused') THEN least(coalesce(n, 0), chunk_total) END AS shown, status IN ('extracting', 'processing', 'synthesizing') AS delete_blocked, status = 'pending_confirmation' AS can_confirm, status IN ('uploaded', 'paused') AS can_prioritize, status IN ('ready', 'error') AS prioritize_refused, status IN ('uploaded', 'extracting', 'processing', 'synthesizing') AS waits_for_worker, {_LABEL} AS label FROM b LEFT JOIN d USING (book)")),
    "navigation": (navigation, _chunks_sql("SELECT book, sequence, CASE WHEN length(text) % 10 > 3 THEN sequence ELSE greatest(sequence - 1, 0) END AS previous, coalesce(lead(sequence) OVER (PARTITION BY book ORDER BY sequence), sequence) AS next FROM chunks")),
    "position": (position, POSITION_SQL),
    "content_hash_skip": (content_hash_skip, "SELECT min(doc_id) AS doc, sha256(text) AS hash FROM documents WHERE doc_id % 2 = 0 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 1) GROUP BY text"),
    "resume_plan": (resume_plan, _chunks_sql("SELECT book, count(*) AS n_left, min(sequence) AS next FROM chunks WHERE length(text) % 3 <> 0 GROUP BY book")),
    "resume_consistency": (resume_consistency, _chunks_sql("SELECT book, count(*) AS n_planned, count(*) FILTER (WHERE length(text) % 3 = 0) AS n_done, coalesce(max(sequence + CASE WHEN book % 5 = 0 THEN 3 ELSE 0 END) FILTER (WHERE length(text) % 3 = 0) >= count(*), false) AS inconsistent FROM chunks GROUP BY book")),
    "arrivals_merge": (arrivals, _chunks_sql(", k AS (SELECT book, sequence FROM chunks WHERE length(text) % 3 = 0), f AS (SELECT DISTINCT user_id AS book, event_id % 50 AS sequence FROM events) SELECT 'known' AS origin, count(*) AS n, sum(sequence)::BIGINT AS total FROM k UNION ALL SELECT 'fetched', count(*), sum(sequence)::BIGINT FROM f ANTI JOIN k USING (book, sequence)")),
    "cascade_delete": (cascade_delete, _chunks_sql(f", gone AS (SELECT doc_id AS book FROM documents WHERE doc_id % 4 = 0 AND {_STATUS} NOT IN ('extracting', 'processing', 'synthesizing')), r AS (SELECT 'jobs' AS t, o_custkey AS book FROM orders UNION ALL SELECT 'chunks', book FROM chunks UNION ALL SELECT 'progress', user_id FROM events UNION ALL SELECT 'books', doc_id FROM documents) SELECT t, count(*) AS n, count(DISTINCT book) AS n_books FROM r ANTI JOIN gone USING (book) GROUP BY t")),
    "chapter_replace": (chapter_replace, _chunks_sql(", c AS (SELECT book, chapter, count(*) AS n FROM chunks GROUP BY 1, 2) SELECT book, count(*) AS n_chapters, CASE WHEN book % 3 = 0 THEN count(*) ELSE sum(n)::BIGINT END AS n, min(chapter) + CASE WHEN book % 3 = 0 THEN 100 ELSE 0 END AS first FROM c GROUP BY book")),
    "chunk_sink_check": (chunk_sink_check, "SELECT user_id AS book, event_id % 50 AS sequence, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1"),
    "schema_evolve": (schema_evolve, "SELECT event_type, 0 AS priority, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1"),
    "enum_split": (enum_split, "SELECT event_type, coalesce(event_type IN ('click', 'view', 'purchase'), false) AS accepted, count(*) AS n FROM events GROUP BY 1"),
    "listing": (listing, _chunks_sql("SELECT book, sequence, '/books/' || book || '/audio/' || sequence AS url FROM chunks")),
    "book_listing": (book_listing, "SELECT o_orderkey AS id, o_orderpriority AS title, o_orderstatus AS status, o_orderdate AS created_at FROM orders"),
    "chapter_listing": (chapter_listing, _chunks_sql("SELECT book, 'c' || chapter AS id, 'Capítulo ' || (chapter + 1) AS title, chapter AS chapter_order, min(sequence) AS start_page, max(sequence) AS end_page FROM chunks GROUP BY book, chapter")),
    "chunk_sink": (chunk_sink, _chunks_sql(", s AS (SELECT book, sequence FROM chunks WHERE length(text) % 3 = 0), f AS (SELECT user_id AS book, event_id % 50 AS sequence, arg_min(value, event_id) AS position FROM events GROUP BY 1, 2), r AS (SELECT book, sequence, NULL::DOUBLE AS position FROM s UNION ALL SELECT * FROM f ANTI JOIN s USING (book, sequence)) SELECT book, count(*) AS n_chunks, round(sum(position), 2) AS total FROM r GROUP BY book")),
    "chapter_store": (chapter_store, _chunks_sql(", c AS (SELECT book, chapter, count(*) AS n, book % 16 AS part FROM chunks GROUP BY book, chapter) SELECT book, chapter, CASE WHEN part % 3 = 0 THEN -n ELSE n END AS n, part FROM c WHERE part % 3 <> 0 OR chapter < 2")),
    "two_generations": (two_generations, "SELECT event_type, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 5 END::INTEGER AS priority, CASE WHEN event_id % 3 = 0 THEN 'old' WHEN event_id % 2 = 0 THEN event_type END AS note, 1.5::DOUBLE AS later, count(*) AS n FROM events GROUP BY 1, 2, 3, 4"),
    "confirm_cost": (confirm_cost, f"WITH b AS (SELECT doc_id AS book, {_STATUS} AS status, doc_id % 5 = 0 AS k FROM documents), c AS (SELECT *, status = 'pending_confirmation' AND book % 2 = 0 AS now FROM b) SELECT CASE WHEN now THEN 'uploaded' ELSE status END AS status, k OR now AS cost_confirmed, CASE WHEN now THEN 'queued' END AS job_status, CASE WHEN now THEN 'process' END AS stage, count(*) AS n, sum(book)::BIGINT AS books, max(CASE WHEN now THEN (SELECT max(o_orderkey) + 1 FROM orders) END) AS seq FROM c GROUP BY 1, 2, 3, 4"),
    "engine_mix": (engine_mix, "SELECT l_suppkey AS book, l_linestatus AS engine, count(*) AS n_chunks, round(sum(l_quantity), 2) AS seconds FROM lineitem GROUP BY 1, 2"),
}
