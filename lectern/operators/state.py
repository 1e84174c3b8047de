"""Questions about queues, progress, heartbeats and stored chunks, over snapshot tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import dictionaries as D
from lectern.operators.order import neighbours, with_sum_before


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each key that comes last in the order; a later upsert overwrites an earlier one.

    One aggregate with a map-side combine, so a key with very many versions is no hot group.
    """
    others = [c for c in rows.columns if c not in keys]
    top = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("top"))
    return top.select(*keys, "top.*")


def queue_order(jobs: DataFrame, top: int) -> DataFrame:
    """The first queued jobs of each stage: higher priority first, then insertion order."""
    order = Window.partitionBy("stage").orderBy(F.desc("priority"), "seq")
    return jobs.where("status = 'queued'").withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def yields(jobs: DataFrame) -> DataFrame:
    """(job, should_yield): a queued job of strictly greater priority exists; the maximum is one row, joined to all."""
    most = jobs.where("status = 'queued'").agg(F.max("priority").alias("most"))
    return jobs.crossJoin(F.broadcast(most)).select("job", F.coalesce(F.col("most") > F.col("priority"), F.lit(False)).alias("should_yield"))


def requeued(jobs: DataFrame) -> DataFrame:
    """Running jobs are queued again; orphaned marks them."""
    return jobs.withColumn("orphaned", F.col("status") == "running").withColumn("status", F.when(F.col("status") == "running", "queued").otherwise(F.col("status")))


def prioritized(jobs: DataFrame, chosen: Column) -> DataFrame:
    """Chosen jobs get a priority one above the highest of all."""
    most = jobs.agg((F.coalesce(F.max("priority"), F.lit(0)) + 1).alias("next"))
    return jobs.crossJoin(F.broadcast(most)).withColumn("priority", F.when(chosen, F.col("next")).otherwise(F.col("priority"))).drop("next")


def transitions(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """Jobs with (job, new_status, message) applied: the message of a matched job is overwritten, with null too."""
    matched = F.col("new_status").isNotNull()
    return jobs.join(updates, "job", "left").withColumn("status", F.coalesce("new_status", "status")).withColumn("error_message", F.when(matched, F.col("message")).otherwise(F.col("error_message"))).drop("new_status", "message")


def confirmed(books: DataFrame, jobs: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Books and jobs after the costs of the chosen books are confirmed.

    A chosen book that waits for it becomes uploaded and cost_confirmed, and gets a queued job to process, after all others in
    insertion order; any other is left as it is. New jobs have a null id until the queue gives one.
    """
    waits = chosen.select("book").distinct().withColumn("__chosen", F.lit(True))
    marked = books.join(waits, "book", "left").withColumn("__now", F.coalesce(F.col("__chosen") & (F.col("status") == "pending_confirmation"), F.lit(False)))
    after = marked.withColumn("status", F.when(F.col("__now"), "uploaded").otherwise(F.col("status"))).withColumn("cost_confirmed", F.col("__now") | F.col("cost_confirmed"))
    last = jobs.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last"))
    new = marked.where("__now").crossJoin(F.broadcast(last)).select("book", F.lit("process").alias("stage"), F.lit("queued").alias("status"), F.lit(0).cast("long").alias("priority"), (F.col("last") + 1).alias("seq"))
    return after.drop("__now", "__chosen"), jobs.unionByName(new, allowMissingColumns=True)


def appended(stored: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to append, rows refused): a sink keeps the first row of each key, whether stored before or earlier in new (by its order column)."""
    window = Window.partitionBy(*keys).orderBy("order")
    ranked = new.withColumn("__at", F.row_number().over(window)).join(stored.select(*keys).distinct().withColumn("__had", F.lit(True)), keys, "left")
    fresh = F.col("__had").isNull() & (F.col("__at") == 1)
    return ranked.where(fresh).drop("__at", "__had"), ranked.where(~fresh).drop("__at", "__had")


def liveness(beats: DataFrame, as_of: Column | None = None, seconds: int = 120) -> DataFrame:
    """(worker, last_beat, alive): alive if the last beat is at most so many seconds before as_of, or before the last of all beats."""
    last = beats.groupBy("worker").agg(F.max("ts").alias("last_beat"))
    if as_of is None:
        last, as_of = last.crossJoin(F.broadcast(last.agg(F.max("last_beat").alias("__as_of")))), F.col("__as_of")
    return last.select("*", ( F.unix_micros(F.to_timestamp(as_of)) - F.unix_micros(F.col("last_beat").cast("timestamp")) <= seconds * 1_000_000).alias("alive")).drop("__as_of")


def book_listing(books: DataFrame) -> DataFrame:
    """(id, title, status, created_at), the last created first."""
    return books.select("id", "title", "status", "created_at").orderBy(F.desc("created_at"), "id")


def chapter_listing(chapters: DataFrame) -> DataFrame:
    """Chapters without their texts, each book's in order."""
    return chapters.select("book", "id", "title", "chapter_order", "start_page", "end_page").orderBy("book", "chapter_order")


def chunk_listing(chunks: DataFrame) -> DataFrame:
    """(book, sequence, url) of stored chunks."""
    return chunks.select("book", "sequence", F.concat(F.lit("/books/"), "book", F.lit("/audio/"), "sequence").alias("url"))


def resume_plan(planned: DataFrame, stored: DataFrame) -> DataFrame:
    """Planned (book, sequence) that aren't stored."""
    return planned.join(stored.select("book", "sequence"), ["book", "sequence"], "left_anti")


def resume_consistency(planned: DataFrame, stored: DataFrame) -> DataFrame:
    """(book, n_planned, n_done, inconsistent): something stored lies at or beyond the planned count; holes below are fine."""
    done = stored.groupBy("book").agg(F.max("sequence").alias("last"), F.count("*").alias("n_done"))
    return planned.groupBy("book").agg(F.count("*").alias("n_planned")).join(done, "book", "left").select("book", "n_planned", F.coalesce("n_done", F.lit(0)).alias("n_done"), F.coalesce(F.col("last") >= F.col("n_planned"), F.lit(False)).alias("inconsistent"))


def merged_arrivals(known: DataFrame, fetched: DataFrame) -> DataFrame:
    """Known rows, and fetched ones whose (book, sequence) is new; of repeated fetched keys one stays."""
    return known.unionByName(fetched.dropDuplicates(["book", "sequence"]).join(known.select("book", "sequence"), ["book", "sequence"], "left_anti"))


def without_keys(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Cascade delete: rows of keys that aren't deleted."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def replaced(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of each key in new are replaced by new's; other keys stay."""
    return without_keys(rows, new, key).unionByName(new)


def add_column(rows: DataFrame, name: str, kind: str, default: object | None = None, required: bool = False) -> DataFrame:
    """Adds a missing column with its default; does nothing if it is there. A required column needs a default."""
    if required and default is None:
        raise ValueError(f"column {name} is required and has no default")
    return rows if name in rows.columns else rows.withColumn(name, F.lit(default).cast(kind))


def checked(rows: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """rows with accepted: the value is one of those allowed."""
    return rows.withColumn("accepted", F.coalesce(F.col(column).isin(*allowed), F.lit(False)))


def status_flags(status: Column) -> list[Column]:
    return [
        status.isin("extracting", "processing", "synthesizing").alias("delete_blocked"),
        (status == "pending_confirmation").alias("can_confirm"),
        status.isin("uploaded", "paused").alias("can_prioritize"),
        status.isin("ready", "error").alias("prioritize_refused"),
        status.isin("uploaded", "extracting", "processing", "synthesizing").alias("waits_for_worker"),
        F.coalesce(F.create_map(*[F.lit(x) for k, v in D.STATUS_LABELS.items() for x in (k, v)])[status], status).alias("label"),
    ]


def navigation(chunks: DataFrame, position: Column) -> DataFrame:
    """chunks with previous and next sequence; beyond three seconds, previous restarts the same chunk; edges stay."""
    own = F.col("sequence")
    found = neighbours(chunks.withColumn("__position", position), "book", "sequence", own, own, ("previous", "next"))
    return found.withColumn("previous", F.when(F.col("__position") > 3, own).otherwise(F.coalesce("previous", own))).withColumn("next", F.coalesce("next", own)).drop("__position")


def numbered(chunks: DataFrame) -> DataFrame:
    """chunks (book, chapter, idx) with sequence: global and without gaps over a book's chapters.

    Chapters are counted and their counts summed; chunks are numbered in their chapter. Only numbers are shuffled for it, but where the
    chunks come from elsewhere than one row, their texts are for the join.
    """
    sizes = chunks.groupBy("book", "chapter").agg(F.count("*").alias("__n"))
    starts = with_sum_before(sizes, "book", "chapter", F.col("__n"), "__start").select(F.col("book").alias("__book"), F.col("chapter").alias("__chapter"), "__start")
    inside = with_sum_before(chunks, ["book", "chapter"], "idx", F.lit(1), "__place")
    found = inside.join(starts, F.col("book").eqNullSafe(F.col("__book")) & F.col("chapter").eqNullSafe(F.col("__chapter")))
    return found.withColumn("sequence", (F.col("__start") + F.col("__place")).cast("int")).drop("__book", "__chapter", "__start", "__place")


def known_content(new: DataFrame, known: DataFrame) -> DataFrame:
    """New documents to process: their content hash isn't known, and each is the first of its content."""
    hashed = new.withColumn("hash", F.sha2("text", 256))
    first = hashed.groupBy("hash").agg(F.min("doc").alias("doc"))
    return hashed.join(first, ["hash", "doc"], "left_semi").join(known.select(F.sha2("text", 256).alias("hash")).distinct(), "hash", "left_anti")
