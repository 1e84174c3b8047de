"""Cleaning, sentences, packing and pauses of texts. Long-lived keys: unit (a book or chapter), page, doc."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import dictionaries as D
from lectern.functions.notation import BLANK, cut, folded_flags, let, strip
from lectern.llm.store import broadcast_if_small, written
from lectern.operators.order import WIDTH, neighbours, with_sum_before

NO_JOIN_AFTER = r"""[.!?:;"”»)]$"""


def lines_of(pages: DataFrame) -> DataFrame:
    """(unit, page, line_no, line) of (unit, page, text)."""
    return pages.select("unit", "page", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def repeated_lines(lines: DataFrame) -> DataFrame:
    """(unit, bare, n_pages) of stripped lines found on two pages of a unit or more; pages are counted after a map-side combine."""
    bare = lines.select("unit", "page", strip(F.col("line")).alias("bare")).where("bare <> ''")
    return bare.groupBy("unit", "bare").agg(F.countDistinct("page").alias("n_pages")).where("n_pages >= 2")


def drop_repeated(lines: DataFrame) -> DataFrame:
    """Lines whose stripped form does not repeat in the unit."""
    gone = repeated_lines(lines).select(F.col("unit").alias("gone_unit"), "bare")
    return lines.join(gone, F.col("unit").eqNullSafe(F.col("gone_unit")) & (strip(F.col("line")) == F.col("bare")), "left_anti")


def _dropped(pages: DataFrame) -> DataFrame:
    """(u, p, gone) of (unit, page, marks): the numbers of a page's lines whose mark is on another page of the unit too; blank lines have none."""
    lines = pages.select("unit", "page", F.posexplode("marks").alias("no", "mark")).where("mark IS NOT NULL")
    twice = lines.groupBy("unit", "mark").agg(F.min("page").alias("low"), F.max("page").alias("high")).where("low <> high").select(F.col("unit").alias("u"), F.col("mark").alias("again"))
    twice = broadcast_if_small(written(twice, "repeated-lines"), 500_000)
    found = lines.join(twice, F.col("unit").eqNullSafe(F.col("u")) & (F.col("mark") == F.col("again")), "left_semi")
    return found.groupBy(F.col("unit").alias("u"), F.col("page").alias("p")).agg(F.collect_list("no").alias("gone"))


def clean_lines(pages: DataFrame, width: int = WIDTH) -> DataFrame:
    """(unit, line, piece) of (unit, page, text): the pieces of a unit, in order of line, put together are its cleaned text.

    For units of any length: what a line needs from others is what the kept line ahead ends with and what the one behind begins with. Within
    a page these are at hand; between pages a row for each page is carried over ranges of width pages, so texts are shuffled only to meet
    what their page loses and what is next to it. No unit is gathered in one row or window; a joined line of any length stays several
    pieces. page is a whole number, once in a unit; a null text is a blank line.
    """
    here = F.col("unit").eqNullSafe(F.col("u")) & (F.col("page") == F.col("p"))

    def about(line: Column, i: Column) -> Column:
        said = lambda bare: F.struct(i.alias("no"), bare.alias("bare"), hyphen.alias("hyphen"), ((bare == "") | bare.rlike(NO_JOIN_AFTER)).alias("closed"), bare.rlike(r"^\p{javaLowerCase}").alias("lower"))
        hyphen = F.regexp_replace(line, r"(?U)[\s\x1c-\x1f]+\z", "").endswith("-")
        return let(strip(line), said)

    lines = pages.select("unit", "page", F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), about).alias("own"))
    marks = F.transform("own", lambda x: F.when(x.bare != "", F.substring(F.unhex(F.sha2(x.bare, 256)), 1, 16)))  # 128 bits
    lines = written(lines.select("*", marks.alias("marks")), "lines")
    stays = lambda x: ~F.coalesce(F.array_contains("gone", x.no), F.lit(False))
    own = written(lines.drop("marks").join(_dropped(lines), here, "left").select("unit", "page", F.size("own").alias("n"), F.filter("own", stays).alias("kept")), "kept-lines")
    full, first, last = F.filter("kept", lambda x: x.bare != ""), F.get("kept", F.lit(0)), F.try_element_at("kept", F.lit(-1))
    ends = own.select("unit", "page", "n", F.size("kept").alias("m"), F.get(full, F.lit(0)).no.alias("low"), F.try_element_at(full, F.lit(-1)).no.alias("high"), first.lower.alias("lower"), last.hyphen.alias("hyphen"), last.closed.alias("closed"))
    ends = written(with_sum_before(ends, "unit", "page", F.col("n"), "start", width), "page-ends")
    near = neighbours(ends.where("m > 0"), "unit", "page", F.struct("hyphen", "closed"), F.struct("lower"), ("ahead", "behind"), width)
    bounds = ends.groupBy("unit").agg(F.min(F.col("start") + F.col("low")).alias("first"), F.max(F.col("start") + F.col("high")).alias("last")).withColumnRenamed("unit", "v")
    near = near.join(bounds, F.col("unit").eqNullSafe(F.col("v"))).select(F.col("unit").alias("u"), F.col("page").alias("p"), "start", "ahead", "behind", "first", "last")

    def beside(x: Column, i: Column) -> Column:
        before, after = F.get("kept", i - 1), F.get("kept", i + 1)
        ahead = F.when(i == 0, F.col("ahead")).otherwise(F.struct(before.hyphen.alias("hyphen"), before.closed.alias("closed")))
        return F.struct(x.no.alias("no"), x.bare.alias("bare"), x.hyphen.alias("hyphen"), x.lower.alias("lower"), ahead.alias("ahead"), F.when(i == F.size("kept") - 1, F.col("behind.lower")).otherwise(after.lower).alias("below"))

    rows = own.join(near, here).select("unit", "start", "first", "last", F.explode(F.transform("kept", beside)).alias("x")).select("unit", (F.col("start") + F.col("x.no")).alias("at"), "first", "last", "x.*").where("at BETWEEN first AND last")
    joined = F.coalesce(F.col("ahead.hyphen"), F.lit(False)) & F.col("lower")
    joins = F.col("hyphen") & F.coalesce("below", F.lit(False))
    gap = F.when(joined | (F.col("at") == F.col("first")), "").when((F.col("bare") == "") | F.col("ahead.closed"), "\n").otherwise(" ")
    return rows.select("unit", F.col("at").alias("line"), F.concat(gap, F.when(joins, F.regexp_replace("bare", "-$", "")).otherwise(F.col("bare"))).alias("piece"))


def dehyphenated(lines: Column) -> Column:
    """array<string>: a line that ends in a hyphen takes in the next if that starts in lower case; chains."""
    tail, head = r"(?U)[\s\x1c-\x1f]+\z", r"(?U)^[\s\x1c-\x1f]+"

    def put(a: Column) -> Column:
        hyphen = lambda i: F.coalesce(F.regexp_replace(F.get(a, i), tail, "").endswith("-"), F.lit(False))
        joins = lambda i: (i >= 0) & hyphen(i) & F.coalesce(strip(F.get(a, i + 1)).rlike(r"^\p{javaLowerCase}"), F.lit(False))

        def part(line: Column, i: Column) -> Column:
            line = F.when(joins(i - 1), F.regexp_replace(line, head, "")).otherwise(line)
            return F.when(joins(i), F.regexp_replace(F.regexp_replace(line, tail, ""), "-$", "")).otherwise(F.concat(line, F.lit("\n")))

        return F.split(F.regexp_replace(F.array_join(F.transform(a, part), ""), r"\n\z", ""), "\n", -1)

    return let(lines, put)


def unwrapped(lines: Column) -> Column:
    """The lines as one text: a line joins the one before unless either is blank or that one ends a sentence or quotation."""

    def put(bare: Column) -> Column:
        before = lambda i: F.get(bare, i - 1)
        starts = lambda line, i: (line == "") | (before(i) == "") | before(i).rlike(NO_JOIN_AFTER)
        joined = F.transform(bare, lambda line, i: F.when(i == 0, line).otherwise(F.concat(F.when(starts(line, i), "\n").otherwise(" "), line)))
        return F.regexp_replace(F.array_join(joined, ""), r"^\n+|\n+\z", "")

    return let(F.transform(lines, strip), put)


def clean_text(pages: Column) -> Column:
    """One text of array<string> pages: without lines that repeat on two pages or more, hyphenated and wrapped lines joined across pages.

    Blank pages, an empty array and null pages give an empty text; null gives null.
    """
    lines = lambda page: F.split(F.coalesce(page, F.lit("")), "\n", -1)
    bare = F.array_sort(F.flatten(F.transform(pages, lambda page: F.array_distinct(F.transform(lines(page), strip)))))
    again = let(bare, lambda a: F.array_distinct(F.filter(a, lambda x, i: (x != "") & (i > 0) & (x == F.get(a, i - 1)))))
    kept = let(again, lambda gone: F.filter(F.flatten(F.transform(pages, lines)), lambda line: ~F.array_contains(gone, strip(line))))
    return F.when(pages.isNotNull(), F.coalesce(unwrapped(dehyphenated(kept)), F.lit("")))


def clean_pages(pages: DataFrame) -> DataFrame:
    """(unit, text) of (unit, page, text): the cleaned text of each unit, its pages in order. A unit is a chapter or a book, whose text is one row."""
    whole = F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p.text)
    return pages.groupBy("unit").agg(whole.alias("pages")).select("unit", clean_text(F.col("pages")).alias("text"))


#: White space after . ! or ? that ends a sentence: not after an abbreviation's dot or an initial's.
BOUNDARY = rf"(?iuU)(?<=[.!?])(?<!(?<![{D.WORD_CHARACTERS}])(?:[{D.WORD_CHARACTERS}]|{'|'.join(D.NO_SENTENCE_END)})\.)\s+"
#: The same where white space is one space, which is looked for first.
BOUNDARY_SPACE = rf"(?iuU) (?<=[.!?] )(?<!(?<![{D.WORD_CHARACTERS}])(?:[{D.WORD_CHARACTERS}]|{'|'.join(D.NO_SENTENCE_END)})\. )"


def false_boundary(before: Column) -> Column:
    """Whether a text that ends in a dot ends no sentence: the dot is that of an abbreviation or of an initial. False for other ends and for null."""
    word = rf"(?iuU)(?<![{D.WORD_CHARACTERS}])(?:[{D.WORD_CHARACTERS}]|{'|'.join(D.NO_SENTENCE_END)})\.\z"
    return F.coalesce(before.rlike(word), F.lit(False))


#: Marks set by sentence_marks: white space becomes a space each run, so neither can be in the text itself.
SENTENCE, PARAGRAPH = "\x1e", "\x1d"


def paragraph_marks(text: Column) -> Column:
    """The text with PARAGRAPH between its paragraphs (cut at blank lines; blank ones are skipped) and white space inside collapsed."""
    apart = F.replace(F.replace(text, F.lit(SENTENCE), F.lit("\x1c")), F.lit(PARAGRAPH), F.lit("\x1c"))  # blanks, but none that make a line blank
    apart = F.regexp_replace(F.regexp_replace(apart, r"(?U)\n\s*\n", PARAGRAPH), r"(?U)[\s\x1c\x1f]+", " ")
    return F.btrim(F.regexp_replace(apart, f" *{PARAGRAPH}[ {PARAGRAPH}]*", PARAGRAPH), F.lit(f" {PARAGRAPH}"))


def sentence_marks(text: Column) -> Column:
    """paragraph_marks with SENTENCE in place of the space between two sentences: sentences and chunks are cut there in scans of the whole text."""
    return F.regexp_replace(paragraph_marks(text), BOUNDARY_SPACE, SENTENCE)


def paragraph_texts(text: Column) -> Column:
    """array<string>: text between blank lines, with white space inside collapsed; blank ones are skipped."""
    return F.filter(F.split(paragraph_marks(text), PARAGRAPH, -1), lambda p: p != "")


def sentence_texts(text: Column) -> Column:
    """array<array<string>>: the sentences of each paragraph."""
    own = F.filter(F.split(sentence_marks(text), PARAGRAPH, -1), lambda p: p != "")
    return F.transform(own, lambda p: F.split(p, SENTENCE, -1))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc, paragraph, text) of (doc, text); null and blank texts have none."""
    return docs.select("doc", F.posexplode(paragraph_texts(F.col("text"))).alias("paragraph", "text"))


def sentences(docs: DataFrame) -> DataFrame:
    """(doc, other columns, paragraph, sentence, text): cut within each row, so nothing is shuffled."""
    others = [c for c in docs.columns if c not in ("text", "paragraph", "sentence")]
    split = docs.select(*others, F.posexplode(sentence_texts(F.col("text"))).alias("paragraph", "__own"))
    return split.select(*others, "paragraph", F.posexplode("__own").alias("sentence", "text"))


def packed(items: Column, limit: int) -> Column:
    """Greedy packing of array<struct<text, gap>>: an item joins the current chunk while length + gap + item fits; gap is its separator.

    The fold runs over lengths and tells, for each item, whether it opens a chunk; the texts are joined once, afterwards.
    """

    def step(size: Column, x: Column) -> tuple[Column, Column]:
        more = size + F.length(x.gap) + F.length(x.text)
        fits = (size >= 0) & (more <= limit)
        return F.when(fits, more).otherwise(F.length(x.text)), ~fits

    def put(all_items: Column) -> Column:
        opens = folded_flags(all_items, F.lit(-1), step)
        said = F.transform(F.arrays_zip(all_items.alias("item"), opens.alias("opens")), lambda z: F.when(z.opens, z.item.text).otherwise(F.concat(z.item.gap, z.item.text)))
        starts = F.filter(F.sequence(F.lit(1), F.size(all_items)), lambda i: F.get(opens, i - 1))

        def joined(texts: Column, firsts: Column) -> Column:
            end = lambda k: F.coalesce(F.get(firsts, k + 1), F.size(texts) + 1)
            return F.transform(firsts, lambda first, k: F.array_join(F.slice(texts, first, end(k) - first), ""))

        chunks = F.filter(let(said, lambda texts: let(starts, lambda firsts: joined(texts, firsts))), lambda c: c != "")
        return F.when(F.size(all_items) > 0, chunks).when(all_items.isNotNull(), F.array().cast("array<string>"))

    return let(items, put)


def packed_text(marked: Column, limit: int, mark: str) -> Column:
    """array<string>: the greedy packing of items that are set apart by the mark, which stands for a space, or by an empty line; no item is empty.

    A chunk is the longest run of at most limit characters that ends where an item does, or an item that is longer: one scan of a pattern.
    """
    lines = "\\n" if mark == SENTENCE else ""
    ends = rf"{mark}|\n\n|\z" if lines else rf"{mark}|\z"
    own = F.regexp_extract_all(marked, F.lit(rf"(?s)[^{mark}{lines}].{{0,{max(limit, 1) - 1}}}(?={ends})|[^{mark}{lines}]+"), F.lit(0))
    return own if mark == " " else F.transform(own, lambda c: F.replace(c, F.lit(mark), F.lit(" ")))


def packed_sentences(marked: Column, limit: int) -> Column:
    """chunk_texts of a text that has sentence_marks."""
    return packed_text(F.replace(marked, F.lit(PARAGRAPH), F.lit("\n\n")), limit, SENTENCE)


def chunk_texts(text: Column, limit: int = 1000) -> Column:
    """array<string>: sentences packed into chunks of at most limit characters; a longer sentence is a chunk of its own.

    Sentences of one paragraph are joined by a space, paragraphs by an empty line.
    """
    return packed_sentences(sentence_marks(text), limit)


def chunks(docs: DataFrame, limit: int = 1000) -> DataFrame:
    """(doc, sequence, text) of (doc, text): the chunks of each row, cut within the row."""
    return docs.select("doc", F.posexplode(chunk_texts(F.col("text"), limit)).alias("sequence", "text"))


def split_words(text: Column, limit: int) -> Column:
    """array<string>: the text if it fits or has one word, else its words packed to at most limit characters."""
    words = F.btrim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "), F.lit(" "))
    return let(words, lambda w: F.when((F.length(text) <= limit) | ~F.contains(w, F.lit(" ")), F.array(text)).otherwise(packed_text(w, limit, " ")))


def split_clauses(text: Column, limit: int) -> Column:
    """array<string>: clauses (after , ; :) packed to at most limit characters where the text is longer."""
    pattern, nul = r"(?U)(?<=[,;:])\s+", "\x00"
    items = F.transform(F.split(text, pattern, -1), lambda w: F.struct(w.alias("text"), F.lit(" ").alias("gap")))
    return F.when(F.length(text) <= limit, F.array(text)).when(F.contains(text, F.lit(nul)), packed(items, limit)).otherwise(packed_text(F.regexp_replace(text, pattern, nul), limit, nul))


def pause_segments(text: Column) -> Column:
    """array<struct<text, pause_ms>>: sentences with the pause after each; 800 at a paragraph's end, 0 at the text's."""
    marks = lambda s: F.when(F.substring(s, -1, 1) == "!", 520).when(F.substring(s, -1, 1) == "?", 470).otherwise(420)

    def put(all_own: Column) -> Column:
        own = lambda p, i: F.transform(p, lambda s, j: F.struct(s.alias("text"), F.when(j < F.size(p) - 1, marks(s)).when(i < F.size(all_own) - 1, 800).otherwise(0).alias("pause_ms")))
        return F.flatten(F.transform(all_own, own))

    return let(sentence_texts(text), put)


def pauses(docs: DataFrame) -> DataFrame:
    """(doc, segment, text, pause_ms) of (doc, text)."""
    return docs.select("doc", F.posexplode(pause_segments(F.col("text"))).alias("segment", "own")).select("doc", "segment", "own.text", "own.pause_ms")


def _middle(text: str) -> int | None:
    """Where to cut: after the punctuation nearest the middle, else at the nearest blank; the left one of two as near."""
    middle = len(text) // 2
    for marks, after in ((",;:", 1), (" \t", 0)):
        left = max(text.rfind(m, 1, middle + 1) for m in marks)
        right = min((p for m in marks if (p := text.find(m, max(middle, 1))) >= 0), default=None)
        at = right if left < 0 or right is not None and right - middle < middle - left else left
        if at is not None and at + after < len(text):
            return at + after
    return None


def _budget(text: str, limit: int, measure: Callable[[str], int]) -> list[str]:
    """Pieces within the limit: clauses packed in order; a piece of one clause is cut at the middle, again and again; a word stays whole."""
    todo, out = [text.strip()], []
    while todo:
        t = todo.pop()
        if measure(t) <= limit or not re.search(r"\s", t):
            out.append(t)
            continue
        clauses = [c.strip() for c in re.split(r"(?<=[,;:])\s+", t) if c.strip()]
        if len(clauses) > 1:
            parts = clauses[:1]
            for c in clauses[1:]:
                if measure(f"{parts[-1]} {c}") <= limit:
                    parts[-1] += f" {c}"
                else:
                    parts.append(c)
        else:
            cut = _middle(t)
            parts = [t] if cut is None else [t[:cut].strip(), t[cut:].strip()]
        if len(parts) == 1:
            out += parts
        else:
            todo += reversed([p for p in parts if p])
    return out


def _nearest(text: Column, marks: str) -> Column:
    """Where, from 0, the mark nearest the middle is, the left one of two as near; null without one. The first character doesn't count."""
    middle = F.floor(F.length(text) / 2).cast("int")
    tail = F.substring(text, middle + 2, F.length(text))
    left = F.nullif(F.length(F.regexp_extract(F.substring(text, F.lit(1), middle + 1), f"(?s)^(.+)[{marks}]", 1)), F.lit(0))
    ahead = F.length(F.regexp_extract(tail, f"^[^{marks}]*", 0)) + 1
    right = F.when(ahead <= F.length(tail), middle + ahead)
    return F.when(right.isNull() | (middle - left <= right - middle), left).otherwise(right)


def _cut_once(text: Column, limit: int) -> Column:
    """array<string>: clauses packed in order where there are some; else the two sides of the punctuation nearest the middle, or of the blank nearest it."""
    clauses = F.filter(F.transform(cut(text, rf"(?U)(?<=[,;:]){BLANK}+"), strip), lambda c: c != "")
    items = lambda own: F.transform(own, lambda c: F.struct(c.alias("text"), F.lit(" ").alias("gap")))
    behind = lambda marks, more: let(_nearest(text, marks), lambda at: F.when(at + more < F.length(text), at + more))
    halves = lambda at: F.filter(F.array(strip(F.substring(text, F.lit(1), at)), strip(F.substring(text, at + 1, F.length(text)))), lambda c: c != "")
    halved = let(F.coalesce(behind(",;:", 1), behind(r" \t", 0)), lambda at: F.when(at.isNull(), F.array(text)).otherwise(halves(at)))
    return let(clauses, lambda own: F.when(F.size(own) > 1, packed(items(own), limit)).otherwise(halved))


def budget_pieces(text: Column, limit: int) -> Column:
    """array<string>: pieces of at most limit characters, or of a word that is longer; null for null.

    A round cuts every piece that is too long once. The pieces of a text are a tree of cuts: a level of it is a round, and there are
    no more rounds than words and marks; the ones after the last change cost nothing.
    """
    fits = lambda t: (F.length(t) <= limit) | ~t.rlike(rf"(?U){BLANK}")

    def step(acc: Column, _: Column) -> Column:
        new = F.flatten(F.transform(acc.pieces, lambda t: F.when(fits(t), F.array(t)).otherwise(_cut_once(t, limit))))
        return F.when(acc.done, acc).otherwise(let(new, lambda n: F.struct((n == acc.pieces).alias("done"), n.alias("pieces"))))

    def cut_all(t: Column) -> Column:
        start = F.struct(F.lit(False).alias("done"), F.array(t).alias("pieces"))
        return F.aggregate(F.sequence(F.lit(1), F.size(cut(t, rf"(?U){BLANK}+")) + F.length(t) - F.length(F.translate(t, ",;:", "")) + 1), start, step, lambda acc: acc.pieces)

    return let(strip(text), lambda t: F.when(fits(t), F.array(t)).when(t.isNotNull(), cut_all(t)))


EXEMPT = ("a", "b")


def split_budget(rows: DataFrame, limit: int, text_col: str = "text", measure: Callable[[str], int] | None = None, code: Column | None = None) -> DataFrame:
    """rows with piece_no and piece: clauses packed while the measure of a piece is at most limit; one that is larger is halved until it fits.

    The measure is a text's length or any function of a text. An Arrow UDF cuts single texts; of those measured by length it gets only the
    ones over the limit (budget_pieces gives the same in expressions, at some four times the time). Rows whose language code is exempt (a, b)
    and texts that fit stay whole. A null text has no piece; repeated rows are cut each.
    """

    def halve(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda t: None if t is None else _budget(t, limit, measure or len))

    text, exempt = F.col(text_col), F.lit(False) if code is None else F.coalesce(code.isin(*EXEMPT), F.lit(False))
    long = F.lit(True) if measure else F.length(text) > limit
    cut = F.pandas_udf(halve, "array<string>")(F.when(long & ~exempt, text))
    pieces = F.when(exempt, F.array(text)).when(long, cut).when(text.isNotNull(), F.array(strip(text)))
    return rows.withColumn("__pieces", pieces).select(*rows.columns, F.posexplode("__pieces").alias("piece_no", "piece"))


def paginated(docs: DataFrame, lines: int = 40) -> DataFrame:
    """(doc, page_number, text): each document's lines in pages of so many, from page 1."""
    rows = docs.select("doc", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).withColumn("page_number", F.floor(F.col("line_no") / lines).cast("int") + 1)
    pieces = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return rows.groupBy("doc", "page_number").agg(F.array_join(F.transform(pieces, lambda s: s.line), "\n").alias("text"))
