r"""Spelling variants: the vocabulary's acceptor composed with a one-edit transducer and itself, in parts below shared initial states.

Two words that differ in one code point agree before and after it. So every pair of the composition runs through a state that is
reached by a beginning (and left over an ending) that both words have, and the composition falls apart by these: a part is
all words with the same beginning and ending, and the edit between them. A part that holds too many words is
split by halving the places where the edit may be; with one place left, a part can't have more words than the alphabet has pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.line_dedup import LOWER, UPPER, ascii_lower
from lectern.llm.store import table, written

LEAST_LENGTH, LEAST_COUNT, FACTOR = 7, 2, 10
#: Words of a part; beyond that it is split.
PART = 4000


def words_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, n) of whole texts: runs of letters in lower case (A-Z only), every so often without a code point; counts are combined before the shuffle."""
    runs = F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(rf"[A-Za-zÀ-ÿ]{{{least_length},}}"), F.lit(0))
    own = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    word = F.when(F.col("h") % 31 == 0, F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))).otherwise(F.col("run"))
    return own.withColumn("h", h).select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))


def _cut(rows: DataFrame) -> DataFrame:
    """rows (c, lo, hi, word, n) with key and mid: what a part's words have in common, and what lies between.

    Part (c, lo, hi) compares words of c code points with each other and with those of c + 1, the edit being at lo or
    behind and before hi. The first lo code points agree then, and the last c - hi.
    """
    tail = F.greatest(F.col("c") - F.col("hi"), F.lit(0))
    size = F.length("word")
    key = F.concat_ws("\x00", "c", "lo", "hi", F.substring(F.col("word"), F.lit(1), F.col("lo")), F.substring(F.col("word"), size - tail + 1, tail))
    return rows.withColumn("key", key).withColumn("mid", F.substring(F.col("word"), F.col("lo") + 1, size - tail - F.col("lo")))


def _halved(rows: DataFrame) -> DataFrame:
    """The rows for either half of the places where the edit may be."""
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi").alias("hi")))
    return rows.withColumn("half", F.explode(halves)).select("c", F.col("half.lo").alias("lo"), F.col("half.hi").alias("hi"), "word", "n")


class Acceptor:
    """The least deterministic acceptor of sorted distinct words; a state knows how many words it accepts, so a path gives a word's place in the sort."""

    def __init__(self, words: list[str]) -> None:
        self.final: list[bool] = []
        self.arcs: list[list[tuple[str, int, int]]] = []  # label, state, words accepted by way of smaller labels and by ending here
        self.size: list[int] = []
        known: dict[tuple, int] = {}
        path: list[tuple[str, list]] = []  # open states below the start: label that leads there, [final, arcs]
        start: list = [False, []]

        def state(open_state: list) -> int:
            key = (open_state[0], tuple(open_state[1]))
            if key not in known:
                known[key] = len(self.final)
                at, arcs = int(open_state[0]), []
                for label, to in open_state[1]:
                    arcs.append((label, to, at))
                    at += self.size[to]
                self.final.append(open_state[0])
                self.arcs.append(arcs)
                self.size.append(at)
            return known[key]

        def close(depth: int) -> None:
            while len(path) > depth:
                label, below = path.pop()
                (path[-1][1] if path else start)[1].append((label, state(below)))

        before = ""
        for word in words:
            same = next((k for k, (a, b) in enumerate(zip(before, word, strict=False)) if a != b), min(len(before), len(word)))
            close(same)
            path += [(label, [False, []]) for label in word[same:]]
            (path[-1][1] if path else start)[0] = True
            before = word
        close(0)
        self.start = state(start)

    def shared(self, x: int, y: int, at_x: int, at_y: int, but: str | None = None) -> Iterator[tuple[int, int]]:
        """Places of the words that both states accept; but: none that begins with it."""
        todo = [(x, y, at_x, at_y)]
        while todo:
            x, y, at_x, at_y = todo.pop()
            if self.final[x] and self.final[y]:
                yield at_x, at_y
            other = {label: (to, before) for label, to, before in self.arcs[y]}
            for label, to, before in self.arcs[x]:
                if label != but and label in other:
                    todo.append((to, other[label][0], at_x + before, at_y + other[label][1]))
            but = None

    def near(self) -> Iterator[tuple[int, int]]:
        """Places of the words of each accepted pair of acceptor, one edit, acceptor: once each, the edit at the first difference."""
        rest: dict[int, list[tuple[int, int]]] = {}  # of a state: pairs whose first difference is right behind it
        todo = [(self.start, 0)]
        while todo:
            p, at = todo.pop()
            if p not in rest:
                found = rest[p] = []
                for k, (a, x, before) in enumerate(self.arcs[p]):
                    found += self.shared(x, p, before, 0, a)  # a is deleted
                    for _, y, other in self.arcs[p][k + 1 :]:  # a is replaced
                        found += self.shared(x, y, before, other)
            for i, j in rest[p]:
                yield at + i, at + j
            todo += [(to, at + before) for _, to, before in self.arcs[p]]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, near, most, form) of sorted rows (key, mid, word, n): for each word of a part its near words there, and the commonest of them."""
    out: dict[str, list] = {"word": [], "near": [], "most": [], "form": []}

    def part(key: str, mids: list[str], words: list[str], counts: list[int]) -> None:
        if len(words) < 2:
            return
        c, _, hi = map(int, key.split("\x00", 3)[:3])
        if min(map(len, words)) > c:
            return
        best: list[tuple[int, str] | None] = [None] * len(words)
        found = [0] * len(words)
        for i, j in Acceptor(mids).near():
            if len(words[i]) > c and len(words[j]) > c:
                continue  # a pair of the part of longer words
            if hi <= c and len(words[i]) != len(words[j]) and mids[max(i, j)].startswith(mids[min(i, j)]):
                continue  # first differs at hi, so it is a pair of another part
            for a, b in ((i, j), (j, i)):
                found[a] += 1
                new = (-counts[b], words[b])
                if best[a] is None or new < best[a]:
                    best[a] = new
        for k, n in enumerate(found):
            if n:
                for name, v in zip(out, (words[k], n, -best[k][0], best[k][1]), strict=True):
                    out[name].append(v)

    def handed_on() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(out["word"], pa.string()), pa.array(out["near"], pa.int64()), pa.array(out["most"], pa.int64()), pa.array(out["form"], pa.string())], names=list(out))
        for v in out.values():
            v.clear()
        return batch

    own: tuple[str, list, list, list] = ("", [], [], [])
    for batch in batches:
        for key, mid, word, n in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if key != own[0]:
                part(*own)
                own = (key, [], [], [])
                if len(out["word"]) >= 10_000:
                    yield handed_on()
            for held, v in zip(own[1:], (mid, word, n), strict=True):
                held.append(v)
    part(*own)
    yield handed_on()


def near_words(vocabulary: DataFrame, part: int = PART) -> DataFrame:
    """(word, n_near, most, form) of distinct (word, n): how many words differ from it by one code point inserted, deleted or replaced, and the commonest of them (ties: the smallest).

    Each word goes to the parts of its own length and of one less, with the edit in the first half or the second; a pair is
    found in one part. Words without near words have no row.
    """
    c = F.explode(F.array(F.length("word"), F.length("word") - 1))
    whole = vocabulary.where("word <> ''").select(c.alias("c"), "word", "n").select("c", F.lit(0).alias("lo"), (F.col("c") + 1).alias("hi"), "word", "n")
    todo, ready = written(_cut(_halved(whole)), "parts"), []
    while True:
        large = todo.where("hi - lo > 1").groupBy("key").count().where(F.col("count") > part).select("key")
        large = written(large, "large-parts")
        if not large.count():
            ready.append(todo)
            break
        ready.append(todo.join(large, "key", "left_anti"))
        todo = written(_cut(_halved(todo.join(large, "key", "left_semi").select("c", "lo", "hi", "word", "n"))), "parts")
    rows = ready[0]
    for more in ready[1:]:
        rows = rows.unionByName(more)
    rows = rows.repartition("key").sortWithinPartitions("key", "mid").select("key", "mid", "word", "n")
    found = rows.mapInArrow(_pairs, "word string, near long, most long, form string")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("most")).alias("less"), "form")).alias("best")).select("word", "n_near", (-F.col("best.less")).alias("most"), "best.form")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): each round doubles the steps that a word has gone. Counts grow with every step, so there is no circle."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        after = written(now.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "roots")
        if not after.where("moved").limit(1).count():
            return after.select("word", "root")
        now = after.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, factor: int = FACTOR, part: int = PART) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the vocabulary of docs: words of least_length code points found least_count times.

    A null text has no words; a null id counts as the empty string where runs lose a code point. Repeated rows are counted each; of near words
    of the same count the smallest in code-point order is the form; texts and words of any length are read whole; an empty table
    gives no rows; other columns are ignored, whatever their names.
    """
    vocabulary = written(words_of(docs, id_col, text_col, least_length).where(F.col("n") >= least_count), "vocabulary")
    near = near_words(vocabulary, part)
    has = F.coalesce(F.col("most") >= factor * F.col("n"), F.lit(False))
    rows = written(vocabulary.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("form")).alias("form"), F.when(has, F.col("most")).alias("form_n")), "near-words")
    roots = _roots(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda b: list_reduce([b::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-z\x{{C0}}-\x{{FF}}]{{7,}}')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs GROUP BY doc_id, run),
bytes AS (SELECT run, n, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::BIGINT, 2))::BIGINT) AS b FROM counted),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, b), lambda a, v: xor(a >> 8, t[xor(a & 255, v) + 1])), 4294967295) AS h FROM bytes, tab),
cut AS (SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
v AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
gone AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n FROM gone a JOIN gone b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT g.word, v.word, v.n FROM gone g JOIN v ON g.rest = v.word
  UNION SELECT v.word, g.word, g.n FROM gone g JOIN v ON g.rest = v.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS most FROM near GROUP BY word),
own AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * v.n THEN most END AS form_n FROM v LEFT JOIN best USING (word)),
formed AS (SELECT own.*, (SELECT min(other) FROM near WHERE near.word = own.word AND near.n = own.form_n) AS form FROM own),
up AS (SELECT word, word AS root, form AS next FROM formed UNION ALL SELECT up.word, up.next, f.form FROM up JOIN formed f ON f.word = up.next)
SELECT formed.word, form, up.root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM formed JOIN up ON up.word = formed.word AND up.next IS NULL
"""
