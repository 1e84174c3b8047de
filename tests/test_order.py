"""What is carried over ranges of rows is what one pass over each key gives."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import notation as N
from lectern.operators import order
from lectern.operators import rules as R
from lectern.operators import state as S
from lectern.operators import text as T


def keyed(spark, seed, n=300):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", None]), o, rng.choice([None, None, None, 1, 2, 3])) for o in rng.sample(range(2000), n)]
    return rows, spark.createDataFrame(rows, "k string, o int, v int").repartition(3)


@pytest.mark.parametrize("width", [1, 7, 4096])
def test_sums_last_values_and_neighbours(spark, width):
    rows, d = keyed(spark, width)
    found = order.neighbours(order.carried(order.with_sum_before(d, "k", "o", F.coalesce("v", F.lit(1)), "s", width), "k", "o", F.col("v"), "c", width), ["k"], "o", F.struct("v"), F.struct("o"), width=width)
    got = {(r.k, r.o): (r.s, r.c, r.before and r.before.v, r.after and r.after.o, r.before is None) for r in found.collect()}
    want = {}
    for key in {r[0] for r in rows}:
        own, total, last = sorted(r for r in rows if r[0] == key), 0, None
        own.sort(key=lambda r: r[1])
        for i, (k, o, v) in enumerate(own):
            last = last if v is None else v
            want[k, o] = (total, last, own[i - 1][2] if i else None, own[i + 1][1] if i + 1 < len(own) else None, i == 0)
            total += v or 1
    assert got == want
    assert order.carried(d.limit(0), "k", "o", F.col("v"), "c").count() == 0


def test_carried_languages(spark):
    d = spark.createDataFrame([("u", 2, None), ("u", 1, None), ("u", 5000, None), ("u", 3, "e"), (None, 1, "p"), (None, 9000, None)], "unit string, n int, code string")
    got = {(r.unit, r.n): r.carried for r in R.carried_forward(d, "unit", "n", "code").collect()}
    assert got == {("u", 1): "a", ("u", 2): "a", ("u", 3): "e", ("u", 5000): "e", (None, 1): "p", (None, 9000): "p"}


@pytest.mark.parametrize("width", [2, 5, 4096])
def test_clean_lines_are_the_clean_text(spark, width):
    rng = random.Random(width)
    lines = ["HEAD", "end-", " wrapped", "tração e", "Fim.", "", "  ", "-", "a -", "x", '"quoted"', "\tdemons-  ", "Again:", "b"]
    pages = [(u, p, None if rng.random() < 0.03 else "\n".join(rng.choice(lines) + rng.choice(["", "", str(rng.randint(0, 500))]) for _ in range(rng.randint(1, 6)))) for u in (1, 2, 3, None) for p in range(0, 60, 1 + (u or 1))]
    d = spark.createDataFrame([*pages, (9, 1, " \n\n"), (8, 1, "only-")], "unit int, page int, text string").repartition(3)
    whole = {r.unit: r.text for r in T.clean_pages(d).collect()}
    parts = {}
    for r in sorted(T.clean_lines(d, width).collect(), key=lambda r: r.line):
        parts.setdefault(r.unit, []).append(r.piece)
    assert {u: "".join(p) for u, p in parts.items()} == {u: t for u, t in whole.items() if t}


def test_numbering_and_navigation(spark):
    rows = [(b, c, i) for b in (1, None) for c in (0, 2, 7) for i in range(3, 3 + 2 * c + 1, 2)]
    got = {(r.book, r.chapter, r.idx): r.sequence for r in S.numbered(spark.createDataFrame(rows, "book int, chapter int, idx int")).collect()}
    assert got == {r: k for b in (1, None) for k, r in enumerate(sorted(r for r in rows if r[0] == b))}
    chunks = spark.createDataFrame([("b", 0, 5), ("b", 4, 1), ("b", 9000, 4)], "book string, sequence int, position int")
    found = {r.sequence: (r.previous, r.next) for r in S.navigation(chunks, F.col("position")).collect()}
    assert found == {0: (0, 4), 4: (0, 9000), 9000: (9000, 9000)}


def test_small_inputs_are_spread(spark):
    assert order.spread(spark.range(10).repartition(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert order.spread(spark.range(10).repartition(50)).rdd.getNumPartitions() == 50


def test_one_scan_is_the_steps_in_order(spark):
    """Random texts of tokens, set apart and run together: one scan gives what the steps give one after another."""
    rng = random.Random(5)
    bits = ["R$", "US$", "$", "€", " ", "\n", "1", "5", "12", "30", "2020", "h", "/", "-", "–", "%", "§", "&", "→", "pág.", "PP.", "séc.", "art", "ed.", "d.", "a", "ano", "Itens", "item", "é", "_", ".", ",", "15h30", "1/2/2020", "10-12", "ſr.", "٣", "no", "\x00", "12/05/2020", "*x*", "`", "#", "|"]
    calm = ["por", "R$ 10", "US$ 1.234,56", "5%", "págs. 10-12", "página 3-4", "15h30", "15h", "1/2/2020", "10–12", "12/13/2020", "cap. 4", "& cia", "§", "a", "3"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 12))) if k % 2 else " ".join(rng.choices(calm, k=rng.randint(1, 8))) for k in range(3000)]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    tangled = F.col("t").rlike(N.TOKEN) & F.col("t").rlike(N.TANGLED)
    rows = d.select("t", N.in_order(F.col("t")).alias("steps"), N.sanitize(F.col("t")).alias("scan"), tangled.alias("tangled")).collect()
    assert [r.t for r in rows if r.steps != r.scan] == []
    assert 500 < sum(not r.tangled and r.t != r.scan for r in rows)


def test_pages_meet_the_chapters_of_their_cell(spark):
    from lectern.operators import structure as L

    rng = random.Random(9)
    chapters = [(d, k, f"c{k}", s := rng.randint(-3, 400), s + rng.choice([-1, 0, 1, 63, 64, 300])) for d in ("a", "b") for k in range(25)]
    pages = [(d, p) for d in ("a", "b", None) for p in range(0, 500)]
    found = spark.createDataFrame(chapters, "doc string, chapter int, title string, start_page int, end_page int")
    got = [(r.doc, r.page_number, r.chapter) for r in L.pages_of_chapters(spark.createDataFrame(pages, "doc string, page_number int"), found).collect()]
    assert sorted(got) == sorted((d, p, c) for d, p in pages for x, c, _, s, e in chapters if d == x and s <= p <= e)


def test_a_page_meets_few_chapters(spark):
    """A book of 20,000 pages and 5,000 chapters: the join looks at a cell's chapters only."""
    from lectern.operators import structure as L

    pages = spark.range(1, 20_001).selectExpr("'x' AS doc", "cast(id AS int) AS page_number")
    found = spark.range(5000).selectExpr("'x' AS doc", "cast(id AS int) AS chapter", "'t' AS title", "cast(id * 4 + 1 AS int) AS start_page", "cast(id * 4 + 4 AS int) AS end_page")
    rows = L.pages_of_chapters(pages, found)
    assert rows.count() == 20_000 and rows.where("(page_number - 1) div 4 <> chapter").count() == 0


def test_signs_are_not_tangled_with_themselves(spark):
    """The $ of R$ and US$ stands behind no other token's letter; that of a word does."""
    texts = ["por R$ 5 e US$ 7, $ 3", "xR$ 5", "US$5-$ 3", "S$ 5", "BUS$ 5"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.col("t").rlike(N.TANGLED).alias("x"), N.in_order(F.col("t")).alias("steps"), N.sanitize(F.col("t")).alias("scan")).collect()
    assert {r.t: r.x for r in rows} == dict(zip(texts, [False, True, True, True, True], strict=True))
    assert all(r.steps == r.scan for r in rows)


def test_clean_lines_windows_pages_not_lines(spark, monkeypatch):
    """what is carried along a unit is a row for each page, however many lines a page has; pages that lose all their lines are passed over."""
    seen, whole = [], T.neighbours
    monkeypatch.setattr(T, "neighbours", lambda rows, *more: (seen.append(rows.count()), whole(rows, *more))[1])
    pages = [("u", 0, "A li-\nne\nHead"), ("u", 1, "Head"), ("u", 2, " Head \nends on-"), ("u", 3, "Head\n\tly here.\n" + "\n".join(f"x{k}" for k in range(500))), (None, 7, None)]
    got = T.clean_lines(spark.createDataFrame(pages, "unit string, page int, text string").repartition(2), 2).orderBy("line").collect()
    assert seen == [4]  # page 1 has none, that of the null unit a blank line
    assert {r.unit for r in got} == {"u"}
    assert "".join(r.piece for r in got) == "A line ends only here.\n" + " ".join(f"x{k}" for k in range(500))
