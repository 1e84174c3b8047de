"""Large dictionaries, joined by tokens, put in what one pattern puts in."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import terms as M


@pytest.mark.parametrize("broadcast", [0, 10_000])
@pytest.mark.parametrize("marks", [False, True])
def test_joined_terms(spark, broadcast, marks):
    rng = random.Random(marks)
    words = ["gpu", "card", "Ünit", "a", "b", "is", "x1", "ções", "_"] + (["-", ".", "#"] if marks else [])
    dictionary = {}
    for k in range(60):
        term = rng.choice([" ", "", "-"]).join(rng.choices(words, k=rng.randint(1, 4))).strip()
        dictionary.setdefault(term.lower(), (term, f"<{k}$1\\>"))
    terms = spark.createDataFrame([v for k, v in dictionary.items() if k], "term string, spoken string")
    texts = ["".join(rng.choice(words).upper() if rng.random() < 0.3 else rng.choice([*words, " ", " ", "\n", "."]) for _ in range(rng.randint(0, 30))) for _ in range(300)] + [None, "", "gpu " * 3000]
    rows = spark.createDataFrame([*enumerate(texts), (999, texts[0])], "i int, text string").withColumn("term", F.lit(1)).repartition(3)
    want = {r.i: r.text for r in M.substituted(rows, terms).collect()}  # one pattern
    got = M.substituted(rows, terms, pattern_terms=0, broadcast_terms=broadcast)
    assert got.columns == rows.columns and {r.i: r.text for r in got.collect()} == want
    assert M.substituted(rows.limit(0), terms, pattern_terms=0).count() == 0
    assert {r.text for r in M.substituted(rows.where("i < 9"), terms.limit(0), pattern_terms=-1).collect()} == set(texts[:9])


def test_a_hundred_thousand_terms(spark):
    terms = spark.range(100_000).selectExpr("concat('word', id) AS term", "concat('w', id) AS spoken")
    rows = spark.createDataFrame([(k, f"Word{k} word{k} pre-word{99_999 - k} sword1") for k in range(0, 100_000, 9973)], "i int, text string")
    got = {r.i: r.text for r in M.substituted(rows, terms).collect()}
    assert got == {k: f"w{k} w{k} pre-w{99_999 - k} sword1" for k in range(0, 100_000, 9973)}


@pytest.mark.parametrize("broadcast", [0, 10_000])
def test_blocks_of_texts(spark, broadcast):
    """a frequent word is a row for each block in the join; other alphabets, other columns, null texts and repeated rows come through."""
    texts = ["the cat, THE Cat", "ÉTÉ été Ⓐbc ²the x²", "ΑΣ ας ΣΑ İs", "𝐀the the𝐀 𐐀b the", None, "", "the the", "the the"]
    rows = spark.createDataFrame([(k % 7, t, [k]) for k, t in enumerate(texts * 50)], "i int, text string, more array<int>").repartition(3)
    terms = spark.createDataFrame([("the", "<t>"), ("été", "<e>"), ("ας", "<a>"), ("ⓐbc", "<c>"), ("İS", "<i>"), ("𐐨b", "<d>"), ("x", "<x>")], "term string, spoken string")
    want = sorted(map(repr, M.substituted(rows, terms).collect()))
    assert sorted(map(repr, M.substituted(rows, terms, pattern_terms=0, broadcast_terms=broadcast, block_rows=16).collect())) == want
    seen = []
    keys = M._keys_of(M._Scan(M._letters(spark), [1], True))
    for batch in keys(rows.where("text IS NOT NULL").selectExpr("7L AS block", "text").repartition(1).toArrow().to_batches()):
        seen += batch.column("key").to_pylist()
    assert seen.count("the") == 1  # not once for each of its places
