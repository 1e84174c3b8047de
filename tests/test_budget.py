"""Cutting to a budget in the row is the plain recursive cutting; packing keeps every character."""

import random

from pyspark.sql import functions as F

from lectern.operators import text as T


def test_budget_tree(spark):
    rng = random.Random(3)
    bits = ["palavra", "a", "uma,", "dois;", "1,5", "x:y", " ", "  ", "\n", "\t", ",", " ; ", "longuíssima" * 3, "😀é", "fim."]
    texts = ["".join(x + rng.choice(["", " "]) for x in rng.choices(bits, k=rng.randint(0, 40))) for _ in range(400)] + [None, "", " ", "x" * 90, "a, b, c, d, e", ",,,,,,, ,,,,, a", "\n".join(["ab"] * 30), "a b " * 800]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for limit in (1, 10, 25):
        got = {r.i: r.p for r in d.select("i", T.budget_pieces(F.col("t"), limit).alias("p")).collect()}
        for i, t in enumerate(texts):
            assert got[i] == (None if t is None else T._budget(t, limit, len)), (t, limit)


def test_texts_with_nul(spark):
    docs = spark.createDataFrame([(1, "a\x00b c. Next one."), (2, "\x00"), (3, "xyz. " * 900 + "\x00.")], "doc int, text string")
    got = {}
    for r in T.chunks(docs, 1000).orderBy("doc", "sequence").collect():
        got.setdefault(r.doc, []).append(r.text)
    assert got[1] == ["a\x00b c. Next one."] and got[2] == ["\x00"] and " ".join(got[3]) == ("xyz. " * 900 + "\x00.") and max(map(len, got[3])) <= 1000
    words = spark.createDataFrame([("a\x00 b c\x00c d",)], "t string")
    assert words.select(T.split_words(F.col("t"), 4).alias("p")).first().p == ["a\x00 b", "c\x00c", "d"]


def test_false_boundaries(spark):
    cases = {"O Dr.": True, "Robert C.": True, "pag.": True, "PAG.": True, "fim.": False, "fim!": False, "": False, None: False, "xpag.": False, "a. ": False, "Dr.\n": False, "1.": True, "É.": True}
    rows = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.f for r in rows.select("t", T.false_boundary(F.col("t")).alias("f")).collect()} == cases


def test_long_texts_are_cut_in_a_worker(spark):
    """Cut by length in an Arrow UDF, which gets only what is too long: the pieces are those of the expressions, exempt, blank and null texts included."""
    rng = random.Random(5)
    bits = ["palavra", "a", "uma,", "dois;", "1,5", " ", "\n", "\x1f", "\u00a0", ",", "longuíssima" * 3, "😀é"]
    texts = ["".join(x + rng.choice(["", " "]) for x in rng.choices(bits, k=rng.randint(0, 30))) for _ in range(300)] + [None, "", " ", " ab ", " " * 30]
    d = spark.createDataFrame([(i, t, "ae"[i % 2] if i % 3 else None) for i, t in enumerate(texts)], "i int, text string, code string")
    found = T.split_budget(d, 12, code=F.col("code"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "aggregate(" not in plan
    got = {}
    for r in found.orderBy("i", "piece_no").collect():
        got.setdefault(r.i, []).append(r.piece)
    for r in d.select("*", T.budget_pieces(F.col("text"), 12).alias("p")).collect():
        assert got.get(r.i) == (None if r.text is None else [r.text] if r.code == "a" else r.p)


def test_middle():
    rng = random.Random(6)
    for _ in range(3000):
        t = "".join(rng.choices("ab,; \t", k=rng.randrange(12)))
        want = None
        for marks, after in ((",;:", 1), (" \t", 0)):
            at = min((p for p in range(1, len(t)) if t[p] in marks), key=lambda p: (abs(p - len(t) // 2), p), default=None)
            if want is None and at is not None and at + after < len(t):
                want = at + after
        assert T._middle(t) == want, t
