"""A transform that raises leaves the texts on which it does as they were."""

from pyspark.sql import functions as F

from lectern.operators import rules as R

TEXTS = ["good text", "bad text", "good text", "bad text", None, "", "number", "none"]


def plain(text):
    if "bad" in text:
        raise RuntimeError("no")
    return 5 if text == "number" else None if text == "none" else text + "!"


def batched(texts):
    if texts.str.contains("bad").any():
        raise RuntimeError("no")
    return texts + "!"


def test_failures_stay_with_their_rows(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").repartition(2)
    got = {r.i: (r.normalized, r.normalize_error) for r in R.normalized(rows, "t", [R.guarded(plain), lambda c: F.concat(c, F.lit("?"))], F.col("i") >= 0).collect()}
    bad, good = ("bad text?", "RuntimeError: no"), ("good text!?", None)
    assert got == {0: good, 1: bad, 2: good, 3: bad, 4: (None, None), 5: ("", None), 6: ("number?", "TypeError: int instead of str"), 7: ("none?", None)}
    got = {r.i: (r.normalized, r.normalize_error) for r in R.normalized(rows.where("i < 6"), "t", [R.guarded(batched, batch=True)], F.col("i") != 2).collect()}
    assert got == {0: ("good text!", None), 1: ("bad text", "RuntimeError: no"), 2: ("good text", None), 3: ("bad text", "RuntimeError: no"), 4: (None, None), 5: ("", None)}


def test_failures_are_not_shared(spark, tmp_path):
    """Of rows with one text, a failure of the first call is no answer for the others: each is tried again."""
    mark = str(tmp_path / "called")

    def flaky(text):
        import os

        if not os.path.exists(mark):
            open(mark, "w").close()
            raise OSError("not yet")
        return text + "!"

    rows = spark.createDataFrame([(i, "same") for i in range(4)], "i int, t string").coalesce(1)
    assert {(r.normalized, r.normalize_error) for r in R.normalized(rows, "t", [R.guarded(flaky)], F.lit(True)).collect()} == {("same!", None)}


def test_a_text_is_transformed_once(spark, tmp_path):
    """Calls of the transform: one for each distinct text, and one more for each row of a text that failed."""
    log = str(tmp_path / "calls")

    def counted(text):
        with open(log, "a") as f:
            f.write(text + "\n")
        if "bad" in text:
            raise ValueError(text)
        return text + "!"

    texts = ["one", "two", "twice", "twice", "bad", "bad twice", "bad twice", None, None, "out"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    got = {r.i: (r.normalized, r.normalize_error) for r in R.normalized(rows, "t", [R.guarded(counted)], F.col("i") < 9).collect()}
    assert got == {i: (t, None) if t is None or i == 9 else (t, f"ValueError: {t}") if "bad" in t else (t + "!", None) for i, t in enumerate(texts)}
    assert sorted(open(log).read().splitlines()) == ["bad"] * 2 + ["bad twice"] * 3 + ["one", "twice", "two"]
