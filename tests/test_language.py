"""Language vectors in the row against plain counting."""

import random
from collections import Counter

from pyspark.sql import functions as F

from lectern.operators import language as V


def test_counted(spark):
    texts = ["aaaaab", "", "ab", None, "abcabcabc" * 50, "ÉxéyÉz"]
    rows = spark.createDataFrame([*enumerate(texts)], "i int, t string").select("i", V.counted(V.trigrams(F.col("t"))).alias("c")).collect()
    for r in rows:
        t = texts[r.i]
        assert r.c is None if t is None else {x.item: x.n for x in r.c} == Counter(t.lower()[k : k + 3] for k in range(len(t) - 2))


def test_line_languages(spark):
    rng = random.Random(1)
    letters = {"x": "abcd ", "y": "cdef ", "z": "qrst "}
    docs = [(k, "\n".join("".join(rng.choices(letters[lang], k=rng.choice([10, 39, 40, 80, 200]))) for _ in range(4)), lang) for k, lang in enumerate("xyzx" * 6)] + [(90, None, "x"), (91, "9" * 50, None), (92, "", "z")]
    d = spark.createDataFrame(docs, "doc_id int, text string, lang string").repartition(3)
    counts = {lang: Counter(t.lower()[k : k + 3] for _, t, own in docs if own == lang and t for k in range(len(t) - 2)) for lang in letters}
    weights = {lang: {g: n * 100000 // c.total() for g, n in c.items() if n * 1000 >= c.total()} for lang, c in counts.items()}
    want = set()
    for i, t, _ in docs:
        for k, line in enumerate(t.split("\n") if t is not None else []):
            scores = {lang: sum(w.get(line[j : j + 3], 0) for j in range(len(line) - 2)) for lang, w in weights.items()}
            best = max(scores, key=lambda lang: (scores[lang], lang))
            want.add((i, k, best if scores[best] and len(line.strip(" ")) >= 40 else None))
    profile = V.profiles(d)
    assert {(r.lang, r.g): r.w for r in profile.collect()} == {(lang, g): n for lang, w in weights.items() for g, n in w.items()}
    for bound in (200_000, 0):
        assert {tuple(r) for r in V.line_languages(d, profile, row_trigrams=bound).collect()} == want
    assert V.line_languages(d.limit(0), profile).count() == 0 and {r.lang for r in V.line_languages(d, V.profiles(d.limit(0))).collect()} == {None}


def test_long_lines_are_batches(spark):
    """Lines of a megabyte and characters beyond the first plane: what took a hash lookup in an expression for each character takes seconds."""
    rows = [(1, "ab😀É" * 250_000, "x"), (2, "cdÉ😀" * 250_000 + "\n" + "zzz" * 20, "y")]
    d = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    profile = V.profiles(d)
    assert {(r.g, r.w) for r in profile.where("lang = 'x'").collect()} == {(g, 25_000 - (g not in ("ab😀", "b😀é"))) for g in ("ab😀", "b😀é", "😀éa", "éab")}
    assert sorted(map(tuple, V.line_languages(d, profile).collect())) == [(1, 0, "x"), (2, 0, "y"), (2, 1, None)]
    assert "regexp_extract_all" not in V.line_languages(d, profile)._jdf.queryExecution().optimizedPlan().toString()
