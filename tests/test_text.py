import time

from pyspark.sql import functions as F

from lectern.functions import notation as N
from lectern.operators import rules as R
from lectern.operators import state as S
from lectern.operators import structure as L
from lectern.operators import text as T


def said(spark, fn, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in rows.select("i", fn(F.col("t")).alias("x")).orderBy("i").collect()]


def test_notation(spark):
    got = said(
        spark, N.sanitize,
        "Custa R$ 1.200,00.", "US$ 5 e € 3", "50%", "cap. 3 da pág. 9", "recap. final", "às 15h30 e 9h", "em 05/03/2019 e 20/25/2019", "12/20",
        "páginas 10-15", "caiu 10-15 reais", "1990–1995", "veja https://x.com/a. ou a@b.com", "solto * asterisco", "— diálogo", "# Título\n> cita",
        "1. um\n2. dois", "42. Esse é o número.", "a\n```py\nx\n~~~\n```\nb", "a\n~~~\nx", "| a | b |\n|---|---|\n| c |  |", "SÉC. XX", None, "",
    )
    assert got == [
        "Custa 1.200,00 reais.", "5 dólares e 3 euros", "50por cento", "capítulo 3 da página 9", "recap. final", "às 15 e 30 e 9 horas", "em 05 de março de 2019 e 20/25/2019", "12/20",
        "páginas 10 a 15", "caiu 10-15 reais", "1990 a 1995", "veja link. ou endereço de e-mail", "solto * asterisco", "— diálogo", "Título\ncita",
        "um\ndois", "42. Esse é o número.", "a\ntrecho de código omitido\nb", "a\ntrecho de código omitido", "a, b\nc", "século XX", None, "",
    ]


def test_single_passes(spark):
    cases = {
        N.currency: [("U$ 5 S$ 7", "U5 dólares S7 dólares"), ("CUSTOS$ 5", "CUSTOS5 dólares"), ("R$ 1.200,00. US$3 € 4 £ 2,5", "1.200,00 reais. 3 dólares 4 euros 2,5 libras"), ("$ x", "$ x")],
        N.abbreviations: [("vol.ed. 2", "volumeedição 2"), ("Srta. e sr. Prof.", "senhorita e senhor professor"), ("recap. xpp.", "recap. xpp.")],
        N.list_numbers: [("1. um\n- ", "1. um\n- "), ("1. um\n- dois", "um\n- dois"), ("12) a\n13) b\nc", "a\nb\nc")],
        N.dates: [("1/02/99, 31/12/2020 e 9/13/2000", "1 de fevereiro de 99, 31 de dezembro de 2020 e 9/13/2000"), ("1/2/3", "1/2/3")],
        N.symbols: [("a≠b & 5%§", "adiferente deb e 5por centoparágrafo")],
    }
    for f, pairs in cases.items():
        assert said(spark, f, *[a for a, _ in pairs], None, "") == [*[b for _, b in pairs], None, ""]


def test_terms(spark):
    assert said(spark, lambda c: N.substitute_terms(c, {"GPU": "gê pê u", "GPU card": "placa GPU"}), "a gpu card, GPUs gpu") == ["a placa GPU, GPUs gê pê u"]  # what is put in isn't read again
    assert said(spark, lambda c: N.substitute_terms(c, {}), "x") == ["x"]
    assert said(spark, lambda c: N.substitute_terms(c, {"a.b$": r"\1 $0"}), "xa.b$ a.b$ axb$", None) == [r"xa.b$ \1 $0 axb$", None]


def test_cleaning(spark):
    rows = [(1, 1, "MY BOOK\ndemon-\nstration of\nlines.\nNext"), (1, 2, "MY BOOK\nA-\nB\n\nend"), (2, 1, "MY BOOK"), (2, 2, " \n "), (3, 2, "tração e mais"), (3, 1, "Fim.\n demons- "), (3, 3, None), (3, 4, "a linha\n\n"), (4, 1, "")]
    pages = spark.createDataFrame(rows, "unit int, page int, text string")
    got = {r.unit: r.text for r in T.clean_pages(pages).collect()}
    assert got == {1: "demonstration of lines.\nNext A- B\n\nend", 2: "MY BOOK", 3: "Fim.\ndemonstração e mais\n\na linha", 4: ""}


def test_chapter_texts(spark):
    pages = spark.createDataFrame([("d", 1, "H\num-"), ("d", 2, "H\ndois."), ("d", 3, "H\nfim")], "doc string, page_number int, text string")
    found = spark.createDataFrame([("d", 1, "A", 1, 2), ("d", 2, "B", 3, 3)], "doc string, chapter int, title string, start_page int, end_page int")
    assert sorted((r.chapter, r.title, r.text) for r in L.chapter_texts(pages, found).collect()) == [(1, "A", "umdois."), (2, "B", "H fim")]


def test_layout(spark):
    span = lambda page, block, line, at, text, size, y0=400.0, height=800.0: ("d", page, block, line, at, text, size, y0, height)
    rows = [span(1, 0, 0, 0, "CAP 1", 9.3, 20.0), span(1, 1, 0, 1, "Título", 20.0), span(1, 2, 0, 2, " " * 50, 30.0), span(1, 2, 0, 3, "corpo do te-", 10.0), span(1, 2, 1, 4, "xto", 10.0), span(1, 3, 0, 5, "nota", 8.0), span(1, 4, 0, 6, "  ", 10.0), span(2, 0, 0, 7, "sem altura", 10.0, 20.0, 0.0)]
    spans = spark.createDataFrame(rows, "doc string, page int, block int, line int, position int, text string, size double, y0 double, page_height double")
    assert L.body_sizes(spans).first().body == 10.0
    assert [r.role for r in L.layout_blocks(spans).orderBy("page", "block").collect()] == ["header", "heading", "body", "small", "empty", "body"]
    assert {r.page: r.text for r in L.narratable_pages(L.layout_blocks(spans)).collect()} == {1: "Título\n\ncorpo do te-\nxto", 2: "sem altura"}


def test_sentences_and_chunks(spark):
    docs = spark.createDataFrame([(1, "O Dr. Silva viu. Robert C. Martin leu!\n\nNovo parágrafo? Sim."), (2, ""), (3, None)], "doc int, text string")
    got = [(r.paragraph, r.sentence, r.text) for r in T.sentences(docs).orderBy("doc", "paragraph", "sentence").collect()]
    assert got == [(0, 0, "O Dr. Silva viu."), (0, 1, "Robert C. Martin leu!"), (1, 0, "Novo parágrafo?"), (1, 1, "Sim.")]
    assert [r.text for r in T.chunks(docs, 40).orderBy("doc", "sequence").collect()] == ["O Dr. Silva viu. Robert C. Martin leu!", "Novo parágrafo? Sim."]
    assert [r.text for r in T.chunks(docs, 1000).collect()] == ["O Dr. Silva viu. Robert C. Martin leu!\n\nNovo parágrafo? Sim."]
    assert [r.pause_ms for r in T.pauses(docs).orderBy("segment").collect()] == [420, 800, 470, 0]


def test_packing_properties(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{k % 7}" * (1 + k % 5) + "." for k in range(i * 13))) for i in range(1, 6)], "doc int, text string")
    rows = T.chunks(docs, 60).orderBy("doc", "sequence").collect()
    for doc, text in docs.collect():
        own = [r.text for r in rows if r.doc == doc]
        assert " ".join(own) == text and all(len(c) <= 60 for c in own)


def test_request_split(spark):
    assert said(spark, lambda c: T.split_words(c, 7), "aa bb cc dd", "short", "averylongword", None) == [["aa bb", "cc dd"], ["short"], ["averylongword"], None]
    assert said(spark, lambda c: T.split_clauses(c, 8), "aa, bb, cc; dd") == [["aa, bb,", "cc; dd"]]


def test_gates(spark):
    rows = spark.createDataFrame([("um texto", "um texto!"), ("um texto", "um"), ("um texto", "Aqui está: um texto"), ("um texto", " "), ("um texto", "um textos"), ("", "x"), (None, "x"), ("um texto", None)], "o string, c string")
    size, word = R.size_verdict(F.col("o"), F.col("c")), R.word_verdict(F.col("o"), F.col("c"))
    got = rows.select(size.alias("s"), word.alias("w"), R.rewritten(F.col("o"), F.col("c"), size).alias("r")).collect()
    assert [tuple(r)[:2] for r in got] == [("accepted", "accepted"), ("size", "words"), ("preamble", "preamble"), ("blank", "blank"), ("accepted", "words"), ("original", "original"), ("original", "original"), ("blank", "blank")]
    assert [r.r for r in got] == ["um texto!", "um texto", "um texto", "um texto", "um textos", "", None, "um texto"]


def test_estimates(spark):
    rows = spark.createDataFrame([("50%", True), ("50%", False), (None, True)], "t string, k boolean")
    rate = R.chain_rate(F.lit(0.5), F.lit(None).cast("double"), F.lit(0.25))
    assert [r[0] for r in rows.select(R.cost_estimate(F.col("t"), F.lit(1.0), rate, F.col("k"))).collect()] == [11 * 1.75, 11.0, 0.0]
    runs = spark.createDataFrame([("a", 1, 2.0, 8.0), ("a", 1, 4.0, 10.0), ("a", 2, 3.0, 3.0), ("b", 1, 0.0, 1.0)], "k string, repetition int, seconds double, audio_seconds double")
    assert {tuple(r) for r in R.timing_summary(runs, ["k"]).collect()} == {("a", 2, 4.5, 3.0, 2.0), ("b", 1, 0.0, 0.0, None)}
    assert [tuple(r[0]) for r in spark.createDataFrame([("Um. Dois? Três.\n\nQuatro!",)], "t string").select(R.routing_cost(F.col("t"), 11)).collect()] == [(20, 16, 12)]


def test_cost_gate(spark):
    rows = spark.createDataFrame([(0.02, 0.01, True), (0.02, None, False), (0.0, 0.01, False), (0.005, 0.01, True)], "e double, c double, k boolean")
    assert [r[0] for r in rows.select(R.cost_gate(F.col("e"), F.col("c"), F.col("k"))).collect()] == ["degrade", "pending_confirmation", "proceed", "proceed"]


def test_chapters_tile(spark):
    toc = spark.createDataFrame([("a", 1, 1, "Capa", 1), ("a", 2, 2, "1", 3), ("a", 3, 2, "Origem", 3), ("a", 4, 2, "Fim", 20), ("a", 5, 2, "7", 11), ("a", 6, 3, "O que são Design e Arquitetura?", 11)], "doc string, entry_no int, level int, title string, page int")
    totals = spark.createDataFrame([("a", 30), ("b", 25), ("c", 0)], "doc string, total int")
    got = [(r.doc, r.chapter, r.title, r.start_page, r.end_page) for r in L.chapters(toc, totals).orderBy("doc", "chapter").collect()]
    assert got[:2] == [("a", 1, "Origem", 1, 10), ("a", 2, "O que são Design e Arquitetura?", 11, 19)]
    assert [x[2:] for x in got if x[0] == "b"] == [("Parte 1", 1, 10), ("Parte 2", 11, 20), ("Parte 3", 21, 25)]
    for doc, total in (("a", 30), ("b", 25)):
        pages = [p for x in got if x[0] == doc for p in range(x[3], x[4] + 1)]
        assert pages == [*range(1, total + 1)]


def test_signal(spark):
    rows = spark.createDataFrame([([0.0, 0.0, 1.0, 0.5, 0.0, 0.0, 0.0],), ([0.0, 0.0],)], "s array<float>")
    assert [list(r[0]) for r in rows.select(R.trim_edges(F.col("s"), rate=100, guard_ms=10)).collect()] == [[0.0, 1.0, 0.5, 0.0], [0.0, 0.0]]


def test_state(spark):
    jobs = spark.createDataFrame([(1, "p", "queued", 0, 1), (2, "p", "queued", 5, 2), (3, "p", "running", 9, 3)], "job int, stage string, status string, priority int, seq int")
    assert [r.job for r in S.queue_order(jobs, 5).orderBy("place").collect()] == [2, 1]
    assert {r.job: r.should_yield for r in S.yields(jobs).collect()} == {1: True, 2: False, 3: False}
    assert {r.job: r.priority for r in S.prioritized(jobs, F.col("job") == 1).collect()} == {1: 10, 2: 5, 3: 9}
    beats = spark.sql("SELECT 'w' AS worker, TIMESTAMP '2024-01-01 00:00:00' AS ts")
    for end, alive in (("2024-01-01 00:02:00", True), ("2024-01-01 00:02:01", False)):
        assert S.liveness(beats, F.lit(end)).first().alive is alive


    assert [r.alive for r in S.liveness(beats).collect()] == [True]
    books = spark.createDataFrame([(1, "pending_confirmation", False), (2, "ready", False), (3, "pending_confirmation", False)], "book int, status string, cost_confirmed boolean")
    after, queue = S.confirmed(books, jobs.withColumn("book", F.lit(9)), books.where("book < 3"))
    assert sorted(map(tuple, after.collect())) == [(1, "uploaded", True), (2, "ready", False), (3, "pending_confirmation", False)]
    assert [(r.book, r.stage, r.status, r.seq) for r in queue.where("job IS NULL").collect()] == [(1, "process", "queued", 4)]
    new = spark.createDataFrame([(1, 1, 5), (1, 1, 4), (2, 1, 6), (3, 1, 7)], "book int, sequence int, order int")
    kept, refused = S.appended(spark.createDataFrame([(3, 1)], "book int, sequence int"), new, ["book", "sequence"])
    assert sorted(r.order for r in kept.collect()) == [4, 6] and sorted(r.order for r in refused.collect()) == [5, 7]


def test_order(spark):
    from lectern.operators.order import with_sum_before

    rows = [(k, o, o % 5) for k in "ab" for o in (*range(-20, 60, 3), 1000)]
    got = with_sum_before(spark.createDataFrame(rows, "k string, o int, n int"), "k", "o", F.col("n"), "before", 16).collect()
    assert all(r.before == sum(n for k, o, n in rows if k == r.k and o < r.o) for r in got) and len(got) == len(rows)
    parts = spark.createDataFrame([("x", 2, [1.0]), ("x", 1, [0.5, 0.5])], "k string, o int, s array<double>")
    assert sorted((r.o, r.start, r.seconds) for r in R.joined_signal(parts, "k", "o", "s", 2).collect()) == [(1, 0, 0.0), (2, 2, 1.0)]


def test_schema_evolution(spark):
    import pytest

    rows = spark.createDataFrame([(1,)], "a int")
    assert S.add_column(S.add_column(rows, "b", "int", 7), "b", "int", 9).first().b == 7
    with pytest.raises(ValueError):
        S.add_column(rows, "c", "int", None, True)


def test_budget_split(spark):
    texts = ["um, dois, três; quatro cinco seis sete oito nove dez", "palavramuitolonga" * 3, "a b", "x " * 40 + "fim,", "1,5 " * 12]
    rows = spark.createDataFrame([*enumerate(texts)], "doc int, text string")
    got = {}
    for r in T.split_budget(rows, 20).orderBy("doc", "piece_no").collect():
        got.setdefault(r.doc, []).append(r.piece)
    for i, t in enumerate(texts):
        assert "".join(got[i]).replace(" ", "") == t.replace(" ", "") and all(len(p) <= 20 or " " not in p for p in got[i])
    assert got[0] == ["um, dois, três;", "quatro cinco seis", "sete oito nove dez"]  # cut at the blank nearest the middle
    same = spark.createDataFrame([("x", "um dois três quatro cinco", "e")] * 2 + [("x", "um dois três quatro cinco", "a"), ("y", None, None)], "doc string, text string, code string")
    rows = T.split_budget(same, 4, measure=lambda t: len(t.split()), code=F.col("code")).orderBy("code", "piece_no").collect()
    assert [(r.piece_no, r.piece) for r in rows] == [(0, "um dois três quatro cinco"), *[(0, "um dois três")] * 2, *[(1, "quatro cinco")] * 2]


def test_dictionary_source(spark, tmp_path):
    from lectern.sources import dictionary

    (tmp_path / "terms.yaml").write_text('# terms\nGPU: gê pê u\n"SQL": "sequel"\nbroken\n: x\n')
    assert dictionary.as_map(dictionary.read_terms(spark, str(tmp_path / "terms.yaml"))) == {"GPU": "gê pê u", "SQL": "sequel"}
    assert dictionary.as_map(dictionary.read_terms(spark, str(tmp_path / "none.yaml"))) == {}


def test_sources(spark):
    pages = spark.createDataFrame([("a", 1, "x"), ("a", 2, " "), ("b", 1, "\t")], "doc string, page_number int, text string")
    other = pages.withColumn("text", F.lit("ocr"))
    assert sorted((r.doc, r.page_number, r.text) for r in L.with_fallback(pages, other).collect()) == [("a", 1, "x"), ("a", 2, " "), ("b", 1, "ocr")]
    assert L.page_range(pages, -1, 1).count() == 2 and L.page_range(pages, None, None).count() == 3
    words = spark.createDataFrame([("a", 1, 1, "ok", 90.0), ("a", 1, 2, "no", -1.0), ("a", 1, 3, " ", 50.0), ("a", 2, 1, "", -1.0)], "doc string, page int, word_no int, text string, conf double")
    assert {(r.page, r.n_words, r.confidence, r.text) for r in L.confidence(words).collect()} == {(1, 1, 0.9, "ok"), (2, 0, 0.0, "")}
    merged = S.merged_arrivals(spark.createDataFrame([("b", 1)], "book string, sequence int"), spark.createDataFrame([("b", 1), ("b", 2), ("b", 2)], "book string, sequence int"))
    assert sorted(r.sequence for r in merged.collect()) == [1, 2]


def test_packing_is_near_linear(spark):
    """A text of many items is packed in a scan: what took minutes in a fold over arrays of items takes seconds."""
    words, long = "palavra e " * 40_000, "Uma frase. Outra! " * 20_000
    begun = time.monotonic()
    rows = spark.createDataFrame([(words, long)], "w string, s string").select(T.split_words(F.col("w"), 80).alias("w"), T.chunk_texts(F.col("s"), 1000).alias("s"), R.routing_cost(F.col("s"), 100).alias("c")).collect()
    assert time.monotonic() - begun < 20
    assert " ".join(rows[0].w) == words.strip() and max(map(len, rows[0].w)) <= 80 and " ".join(rows[0].s) == long.strip() and max(map(len, rows[0].s)) <= 1000
    assert rows[0].c.by_sentence == 6 * 20_000


def test_marks_in_the_text(spark):
    """Separators that the scans use are blanks, or kept, where a text has them itself."""
    text = "Um\x1edois.\x1d Três!\n\x1c\nQuatro.\n \nCinco\x00seis; sete"
    row = spark.createDataFrame([(text,)], "t string").select(T.sentence_texts(F.col("t")), T.chunk_texts(F.col("t"), 15), T.split_clauses(F.col("t"), 9)).collect()[0]
    assert row[0] == [["Um dois.", "Três!", "Quatro."], ["Cinco\x00seis; sete"]]
    assert row[1] == ["Um dois. Três!", "Quatro.", "Cinco\x00seis; sete"]
    assert row[2] == [text.split("; ")[0] + ";", "sete"]


def test_words_of_a_page_are_not_shuffled(spark):
    """confidence() of the words, row by row: of a page in several rows, blank, unsaid, null and no words, null keys."""
    w = lambda *own: [(i, t, c) for i, t, c in own]
    rows = [("a", 1, w((0, "x", 9), (1, " ", 50), (2, "y", -1), (3, "\n z", 30))), ("a", 2, w((0, "", 1))), ("a", 3, []), ("a", 4, None), (None, 5, w((0, "p", 7))), ("b", 6, w((0, "m", 1), (2, "o", 100))), ("b", 6, w((1, "n", 50), (3, None, 5))), (None, None, w((0, "q", 0))), (None, None, w((1, "r", 8))), ("a", 7, w((0, None, 5), (1, "s", None)))]
    pages = spark.createDataFrame(rows, "doc string, page int, words array<struct<word_no: int, text: string, conf: int>>")
    want = sorted(map(str, L.confidence(pages.select("doc", "page", F.inline("words"))).collect()))
    assert sorted(map(str, L.confidence_of_pages(pages).collect())) == want and len(want) == 6
