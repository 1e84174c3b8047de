"""Edge cases and brute force for the dealt operators, on small tables."""

import hashlib
import os
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import components, decontaminate, jaccard_join, language_id, line_dedup, pieces, pii, quality_classifier, quality_rules, toxicity, warc
from lectern.llm import features as X

LONG = "palavra longa " * 30000
ROWS = [
    (1, "Hello World, this is one line of text\nshort\nshared line number one", "en"),
    (2, "shared line number one\nSHARED LINE NUMBER ONE  \n\nother words come here", "en"),
    (3, None, None), (4, "", "en"), (5, " \n\t ", "fr"), (6, LONG, "pt"), (7, LONG, "pt"), (7, LONG, "pt"),
    (None, "shared line number one", None), (8, "12345 67890 !!", "en"), (9, "um dois três", "pt"), (10, "um dois três", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame([(*r, 1, 2.0, 3) for r in ROWS], "doc_id long, text string, lang string, score int, n_lines double, n int")
    return rows.repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < 0")


def corpus(n, seed=0):
    """Random texts with exact copies, near copies at all distances, and shared passages."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    out = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(n)]
    for k in range(n):
        own = rng.choice(out[:n]).split()
        for _ in range(rng.randint(0, 6)):
            if own:
                own[rng.randrange(len(own))] = rng.choice(words)
        out.append(" ".join(own))
    passage = " ".join(words[:30])
    return out + [f"{t} {passage}" for t in out[: n // 3]] + [passage] * 5


def shingle_set(text, k=5):
    own = (text or "").encode().lower().split()
    return frozenset(tuple(own[i : i + k]) for i in range(len(own) - k + 1)) if len(own) >= k else frozenset([tuple(own)] if own else [])


# WARC


def test_warc(spark, tmp_path):
    big = "x" * 5000
    pages = spark.createDataFrame([(1, "http://a", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u\r\nX: y", "é" * 60), (6, "u", "é" * 60), (7, "u", "small"), (8, "u", "small"), (None, "u", big), (1, "http://a", big)], "page_id long, url string, html string")
    warc.write_warc(pages, str(tmp_path / "w"), archive_bytes=8000)
    got = sorted([(r.page_id or -1, r.payload_bytes, r.record_type, r.refers_to, bytes(r.payload)) for r in warc.read_warc(spark, str(tmp_path / "w")).collect()], key=str)
    first = big.encode()
    assert sorted(x[:4] for x in got) == sorted([(1, 5000, "response", None), (1, 5000, "response", None), (2, 5000, "revisit", 1), (3, 0, "response", None), (4, 0, "response", None), (5, 120, "response", None), (6, 120, "revisit", 5), (7, 5, "response", None), (8, 5, "response", None), (-1, 5000, "revisit", 1)], key=str)
    assert all(x[4] == (b"" if x[2] == "revisit" else first if x[0] == 1 else x[4]) for x in got)
    warc.write_warc(pages.where("page_id < 0"), str(tmp_path / "none"))
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0


def test_archive_dictionary():
    records = [warc.record({"page_id": k, "url": f"http://x/{k}", "payload": f"<html><body>common template {k} {'text ' * 30}</body></html>".encode() * 3, "payload_bytes": 1, "payload_digest": "d", "record_type": "response", "refers_to": None}) for k in range(200)]
    packed = warc.archive(records)
    assert int.from_bytes(packed[:4], "little") == warc.DICTIONARY_MAGIC
    assert [h["warc-record-id"] for h, _ in warc.records_of(packed)] == [f"<urn:page:{k}>" for k in range(200)]
    assert list(warc.records_of(b"")) == []


# Decontamination


def test_contained_items(spark, docs):
    texts = corpus(60, 3)
    items = [" ".join(t.split()[3:25]) for t in texts[:20]] + ["W1 w2  w3", "", None, "w1"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, ""])], "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = set()
    for i, t in enumerate(texts):
        own = t.encode().split()
        for j, item in enumerate(items):
            shingles = decontaminate.item_shingles((item or "").encode())
            if shingles:
                k = len(next(iter(shingles)).split())
                shared = len(shingles & {b" ".join(own[x : x + k]) for x in range(len(own) - k + 1)})
                if 4 * shared >= 3 * len(shingles):
                    want.add((i, j, len(shingles), shared))
    for size in (8 << 20, 200):  # one block, and many
        got = decontaminate.contained_items(d, b, block_bytes=size)
        assert {tuple(r) for r in got.collect()} == want and want
    left = decontaminate.decontaminated(d, b)
    assert {r.doc_id for r in left.collect()} == {*range(len(texts) + 2)} - {x[0] for x in want}
    assert decontaminate.contained_items(docs, b.where("item_id < 0")).count() == 0
    assert decontaminate.contained_items(docs.where("doc_id < 0"), b).count() == 0


# Language


def test_language(spark, docs, empty):
    samples = {"en": "the of and to in that it is was for", "fr": "le la les des une que dans pour avec être", "de": "der die das und nicht ist ein eine von mit"}
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(samples[k].split(), k=20)), k) for i, k in enumerate(list(samples) * 30)]
    train = spark.createDataFrame([*rows, (900, None, "en"), (901, "x", None)], "doc_id long, text string, lang string")
    model = language_id.fit(train, F.col("doc_id") % 4 != 2)
    got = {r.doc_id: r for r in language_id.identify(train, model).collect()}
    assert np.mean([got[i].lang_pred == k for i, _, k in rows if i % 4 == 2]) > 0.95
    assert got[900].lang_pred == "und" and got[900].score == 0
    odd = [r for r in language_id.identify(docs, model).collect()]
    assert len(odd) == len(ROWS) and all(0 <= r.score <= 1 for r in odd)
    assert {r.lang_pred for r in odd if r.doc_id in (3, 4, 5, 8)} == {"und"}
    assert language_id.identify(empty, model).count() == 0 and language_id.fit(empty, F.lit(True)) is None
    assert {r.lang_pred for r in language_id.identify(docs, None).collect()} == {"und"}


# Jaccard


def brute_components(texts):
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= 75 * (len(sets[i]) + len(sets[j]) - shared):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {(i, len(sets[i]), find(i)) for i in range(len(texts))}


@pytest.mark.parametrize("seed", [0, 1])
def test_jaccard_components(spark, seed):
    texts = [*corpus(120, seed), "", "a b", "A  b", "c"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert {tuple(r) for r in jaccard_join.similar_components(d).collect()} == brute_components(texts)


def test_jaccard_clusters(spark):
    """Families of near copies whose members link with other families at the threshold, while their first sets don't."""
    rng, texts = random.Random(9), []
    for family in range(6):
        base = [f"f{family}x{k}" for k in range(60)]
        for other in range(3):
            own = list(base)
            own[:9] = [f"v{other}y{k}" for k in range(9)]
            for _ in range(12):
                own[rng.randrange(60)] = rng.choice([f"z{rng.randrange(50)}", base[0]]) if rng.random() < 0.15 else own[rng.randrange(60)]
                texts.append(" ".join(own))
    bridge = [f"f0x{k}" for k in range(9, 60)]
    texts += [" ".join([*bridge[:-k], *(f"q{j}" for j in range(k))]) for k in range(1, 30)]
    d = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(5)
    assert {tuple(r) for r in jaccard_join.similar_components(d).collect()} == brute_components(texts)


def test_jaccard_many_texts_of_one_id(spark):
    a, b = ([f"{x}{k}" for k in range(40)] for x in "ab")
    rows = [(1, a), (1, b), (2, [*a, "x"]), (3, [*b, "x"]), (4, []), (4, ["c", "d"]), (5, ["c", "d"]), (5, []), (6, []), (6, [])]
    shift = (1 << 62) + 5  # sums of such ids overflow
    d = spark.createDataFrame([(i + shift, " ".join(t)) for i, t in rows], "doc_id long, text string").repartition(4)
    got = sorted(tuple(r) for r in jaccard_join.similar_components(d).collect())
    want = [(1, 36, 1), (1, 36, 1), (2, 37, 1), (3, 37, 1), (4, 0, 4), (4, 1, 4), (5, 0, 4), (5, 1, 4), (6, 0, 6), (6, 0, 6)]
    assert got == sorted((i + shift, n, c + shift) for i, n, c in want)


def test_jaccard_edges(docs, empty):
    got = sorted((tuple(r) for r in jaccard_join.similar_components(docs).collect()), key=str)
    assert {r[2] for r in got if r[0] in (6, 7)} == {6} and {r[2] for r in got if r[0] in (9, 10)} == {9}
    assert {r for r in got if r[0] in (3, 4, 5)} == {(3, 0, 3), (4, 0, 4), (5, 0, 5)} and {r[2] for r in got if r[0] is None} == {None}
    assert jaccard_join.similar_components(empty).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(60)] + [(100, x) for x in range(101, 180)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(7, 7), (3, 2)]
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for start in sorted(near):
        if start not in want:
            todo = [start]
            while todo:
                x = todo.pop()
                if x not in want:
                    want[x] = start
                    todo += near[x]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if near[k] - {k}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# SentencePiece


def test_pieces(spark, docs, empty):
    p = pieces.load()
    kept = pieces.encode(docs, p)
    back = pieces.decode(kept.select("doc_id", "round_trip", F.col("segmentations")[0].ids.alias("ids")), p).collect()
    assert all(r.round_trip for r in back) and len(back) == len(ROWS)
    texts = defaultdict(str, {i: t or "" for i, t, _ in ROWS})
    assert all(r.decoded == texts[r.doc_id] for r in back)
    assert pieces.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), p).select("decoded").collect() == [("",), ("",)]
    odd = spark.createDataFrame([(0, "x▁y \U0001f600 中\x00"), (1, "  a\n\n b "), (2, "é" * 300)], "doc_id long, text string")
    for r in pieces.encode(odd, p, 4).join(odd, "doc_id").collect():
        for s in r.segmentations:
            assert b"".join(p.bytes[k] for k in s.ids)[1:].decode() == r.text
        assert [s.score for s in r.segmentations] == sorted((s.score for s in r.segmentations), reverse=True)
        assert len({tuple(s.ids) for s in r.segmentations}) == len(r.segmentations)
    assert pieces.encode(empty, p).count() == 0


def test_n_best_by_enumeration():
    p, rng = pieces.load(), random.Random(2)
    for text in ["".join(rng.choices("abthe n,é中 \n", k=rng.randint(1, 11))) for _ in range(150)]:
        unit = b" " + text.encode()
        arcs, paths = p.arcs(unit), [[(0.0, ())]] + [[] for _ in unit]
        for j in range(1, len(unit) + 1):
            paths[j] = [(a + s, b + ids) for i, s, ids in arcs[j] for a, b in paths[i]]
        want = sorted((round(s, 6) for s, _ in paths[-1]), reverse=True)[:5]
        got = pieces.encode_slice(p, [text.encode()], 5)[0][1]
        assert [round(s, 6) for s, _ in got] == want
        assert all((round(s, 6), tuple(ids.tolist())) in {(round(a, 6), b) for a, b in paths[-1]} for s, ids in got)


@pytest.mark.parametrize("text", ["".join(random.Random(5).choices("abcdefghij0123456789+/", k=20000)), "=" * 20000, "文字" * 3500 + " in an ordinary document", "ab" * 9000 + " " + "cd" * 9000])
def test_n_best_of_long_units(text):
    p, n, unit = pieces.load(), 3, b" " + text.encode()
    best = [[0.0]] + [[]] * len(unit)
    for j, at in enumerate(p.arcs(unit)[1:], 1):
        best[j] = sorted((a + s for i, s, _ in at for a in best[i]), reverse=True)[:n]
    got = pieces.encode_slice(p, [text.encode()], n)[0][1]
    assert [s for s, _ in got] == pytest.approx(best[-1]) and len(best[-1]) == n
    assert len({tuple(ids.tolist()) for _, ids in got}) == n and all(pieces.text_of(p, ids) == text.encode() for _, ids in got)


# Quality and toxicity


def test_quality_classifier(spark, docs, empty):
    rng = random.Random(3)
    good = [" ".join(rng.choices("river stone cloud walk quiet morning paper".split(), k=40)) + "." for _ in range(80)]
    bad = [" ".join(w.upper() + "!!" for w in t.split()) for t in good]
    d = spark.createDataFrame([*enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 80), 0) for i in range(160)] + [(None, 1, 0), (999, None, 0)], "doc_id long, quality int, toxic int")
    model = quality_classifier.fit(d, labels.where("doc_id % 5 <> 0"))
    got = {r.doc_id: r.score for r in quality_classifier.score_quality(d, model).collect()}
    assert all((got[i] >= 0.3) == (i < 80) for i in range(0, 160, 5))
    odd = quality_classifier.score_quality(docs, model)
    assert odd.columns.count("score") == 1 and odd.count() == len(ROWS) and all(0 <= r.score <= 1 for r in odd.collect())
    assert quality_classifier.fit(empty, labels) is None and quality_classifier.score_quality(empty, model).count() == 0


def test_toxicity(spark, docs, empty):
    rng = random.Random(4)
    plain = [" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(60)) for _ in range(300)]
    rude = [" ".join(x for w in t.split() for x in ([w, rng.choice(["blockhead", "numbskull", "dunderpate"])] if rng.random() < 0.1 else [w])) for t in plain[:150]]
    model = toxicity.train([t.encode() for t in rude[:100]], [t.encode() for t in plain[100:250]])
    assert np.mean(model.score([t.encode() for t in rude[100:]]) >= 0.5) > 0.9 > 0.1 > np.mean(model.score([t.encode() for t in plain[250:]]) >= 0.5)
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_toxicity(empty, model).count() == 0 and {r.score for r in toxicity.score_toxicity(docs, None).collect()} == {0.0}
    assert toxicity.fit(empty, spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")) is None
    window = toxicity.windows(toxicity.normalised(b"a b  c\nd " * 9))
    assert window[0, 0] == 0 and int(window[-1].sum()) == len(toxicity.normalised(b"a b  c\nd " * 9))


def test_toxicity_of_rare_kinds():
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(300)]
    kinds = [["".join(rng.choices("qrstuvwxyz", k=9)) for _ in range(3)] for _ in range(100)]

    def text(kind=None):
        own = rng.choices(words, k=80)
        for _ in range(4 if kind else 0):
            own[rng.randrange(80)] = rng.choice(kind)
        return " ".join(own).encode()

    model = toxicity.train([text(kinds[k // 2 % 100]) for k in range(1200)], [text() for _ in range(1200)])  # each kind in 1 % of the texts
    assert np.mean(model.score([text(k) for k in kinds]) >= 0.5) > 0.9 > 0.1 > np.mean(model.score([text() for _ in range(400)]) >= 0.5)


def test_labelled_sample(spark):
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(100)], "doc_id long, quality int")
    chosen, weight = X.labelled_sample(labels, "quality", 20, "doc_id")
    assert chosen.groupBy("__label").count().orderBy("__label").collect() == [(0, 20), (1, 10)] and weight == {0: 4.5, 1: 1.0}


# Lines


def brute_lines(rows, min_docs=2):
    key = lambda s: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", s).translate({c: c + 32 for c in range(65, 91)})
    held = defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                held[key(line)].add(i)
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(held.get(key(x), ())) < min_docs or i == min(held[key(x)])]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_docs", [2, 3])
def test_line_dedup(docs, empty, min_docs):
    got = line_dedup.line_dedup(docs, min_docs)
    assert got.columns.count("n_lines") == 1
    assert sorted([(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()], key=str) == brute_lines(ROWS, min_docs)
    assert line_dedup.line_dedup(empty).count() == 0


# Personal data


def luhn(digits):
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(digits)))) % 10 == 0


def brute_pii(t):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, pattern in kinds.items():
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii(spark, docs, empty):
    rng = random.Random(6)
    texts = ["".join(rng.choices(["a@b.c", "1.2.3.4", "999.1.1.1", "4111 1111 1111 1111", "+1 (555) 555-1234", "_", "%", ".", " ", "é\U0001f600", "4111111111111112", "x", "+", "-", "0", "\n"], k=rng.randint(0, 12))) for _ in range(300)]
    texts += ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8.9", "tel: (076) 555-8046", "mail me: john (at) site (dot) org", "7" * 5000, "a" * 20000 + "@", "a@b.cc " * 1500, None, ""]
    d = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.found for r in pii.personal_data(d).collect()}
    for i, t in enumerate(texts):
        assert [(s.kind, s.start, s.end) for s in got[i] if s.base] == brute_pii(t), t
        assert all(not s.base or s.end > s.start for s in got[i])
    assert pii.personal_data(docs).count() == len(ROWS) and pii.personal_data(empty).count() == 0


def brute_choice(counts, threshold=0.9):
    """Patterns that naive Bayes chooses, from all counts at once."""
    out = set()
    for group in {k[0] for k in counts}:
        own = {k[1:]: n for k, n in counts.items() if k[0] == group}
        votes = defaultdict(int)
        for k, n in own.items():
            votes[k[1:4]] += n
        prior, coins = pii.reliabilities(sorted(votes.items(), key=str), most=pii.MOST_LOOSE if group.startswith("loose") else 0.99)
        whole, seen = [1.0, 1.0], defaultdict(lambda: [0.0, 0.0])
        for k, n in own.items():
            p = pii.belief(k[1:4], prior, coins)
            for side, x in enumerate((p * n, (1 - p) * n)):
                whole[side] += x
                for f in enumerate(k[1:]):
                    seen[f][side] += x
        share = [w / sum(whole) for w in whole]
        for k in own:
            odds = np.log(whole[0] / whole[1]) + sum(np.log((seen[f][0] + share[0]) / whole[0]) - np.log((seen[f][1] + share[1]) / whole[1]) for f in enumerate(k[1:]))
            out |= {(group, *k)} if not k[0] and odds >= np.log(threshold / (1 - threshold)) else set()
    return out


def test_pii_gazetteers(spark):
    """Calling codes are a prefix code, issuers' digits are whole ranges, and any two letters are a country's domain."""
    codes = [c for n in (1, 2, 3) for c in map(str, range(10 ** (n - 1), 10**n)) if re.fullmatch(pii.CODES, c)]
    assert not [(a, b) for a in codes for b in codes if a != b and b.startswith(a)] and {"1", "49", "351", "971", "886"} <= {*codes}
    ranges = [(2221, 2720), (3000, 3059), (3400, 3499), (3528, 3589), (3600, 5899), (6011, 6011), (6200, 6299), (6304, 6304), (6440, 6599), (6700, 6799)]
    said = [n for n in range(1000, 10000) if re.match(pii.ISSUERS, str(n))]
    assert said == [n for n in range(1000, 10000) if any(lo <= n <= hi for lo, hi in ranges)]
    rows = spark.createDataFrame([("email", "a@b.pt", 1), ("email", "a@b.online", 1), ("email", "a@b.notadomain", None), ("phone", "+351 21 555 1234", 1), ("phone", "555 1234", 0), ("card", "6011 0000", 1), ("card", "9011 0000", 0), ("ip", "0.1.2.3", 0), ("secret", "ghp_" + "a" * 20, 1), ("secret", "a" * 20, 0)], "kind string, found string, vote int")
    for kind in (*pii.KINDS, *pii.ADDED):
        assert [r.got for r in rows.where(F.col("kind") == kind).select(pii._gazetteer(kind, F.col("found")).alias("got")).collect()] == [r.vote for r in rows.where(F.col("kind") == kind).collect()], kind


def test_pii_many_shapes(spark):
    signs = [a + b + c + d for a in "._%+-" for b in "._%+-" for c in "._%+-" for d in "._%+-" if a != b != c != d]
    emails = [f"{s[0]}{'7' * n}{'a' * m}{s[1]}x{s[2]}x{s[3]}x@b.com" for s in signs for n in range(21) for m in (0, 4, 8, 12)]
    texts = [" ".join(emails[k : k + 10]) for k in range(0, len(emails), 10)] + ["tel: +1 (555) 555-1234"] * 20 + [f"{w} (076) 555-8046" for w in ("tel:", "phone", "order")]
    d = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(4)
    rows = pii.written(pii.spans(d), "spans").select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*").collect()
    key = lambda r: (r.group, r.base, r.regex, r.gazetteer, r.context, r["shape"])
    counts = defaultdict(int)
    for r in rows:
        counts[key(r)] += 1
    threshold, kept = next((t, c) for t in (0.9, 0.1, 1e-2, 1e-3, 1e-4, 1e-6) if (c := brute_choice(counts, t)))
    want = {(r.doc_id, r.kind, r.start, r.end, r.base) for r in rows if r.base or key(r) in kept}
    got = [(r.doc_id, *s) for r in pii.personal_data(d, threshold).collect() for s in r.found]
    assert len(counts) > 20000 and any(not w[4] for w in want) and set(got) == want and len(got) == len(want)


def test_pii_added_spans(spark):
    """The model adds what several labelers agree on, and leaves look-alikes."""
    hexes = ["".join(random.Random(k).choices("0123456789abcdef", k=40)) for k in range(40)]
    wanted = [("phone", "tel: ", "(076) 555-8046"), ("phone", "call ", "(030) 123-4567"), ("email", "mail ", "john (at) site (dot) org"), ("email", "", "ann [at] shop [dot] com"), ("secret", 'token = "', hexes[0]), ("secret", "password: ", "sk-" + hexes[1][:24])]
    others = ["order (076) 555-8046", "isbn 978 3161 4841", "commit " + hexes[2], "pages 100 200 300", "w" * 30, "7" * 30, "page 12-345-6789"]
    texts = [f"see {before}{span} here" for _, before, span in wanted] + [f"see {t} here" for t in others]
    texts += [f'api token = "{h}" set' for h in hexes[3:]] + ["+1 (555) 555-1234 tel: 030 1234 5678"] * 30
    d = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.found if not s.base] for r in pii.personal_data(d).collect()}
    assert [got[i] for i in range(len(wanted))] == [[(kind, span)] for kind, _, span in wanted]
    assert {t: got[len(wanted) + k] for k, t in enumerate(others)} == dict.fromkeys(others, [])
    assert all(got[len(wanted) + len(others) + k] == [("secret", h)] for k, h in enumerate(hexes[3:]))


def test_pii_reliabilities():
    prior, coins = pii.reliabilities([((1, 1, 1), 80), ((0, 0, None), 100), ((1, 0, 1), 5), ((0, 1, 0), 15)])
    assert pii.belief((1, 1, 1), prior, coins) > 0.95 > 0.05 > pii.belief((0, 0, None), prior, coins)


# Rules


def brute_stats(t):
    t = t or ""
    own = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = defaultdict(list)
    for i in range(len(own) - 2):
        windows[tuple(own[i : i + 3])].append(i)
    again = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again)


def test_quality_rules(spark, docs, empty):
    rng = random.Random(8)
    texts = ["".join(rng.choices(["a b c ", "é# ", "\n", "x|y ", "same line\n", "\x0b", " "], k=rng.randint(0, 60))) for _ in range(100)]
    d = spark.createDataFrame([*enumerate([*texts, None, ""])], "doc_id long, text string")
    rows = {r.doc_id: r for r in quality_rules.quality_rules(d).collect()}
    for i, t in enumerate([*texts, None, ""]):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_stats(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(docs).count() == len(ROWS) and quality_rules.quality_rules(empty).count() == 0


def test_rule_reliabilities():
    silent, bad, good = quality_rules.ABSTAIN, quality_rules.BAD, quality_rules.GOOD
    rng = random.Random(11)
    counts, truth = defaultdict(int), defaultdict(lambda: [0, 0])
    right = [0.97, 0.95, 0.9, 0.5]  # the last rule knows nothing
    for _ in range(20000):
        fine = rng.random() < 0.8
        votes = tuple(silent if rng.random() < 0.2 else (good if (rng.random() < r) == fine else bad) for r in right)
        counts[votes] += 1
        truth[votes][fine] += 1
    prior, chances = quality_rules.expectation_maximisation(sorted(counts.items()), len(right))
    assert abs(prior - 0.8) < 0.02
    for (fine, poor), r in zip(chances, right, strict=True):
        assert abs(fine[good] / (fine[good] + fine[bad]) - r) < 0.03 and abs(poor[bad] / (poor[good] + poor[bad]) - r) < 0.05
    correct = sum(n[int(quality_rules.posterior(v, prior, chances) >= 0.5)] for v, n in truth.items()) / 20000
    assert correct > 0.95 > 0.65 > sum(n[int(bad not in v)] for v, n in truth.items()) / 20000  # all must pass
    assert quality_rules.posterior((good, good, good, bad), prior, chances) > 0.9
    assert quality_rules.expectation_maximisation([], 2)[1] == [quality_rules.EXPECTED] * 2


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test data")
def test_verdicts_beat_all_must_pass(spark):
    folder = "/root/testdata/sf0.1"
    rows = quality_rules.quality_rules(spark.read.parquet(f"{folder}/documents.parquet"))
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality").distinct()
    judged = rows.where("NOT base_failed").join(labels, "doc_id").select("quality", "kept", (F.col("bad_votes") == 0).alias("spotless")).collect()
    share = lambda quality, name: np.mean([r[name] for r in judged if r.quality == quality])
    assert share(1, "kept") > 0.985 > 0.95 > share(1, "spotless") and share(0, "kept") < 0.01
    assert any(r.kept and not r.spotless for r in judged)


def test_shingles_are_exact():
    from lectern.llm import words as W

    joined = b"A b\tc d e f\nx y\n\n" + b"q" * (3 << 20)
    at = np.array([0, 12, 16, 17, len(joined) + 1])
    sets = W.shingles(*W.word_hashes(joined, at))
    assert [len(s) for s in sets] == [2, 1, 0, 1]
    assert hashlib.sha256(W.shingles(*W.word_hashes(b"a B c d e F", np.array([0, 12])))[0].tobytes()).digest() == hashlib.sha256(sets[0].tobytes()).digest()
