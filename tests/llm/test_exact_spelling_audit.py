"""Edge cases and brute force for exact dedup, spelling variants and the filter audit."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lectern.llm import exact_dedup, filter_audit, spelling

LONG = "palavra longa " * 30000
ROWS = [
    (1, "same text", "en"), (2, "same text", "en"), (3, None, None), (4, "", "pt"), (5, LONG, "pt"), (6, LONG, ""), (6, LONG, "pt"), (6, LONG + "x", "en"),
    (None, "same text", None), (None, "of no id", "en"), (None, "of no id", "en"), (7, "x" * 1024, "en"), (8, "x" * 1025, "en"), (9, "x" * 2048, "en"), (10, "x" * 1024, "en"),
    (11, "é" * 512, "en"), (12, "SAME text", "en"), (13, "same text ", "en"), (14, "a\x00b", "en"), (15, "a\x00b", "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, "keep", 1, "A", 2) for r in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string, group_size int, mask string, n int").repartition(3)


# Exact dedup


def brute_groups(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    out = Counter()
    for i, t, *_ in rows:
        ids = [k for k in groups[t or ""] if k is not None]
        keep = max(ids, default=None)
        out[i, t, keep, len(groups[t or ""]), i == keep] += 1
    return out


@pytest.mark.parametrize("address", [F.xxhash64, lambda b: F.xxhash64(b) % 3, lambda b: F.lit(0).cast("long")])
@pytest.mark.parametrize("block", [1024, 7000])
def test_exact_dedup(docs, address, block):
    """Every address may be shared by blocks of different bytes; the groups are the same."""
    got = exact_dedup.exact_dedup(docs, block_bytes=block, address=address)
    assert got.columns == ["doc_id", "text", "lang", "mask", "n", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter((r.doc_id, r.text, r.keep_id, r.group_size, r.kept) for r in got.collect()) == brute_groups(ROWS)
    assert exact_dedup.exact_dedup(docs.where("doc_id < 0")).count() == 0


def test_names_by_brute_force(spark):
    """Texts of a few letters in blocks of two bytes: many levels, odd ends and shared halves."""
    rng = random.Random(1)
    rows = [(i, "".join(rng.choices("ab", k=rng.choice([0, 1, 2, 3, 4, 5, 8, 9, 16, 17])))) for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_dedup.exact_dedup(d, block_bytes=2)
    assert Counter((r.doc_id, r.text, r.keep_id, r.group_size, r.kept) for r in got.collect()) == brute_groups(rows)


def test_no_python_on_the_main_path(docs):
    plan = exact_dedup.exact_dedup(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Spelling variants


def brute_near(words):
    out = defaultdict(set)
    for a, b in itertools.combinations(words, 2):
        short, long = sorted((a, b), key=len)
        if len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1 or len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long))):
            out[a].add(b)
            out[b].add(a)
    return out


def brute_variants(rows, least=7):
    counts = Counter()
    for i, t in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= least
    counts = {w: n for w, n in counts.items() if n >= 2}
    near, forms = brute_near(counts), {}
    for w in counts:
        best = min(near[w], key=lambda o: (-counts[o], o), default=None)
        if best is not None and counts[best] >= 10 * counts[w]:
            forms[w] = best
    out = set()
    for w, n in counts.items():
        root = w
        while root in forms:
            root = forms[root]
        out.add((w, forms.get(w), root, n, len(near[w]), counts.get(forms.get(w))))
    return out


def corpus(seed, alphabet, n_words=150):
    rng = random.Random(seed)
    base = ["".join(rng.choices(alphabet, k=rng.randint(6, 11))) for _ in range(n_words)]
    for w in base[: n_words // 2]:
        k = rng.randrange(len(w))
        base += [w[:k] + w[k + 1 :], w[:k] + rng.choice(alphabet) + w[k:], w[:k] + rng.choice(alphabet) + w[k + 1 :], w[:k] + w[k : k + 1] + w[k:]]
    rows = []
    for i in range(80):
        weights = [1 / (1 + (k * 7919 + seed) % 97) ** 2 for k in range(len(base))]
        rows.append((i, rng.choice([" ", ", ", "\n", "1"]).join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(base, weights, k=200))))
    return rows


@pytest.mark.parametrize(("seed", "alphabet", "part"), [(0, "abcdefgh", 4000), (1, "ab", 4000), (2, "ab", 3), (3, "aé×Àz", 5), (4, "a", 2)])
def test_spelling_variants(spark, seed, alphabet, part):
    """Small parts split down to single places of the edit; the pairs are the same."""
    rows = corpus(seed, alphabet)
    rows = [(i, "".join(c.lower() if c.isascii() else c for c in t) if "À" in alphabet or "é" in alphabet else t) for i, t in rows] + [(None, "leftover Leftover leftovers"), (None, None), (90, ""), (0, rows[0][1])]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(3)
    got = spelling.spelling_variants(d, part=part)
    assert {tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()} == brute_variants(rows)
    assert spelling.spelling_variants(d.where("doc_id < 0")).count() == 0


def test_chain_of_forms(spark):
    words = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000}
    d = spark.createDataFrame(list(words.items()), "word string, n long")
    near = {r.word: (r.n_near, r.form) for r in spelling.near_words(d).collect()}
    assert near == {"abcdefg": (1, "abcdefgh"), "abcdefgh": (2, "abcdefghi"), "abcdefghi": (2, "abcdefghij"), "abcdefghij": (1, "abcdefghi")}
    forms = d.sparkSession.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(11)], "word string, form string")
    assert {r.word: r.root for r in spelling._roots(forms).collect()} == {f"w{k}": "w11" for k in range(11)}


def test_acceptor_is_minimal_and_numbers_its_words():
    rng = random.Random(4)
    words = sorted({"".join(rng.choices("abc", k=rng.randint(0, 6))) for _ in range(200)})
    a = spelling.Acceptor(words)
    assert a.size[a.start] == len(words)
    right = {(f, tuple((label, to) for label, to, _ in arcs)) for f, arcs in zip(a.final, a.arcs, strict=True)}
    assert len(right) == len(a.final)  # no two states have the same right language
    pairs = {frozenset((words[i], words[j])) for i, j in a.near()}
    assert pairs == {frozenset((w, o)) for w, others in brute_near(words).items() for o in others} and len(list(a.near())) == len(pairs)
    long = ["x" * 50_000 + end for end in ("", "a", "b")]
    assert sorted(tuple(sorted(p)) for p in spelling.Acceptor(long).near()) == [(0, 1), (0, 2), (1, 2)]
    assert list(spelling.Acceptor([]).near()) == []


# Filter audit


def brute_audit(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    parts = defaultdict(list)
    for i, t, part in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = "".join(f for f, x in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), re.search(r"[#$%&*|]", t), i is not None and i > first[t]), strict=True) if x)
        parts[part or ""].append((fails, i in good, i in toxic))
    out, shapley = set(), Counter()
    for part, own in parts.items():
        steps = []
        for p in itertools.permutations("ABCDE"):
            for k, f in enumerate(p):
                gone = [x for x in own if f in x[0] and not set(p[:k]) & set(x[0])]
                kept = sum(not set(p[: k + 1]) & set(x[0]) for x in own)
                shapley[part, f] += len(gone)
                steps.append(("".join(p), k + 1, kept, len(gone), sum(f in x[0] and bool(set(p[:k]) & set(x[0])) for x in own), sum(x[0] == f for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone), f))
        out |= {(part, *s[:-1], shapley[part, s[-1]]) for s in steps}
    return out


LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (6, 1, 1), (None, 1, 1), (99, 1, 1), (12, None, 1)]


@pytest.mark.parametrize("address", [F.xxhash64, lambda t: F.xxhash64(t) % 3])
def test_filter_audit(spark, docs, address):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)] + ["#tag", "UPPER"]
    more = [(100 + k, " ".join(rng.choices(words[: rng.choice([20, 300])] + rng.choice([[], words[300:]]), k=rng.choice([50, 199, 200, 400]))), rng.choice(["en", "pt", None])) for k in range(60)]
    more += [(200 + k, more[k % 7][1], "en") for k in range(30)]
    labels = spark.createDataFrame(LABELS + [(100 + k, k % 2, k % 3) for k in range(60)], "doc_id long, quality int, toxic int")
    every = docs.select("doc_id", "text", "lang", "mask", "n").unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string"), allowMissingColumns=True)
    rows = filter_audit.masks(every, address=address)
    got = filter_audit.audit(filter_audit.counted_masks(rows, labels)).collect()
    want = brute_audit(ROWS + more, [tuple(r) for r in labels.collect()])
    assert {tuple(r) for r in got} == want and len(got) == len(want) == 600 * len({r[0] for r in want})


def test_filter_audit_of_nothing(spark, docs):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(docs.where("doc_id < 0"), labels).count() == 0
    assert filter_audit.filter_audit(docs, labels.limit(0)).where("good_lost > 0 or toxic_lost > 0").count() == 0


def test_sketch_counts(spark):
    """Counters of the merged sketch are sums over all parts; a repeated text is never cleared."""
    rows = spark.range(3000).selectExpr("id % 2500 AS h").repartition(5)
    placed = rows.select("h", F.lit(0).cast("long").alias("segment"), F.xxhash64("h", F.lit(2)).alias("g"))
    (counters,) = [bytes(r.counters) for r in filter_audit.sketch(placed).collect()]
    want = Counter()
    for r in placed.collect():
        want.update({(r.g >> (12 * k)) & 4095 for k in range(4)})
    assert {k: n for k, n in enumerate(counters) if n} == want
    flagged = {r.h for r in filter_audit._repeats(rows).collect()}
    assert flagged >= set(range(500)) and len(flagged) < 560
