"""Every registered query of the library against its SQL on DuckDB, at the smallest scale."""

import os

import pytest

from lectern import plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(float(v)) if hasattr(v, "as_tuple") else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", [n for n, (_, sql) in plans.QUERIES.items() if sql])
def test_query(spark, name):
    import duckdb

    query, sql = plans.QUERIES[name]
    db = duckdb.connect()
    db.execute("SET timezone = 'UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = query(spark, DATA)
    columns = sorted(found.columns)
    want = db.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    rows = sorted([plain(r[names.index(c)]) for c in columns] for r in want.fetchall())
    assert sorted([plain(v) for v in r] for r in found.select(*columns).collect()) == rows


def test_budget_pieces(spark):
    """Pieces put together again are the sentences; only a word of its own is over the limit; English isn't cut."""
    texts = {}
    for r in plans.QUERIES["budget_split"][0](spark, DATA).orderBy("doc", "paragraph", "sentence", "piece_no").collect():
        texts.setdefault((r.doc, r.paragraph, r.sentence, r.text, r.code), []).append(r.piece)
    assert {k[4] for k in texts} == {"a", "e"}
    for (_, _, _, text, code), pieces in texts.items():
        assert "".join(pieces).replace(" ", "") == text.replace(" ", "")
        assert pieces == [text] if code == "a" or len(text) <= 50 else all(len(p) <= 50 or " " not in p for p in pieces) and len(pieces) > 1
