"""The index, its scores and its snippets against SQLite's full-text search."""

import sqlite3

import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from textquarry.functions import text as tx
from textquarry.operators import index, search
from textquarry.plans.catalogue import chunks


@pytest.fixture(scope="module")
def rows(spark):
    return chunks(spark, SMALL).toPandas()


@pytest.fixture(scope="module")
def lite(rows):
    con = sqlite3.connect(":memory:")
    try:
        con.execute("create virtual table f using fts5(chunk_id unindexed, title, section, text, tokenize=\"unicode61 tokenchars '_.$/@:#-'\")")
    except sqlite3.OperationalError:
        pytest.skip("this SQLite has no full-text search")
    latin = rows[["chunk_id", "title", "section", "text"]].fillna("")
    con.executemany("insert into f values (?, ?, ?, ?)", latin.itertuples(index=False, name=None))
    return con


@pytest.mark.parametrize("query,mode", [("session key loader", "any"), ("session key", "all"), ("string pool pool", "any")])
def test_scores(spark, lite, query, mode):
    match = (" OR " if mode == "any" else " ").join(f'"{t}"' for t in tx.query_tokens(query))
    theirs = {c: round(s, 6) for c, s in lite.execute("select chunk_id, bm25(f) from f where f match ?", (match,))}
    c = chunks(spark, SMALL)
    ours = {r["chunk_id"]: r["score"] for r in search.bm25(c, query, mode, top_k=-1).collect()}
    assert ours.keys() == theirs.keys() and len(ours) > 5
    assert max(abs(ours[k] - theirs[k]) for k in ours) < 1e-4
    stored = search.bm25_postings(index.postings(c), index.lengths(c), c, query, mode, top_k=-1)
    assert {r["chunk_id"]: r["score"] for r in stored.collect()} == pytest.approx(ours)


def test_snippets(lite, rows):
    query = "session key"
    theirs = dict(lite.execute("select chunk_id, snippet(f, 3, '[', ']', '...', 18) from f where f match '\"session\" OR \"key\"'"))
    texts = dict(zip(rows.chunk_id, rows.text, strict=True))
    same = [search.window_snippet(texts[k], query.split()) == v for k, v in theirs.items()]
    assert sum(same) >= 0.97 * len(same) and len(same) > 5


def test_limits_and_types(spark):
    c = chunks(spark, SMALL)
    assert search.bm25(c, "session key", top_k=0).count() == 5
    assert search.bm25(c, "session key", top_k=3).count() == 3
    assert search.bm25(c, "", top_k=3).count() == 0
    assert {r.source_type for r in search.bm25(c, "session key", source_type="html", top_k=-1).collect()} <= {"html"}


def test_stages_do_not_overlap(spark):
    c = chunks(spark, SMALL)
    found = search.staged_search(c, index.terms(c), "签名校验", top_k=50).collect()
    ids = [r.chunk_id for r in found]
    assert len(ids) == len(set(ids)) and [r.stage for r in found] == sorted(r.stage for r in found)
    assert {r.stage for r in search.staged_search(c, index.terms(c), "session", top_k=50).collect()} == {1}


def test_lenient_groups(spark):
    df = spark.createDataFrame([("a", "设备"), ("b", "设备"), ("b", "指纹")], "chunk_id string, term string")
    assert {r.chunk_id for r in search.term_matches(df, "设备 没有", "all").collect()} == {"a", "b"}
    assert {r.chunk_id for r in search.term_matches(df, "设备 指纹", "all").collect()} == {"b"}


def test_neighbours(spark):
    rows = [(f"c{i}", "d", i) for i in range(5)]
    c = spark.createDataFrame(rows, "chunk_id string, doc_id string, chunk_index bigint")
    got = search.neighbours(c, c.where("chunk_id = 'c1'"), 2).collect()
    assert sorted((r.chunk_id, r.distance) for r in got) == [("c0", -1), ("c2", 1), ("c3", 2)]
    assert search.neighbours(c, c, 0).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="设备指纹风控", min_size=1, max_size=9))
def test_grams(run):
    grams = tx.han_grams(run)
    assert run in grams and grams == sorted(set(grams))
    assert all(len(g) in (2, 3, 4) or g == run for g in grams)


def test_terms_expression(spark):
    df = spark.createDataFrame([("Foo-1 a 设备指纹识别 X", None), ("", "")], "a string, b string")
    got = df.select(tx.chunk_terms([df.a, df.b], 8000).alias("t")).collect()
    assert got[0].t == sorted(["foo-1", *tx.han_grams("设备指纹识别")]) and got[1].t == []
    assert len(df.select(tx.chunk_terms([df.a, df.b], 3).alias("t")).first().t) == 3
