import re

import pytest
from compare import both
from conftest import SMALL

from textquarry.plans.catalogue import QUERIES, SQL, chunks

INDEX_TOKEN_PY = r"[\w.$/@:#-]+"


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    ours, theirs = both(spark, SMALL, QUERIES[name], SQL[name])
    assert list(ours.columns) == list(theirs.columns)
    assert ours.equals(theirs)


def test_window_snippets(spark):
    """Against brute force: the window of 18 tokens with the most matches, marked."""
    rows = QUERIES["window_snippets"](spark, SMALL).collect()
    assert rows and set(QUERIES) - set(SQL) == {"window_snippets"}
    words = {"session", "key", "loader"}
    texts = {r.chunk_id: r.text for r in chunks(spark, SMALL).collect()}
    rows = [r for r in rows if words & set(map(str.lower, re.findall(INDEX_TOKEN_PY, texts[r.chunk_id])))]  # not by title alone
    assert rows
    for r in rows:
        marked = [w.lower() for w in re.findall(r"\[([^\[\]]+)\]", r.snippet)]
        assert words & set(marked), r.snippet
        assert len(re.findall(INDEX_TOKEN_PY, r.snippet.replace("[", " ").replace("]", " "))) <= 18 + 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, name, tmp_path):
    import pyarrow.parquet as pq

    for t in ("documents", "parsed_documents", "chunks", "indexed_docs", "media"):
        pq.write_table(pq.read_table(f"{SMALL}/{t}.parquet").slice(0, 0), f"{tmp_path}/{t}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() <= (6 if name == "status" else 3)
