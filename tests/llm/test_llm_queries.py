import pytest
from compare import both
from conftest import SMALL

from textquarry.llm.queries import QUERIES, SQL

TEXTS = {"source_targets", "container_specs", "documents", "parsed_documents", "chunks", "media"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    ours, theirs = both(spark, SMALL, QUERIES[name], SQL[name])
    assert list(ours.columns) == list(theirs.columns) and ours.equals(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_distinct_rows(spark, name):
    rows = QUERIES[name](spark, SMALL)
    if name.endswith("_found"):
        got = rows.collect()
        assert len(got) == len(set(got))
    else:
        assert rows.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, name, tmp_path):
    import pyarrow.parquet as pq

    for t in TEXTS:
        rows = pq.read_table(f"{SMALL}/{t}.parquet")
        pq.write_table(rows if t in ("source_targets", "container_specs") else rows.slice(0, 0), f"{tmp_path}/{t}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() in (0, 23)
