from textquarry.operators import browse, media, sync

DOC = "doc_id string, source_path string, sha256 string, size_bytes bigint"


def test_diff(spark):
    old = spark.createDataFrame([("1", "a", "x", 1), ("2", "b", "x", 1), ("3", "c", None, None), ("4", "d", "x", 1)], DOC)
    new = spark.createDataFrame([("1", "a", "x", 1), ("2", "b", "x", 2), ("3", "c", None, None), ("5", "e", "x", 1)], DOC)
    got = {r.source_path: r.status for r in sync.diff(old, new).collect()}
    assert got == {"a": "unchanged", "b": "changed", "c": "changed", "d": "deleted", "e": "new"}
    terms = spark.createDataFrame([("2",)], "doc_id string")
    assert {r.source_path: r.status for r in sync.diff(old, new, terms).collect()}["a"] == "changed"


def test_media_collection(spark):
    m = spark.createDataFrame([("i1", "a"), ("i2", "b"), ("i3", "a")], "local_path string, source_path string")
    docs = spark.createDataFrame([("a",)], "source_path string")
    files = spark.createDataFrame([("i1",), ("i2",), ("i1.ocr.txt",), ("x.png",)], "local_path string")
    stays, gone = media.collect(m, docs, files)
    assert [r.local_path for r in stays.collect()] == ["i1"]
    assert sorted(r.local_path for r in gone.collect()) == ["i2", "x.png"]


def test_selectors(spark):
    docs = spark.createDataFrame([("1", "corpus/É.md", "É"), ("2", "corpus/b_c.md", None)], "doc_id string, source_path string, title string")
    first = lambda s: [r.doc_id for r in browse.resolve(docs, s).collect()]
    assert first("2") == ["2"] and first("B_C") == ["2"] and first("bXc") == [] and first("é") == [] and first("É") == ["1"]
    assert first("") == ["2"] and first("b%c") == ["2"]


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id string, source_type string")
    assert browse.by_type_line(docs).first().by_type == "none"


def test_counters(spark):
    changes = spark.createDataFrame([("a", "new"), ("b", "changed"), ("c", "unchanged"), ("d", "deleted"), ("e", "failed"), ("f", "new")], "source_path string, status string")
    rows = lambda n: spark.range(n)
    got = sync.counters(changes, rows(7), rows(2), rows(3)).first().asDict()
    assert got == {"seen": 5, "indexed": 3, "skipped": 1, "chunks": 7, "deleted": 1, "media_deleted_files": 2, "media_deleted_entries": 3, "failed": 1}
    none = sync.counters(changes.limit(0), rows(0), rows(0), rows(0)).first().asDict()
    assert set(none.values()) == {0} and tuple(none) == sync.COUNTERS
