from textquarry.llm import scans

P = "doc_id string, source_type string, title string, text string, metadata struct<page_count: int>, s string, word string"
M = "local_path string, title string, ocr_text string, id int"
WORDS = "whenever the loader resolves the library nothing happens and the symbol resolver keeps waiting for nothing"


def body(n, odd="", w="first"):
    return "\n".join([f"the {w} library forwards nothing to the symbol resolver when-", f"ever the loader resolves the library {odd}"] * n)


def tables(spark):
    page = lambda k: f"Reading – loader / table\n{body(4, w="first second third fourth".split()[k])}\nself-\nmodifying blocks are self-modifying by name.\n— {k} —"
    scan = "\n\n".join(page(k) for k in (1, 2, 3))
    noisy = "the 1ibrary forwards notliing to the loader\nin 2O44 steps.\nPage 7O of lO"
    rows = [("a", scan), ("a", scan), ("b", "\n".join([WORDS] * 12)), ("n", noisy), ("null", None), ("blank", " \n ")]
    parsed = spark.createDataFrame([(k, "pdf", None, t, (3,), "x", "y") for k, t in rows] + [("h", "html", None, "- 1 -", None, "", "")], P)
    media = spark.createDataFrame([("i1", None, "PATCHING\n" + body(3), 1), ("i2", None, None, 2)], M)
    return parsed, media


def test_cases(spark):
    got = {(r.tbl, r.rec_key, r.line_no, r.kind) for r in scans.noise_cases(*tables(spark)).collect()}
    a = {(n, k) for t, key, n, k in got if key == "a"}
    size = 13
    for p in range(3):
        top = p * size
        assert (top, "furniture") in a and (top + 11, "furniture") in a
        assert {(top + 1 + 2 * i, "broken") for i in range(4)} <= a
        assert (top + 9, "broken") not in a  # split at its own hyphen
    n = {(x, k) for t, key, x, k in got if key == "n"}
    assert n == {(0, "misread"), (1, "misread"), (2, "furniture")}
    assert ("media", "i1", 0, "furniture") in got
    assert not {x for x in got if x[1] in ("b", "null", "blank", "h", "i2")}


def test_text(spark):
    got = {(r.tbl, r.rec_key): r.text for r in scans.repaired_text(*tables(spark)).collect()}
    assert got["parsed_documents", "n"].startswith("the library forwards nothing to the loader in 2O44 steps.")
    assert "whenever the loader" in got["parsed_documents", "a"] and "Reading" not in got["parsed_documents", "a"]
    assert got["parsed_documents", "blank"] == ""


def test_empty(spark):
    parsed, media = tables(spark)
    assert scans.noise_cases(parsed.limit(0), media.limit(0)).count() == 0


def test_long_record(spark):
    parsed, media = tables(spark)
    long = spark.createDataFrame([("l", "pdf", None, "\n".join([WORDS] * 20_000), None, "", "")], P)
    assert scans.noise_cases(long, media.limit(0)).count() == 0


def test_forms_need_the_support_of_their_context(spark):
    lines = ["here this modern loader resolves the library and waits for more."] * 40
    lines[5], lines[9] = "here a modem dials the library and waits for more of it.", "here this modem loader resolves the library and waits."
    parsed = spark.createDataFrame([("a", "pdf", None, "\n".join(lines), (1,), "", "")], P)
    got = {(r.line_no, r.kind) for r in scans.noise_cases(parsed, tables(spark)[1].limit(0)).collect()}
    assert got == {(9, "misread")}


def test_headers_made_of_parts_of_titles(spark):
    text = "Mapping – header builder / loader 3.1\n" + "\n".join([WORDS + "."] * 6)
    titles = ["Mapping – call stub / string pool", "Tracing – header builder / root probe", "Unpacking: loader (libzen.so)"]
    rows = [("a", "pdf", "Other", text, (1,), "", "")] + [(f"t{i}", "html", t, "", (1,), "", "") for i, t in enumerate(titles)]
    empty = tables(spark)[1].limit(0)
    cases = lambda n: {(r.line_no, r.kind) for r in scans.noise_cases(spark.createDataFrame(rows[:n], P), empty).collect()}
    assert cases(4) == {(0, "furniture")} and cases(1) <= {(0, "furniture")}
