"""How often the query of scanned pages handles each line, and that its cheaper forms find what they must."""

import random
import re

from conftest import SMALL
from textquarry.llm import scans

P = "doc_id string, source_type string, title string, text string, metadata struct<page_count: int>"
M = "local_path string, title string, ocr_text string"


def test_records_are_shuffled_once_and_windows_are_few(spark):
    parsed, media = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("parsed_documents", "media"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = scans.page_lines(scans.records(parsed, media), scans._titles(parsed, media))
        assert any(r.furniture for r in lines.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = lines._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert len(re.findall(r"\bWindow \[", plan)) <= 4
    assert "ReusedExchange" in plan


def test_edges():
    long = "a line of the body that is no edge"
    body = [f"{long} {i}" for i in range(9)]
    assert scans.edges("\n".join(body)) == [(i, body[i]) for i in (0, 1, 7, 8)]
    assert [i for i, _ in scans.edges("\n".join([*body[:4], "", *body[4:]]))] == [0, 1, 2, 3, 5, 6, 8, 9]
    assert [i for i, _ in scans.edges("\n".join([*body[:4], f"\f{body[4]}", *body[5:]]))] == [0, 1, 2, 3, 4, 5, 6, 7, 8]
    assert scans.edges("") == [] and scans.edges("\n\n") == [] and scans.edges("abc\n" + "x" * 71) == []
    assert scans.edges(" \tabcd\r") == [(0, "abcd")]


def test_impossible_words(spark):
    bad = ["at Ox1f", "in 2O44 steps", "at l00", "re5olve it", "wi!l do", "!s it", "a † b", "f@st", "@nd so"]
    good = ["Oxford", "0x1f", "in 2044 steps", "wait! now", "Stop!", "mail me@host.org", "utf8", "abc5", "x5a", "a5b", "1re5olve"]
    rows = spark.createDataFrame([(s,) for s in bad + good], "s string")
    assert {r.s for r in rows.where(scans.impossible(rows.s)).collect()} == set(bad)


def test_words_of_a_line_by_any_pattern():
    random.seed(1)
    for _ in range(3000):
        s = "".join(random.choice("aB 7|@†!é 签я.") for _ in range(random.randint(0, 15)))
        inner = scans._ASCII_ENDS.sub(" ", s) if "签" in s else s
        want = [w for run in scans._WORDS.findall(inner) for w in scans._split[run]]
        assert scans.words_in(s)[1] == want
    assert scans.words_in("self-made loader and a sym-") == ({"self-made": None}, ["self", "made", "loader", "and", "a"])


def test_numbers_of_shifted_lines(spark):
    """Lines before and after the first and last two of a record, which the windows code as one number."""
    texts = ["one", "one\ntwo", "- 1 -", "- 1 -\n- 2 -\nbody text", "a\n\nb\n\n\nc", "\fa\nb\fc\n\n- 3 -", "\n\n  \t\n"]
    parsed = spark.createDataFrame([(str(i), "pdf", None, t, None) for i, t in enumerate(texts)], P)
    got = {
        (int(r.rec_key), r.line_no): (r.blank_before, r.furniture)
        for r in scans.page_lines(scans.records(parsed, spark.createDataFrame([], M)), parsed.select("title")).collect()
    }
    assert {k for k, (blank, _) in got.items() if blank} == {(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (4, 2), (4, 5), (5, 0), (5, 3)}
    furniture = {k for k, (_, f) in got.items() if f}
    assert furniture >= {(2, 0), (3, 0), (3, 1), (5, 3)} and not any(record in (0, 1, 6) for record, _ in furniture)
