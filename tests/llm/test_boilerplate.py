from textquarry.llm import boilerplate as bp

SCHEMA = "doc_id string, source_path string, source_type string, text string, key string, seen int"
NAMES = ("loader", "parser", "probe", "guard", "cache", "queue")
BODY = "Once the {w} number {i} has finished, register x{i} no longer points to the symbol table but to a {w} thread."
PAGE = """This site stores cookies for statistics and comfort.
Accept all
[Home](/a) [Wiki](/b)

# Title of the {w}

{body}
- Item {i} of the list says that the {w} slot is rebuilt by hand.
| a | b |
| --- | --- |
```text
short
```
[Image 1: x] path=a.png
Also read: Other page on the {w}

## References
- Some page on the {w} (https://other.example/x)

### Related articles
- Mapping: method {w} {i}
2024-11 (10)
Sign up for free and join {i} readers.
© 2024 site.test. All rights reserved."""
KEPT = {4, 6, 7, 8, 9, 10, 11, 12, 13, 16, 17}


def pages(spark, n):
    rows = [(f"d{i}", f"corpus/html/site-test/{i}.html", "html", PAGE.format(i=i, w=NAMES[i], body=BODY.format(i=i, w=NAMES[i])), "k", 1) for i in range(n)]
    return spark.createDataFrame([*rows, ("n", "corpus/html/x-test/n.html", "html", None, "k", 1), ("e", None, "html", "", "k", 1), rows[0]], SCHEMA)


def test_furniture(spark):
    got = {}
    for r in bp.furniture_lines(pages(spark, 6)).collect():
        got.setdefault(r.key, []).append(r.line_no)
    lines = PAGE.split("\n")
    want = sorted(i for i, x in enumerate(lines) if x.strip() and i not in KEPT)
    assert set(got) == {f"d{i}" for i in range(6)}
    assert all(sorted(v) == want for v in got.values())


def test_templates_do_not_depend_on_other_sites(spark):
    rows = [(f"d{i}", "own line", "a.test") for i in range(5)]
    rows += [(f"s{i}", "shared line", f"{i}.test") for i in range(12)] + [("x", "single line", "b.test")]
    got = []
    for more in (0, 40):
        other = [(f"o{i}", f"body {'xyz'[i % 3] * i} of another site", f"{i}.other") for i in range(more)]
        df = spark.createDataFrame(rows + other, "key string, text string, host string")
        got.append(sorted(map(tuple, bp.template_lines(df).drop("h").collect())))
    assert got[0] == got[1] and ("a.test", 5.0) in got[0] and ("0.test", 3.0) in got[0] and len(got[0]) == 13


def test_main_text(spark):
    got = {r.key: r.text for r in bp.main_text(pages(spark, 6)).collect()}
    assert got["d1"].startswith("# Title of the parser\n\nOnce the parser") and "cookies" not in got["d1"] and got["e"] == ""


def test_no_heading_and_empty(spark):
    df = spark.createDataFrame([("a", None, "html", "x\n\n" + BODY.format(i=1, w="loader") + "\nMenu", "k", 1)], SCHEMA)
    assert [r.line_no for r in bp.furniture_lines(df).collect()] == [0, 3]
    assert bp.furniture_lines(df.limit(0)).count() == 0


def events_of(line):
    e = bp.Events()
    e.feed(bp.markup(line, "own.test", False))
    return e.text, e.linked, e.tags, e.block


def test_events():
    assert events_of("See [Wiki](/wiki) and more of it.") == (18, 0, 1, "")
    assert events_of("plain & simple <b.") == (18, 0, 0, "")
    assert events_of("Menu") == (0, 0, 1, "") and events_of("- Menu") == (0, 4, 2, "")
    assert events_of("- A page (https://other.test/x)")[3] == "cite" and events_of("- A page (https://own.test/x)")[3] == ""
    assert events_of("## Part")[3] == "h2" and events_of("| a | b |")[3] == "td" and events_of("[Image 1: x] path=a.png")[3] == "img"


def test_clusters_decide():
    lines = PAGE.format(i=1, w="loader", body=BODY.format(i=1, w="loader")).split("\n")
    at = [i for i, x in enumerate(lines) if x.strip()]
    smooth = bp._smooth(bp.line_ratios([lines[i] for i in at], [1.0] * len(at), "site.test"))
    kept = bp.main_lines(lines, [1.0] * len(lines), "site.test")
    assert [kept[i] for i in at] == (smooth > bp._threshold(smooth)).tolist() and sum(kept) >= len(KEPT) - 1
