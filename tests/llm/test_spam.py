import random

from textquarry.llm import spam

SENTENCES = (
    "The loader {} resolves the symbol table before the watchdog thread {} returns to its caller.",
    "After {} retries a hidden parser in build {} still refuses every request without explanation.",
    "Nothing explains why block {} was moved, although our notes of stage {} mention such an error.",
    "Setting breakpoint {} shows how an import list of kind {} is rebuilt while tracing stays off.",
    "Whoever wrote probe {} expected another device, so half of its {} checks never happen here.",
    "It took {} attempts until somebody found that switch {} disables this guard for good.",
)


def prose(rng):
    chosen = rng.sample(SENTENCES, rng.randint(2, 6))
    return "\n".join(x.format(rng.randint(1, 99), rng.choice(["one", "two", "three"])) for x in chosen)


def stuffed(rng):
    name = rng.choice(["brazen apk", "zentor tool"])
    return ", ".join(f"{rng.choice(['best', 'cheap', 'free'])} {name} download" for _ in range(rng.randint(15, 60)))


def links(rng):
    return "\n".join(f"* {rng.choice(['zentor tool', 'brazen'])}\n  https://site{rng.randint(1, 99)}.example/a/b" for _ in range(20))


CLEAN = {
    "notes": "- [Tracing – loader](https://a.example/x) – The loader resolves the symbol table before it returns. It keeps waiting for the next call here.",
    "glossary": "symbol table: The loader resolves the symbol table before it returns to its caller.\n" * 3,
    "code": "\n".join("    invoke-static {v1, v2}, Lcom/a;->go()I" for _ in range(9)),
    "table": "| offset | name |\n| --- | --- |\n" + "| 0x12 | go |\n" * 20,
    "changes": "\n".join(f"- 1.{i}: The loader resolves the symbol table before it returns to its caller." for i in range(5)),
}


def test_views_separate():
    rng = random.Random(1)
    for f in (stuffed, links):
        page = f(rng)
        assert spam.stuffed(page) > 0.6 and spam.features(page)[0] < 0.2
    assert spam.stuffed(prose(rng)) < 0.2 and spam.features(prose(rng))[0] > 0.8
    for name, text in CLEAN.items():
        assert spam.stuffed(text) < 0.4, name


def test_trees_overrule_labels_and_hosts_decide_open_pages(spark):
    rng = random.Random(3)
    pages = [(i, f"h{i % 3}", 0.0, prose(rng)) for i in range(150)] + [(200 + i, f"h{i % 3}", 0.9, links(rng)) for i in range(80)]
    pages += [(300, "h0", 0.0, links(rng)), (301, "h1", 0.9, prose(rng))]  # labelled wrongly
    df = spark.createDataFrame([(k, h, w, *spam.features(t)) for k, h, w, t in pages], ["key", "host", "stuffed", *spam.FEATURES])
    got = {r.key: r.p for r in spam.scores(df).collect()}
    assert got[300] > 0.5 > got[301]


def test_held_out_pages(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng), "good", 0) for i in range(120)] + [(200 + i, rng.choice([stuffed, links])(rng), "bad", 1) for i in range(60)]
    rows += [(400 + i, t, "good", 0) for i, t in enumerate(6 * [*CLEAN.values()])]
    rows += [(500, None, "good", 0), (501, "  ", None, 0), (502, stuffed(rng), None, 1), (503, prose(rng) + "\n" + stuffed(rng)[:60], "bad", 0)]
    rows.append(rows[130])
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, p int")
    got = {r.key for r in spam.spam_pages(df.withColumnRenamed("p", "label")).collect()}
    assert got == {r[0] for r in rows if r[3]}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert spam.spam_pages(df).count() == 0
    one = spark.createDataFrame([(1, "the loader waits.", "a")], df.schema)
    assert spam.spam_pages(one).count() == 0
