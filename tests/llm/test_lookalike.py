from textquarry.llm import lookalike as lk

SCHEMA = "id string, title string, text string, word string, key int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "w", 1) for r in rows], SCHEMA)


def cases(spark, rows):
    found = lk.lookalike_cases(table(spark, rows), "id", ["title", "text"])
    return sorted((r.key, r.fld) for r in found.collect())


def test_each_kind(spark):
    rows = [
        ("full", None, "an ｏｐｃｏｄｅ table"),
        ("mark", "Résolution", ""),
        ("zero", None, "zero​width"),
        ("nbsp", "a b", "c d"),
        ("other", None, "ѕуmbоl resolver"),
        ("latin", None, "мoдуль отчётов"),
        ("fine", "Résolution “x” – y", "модуль не со а о у α ≥ β x̄ 10⁻³ ½ ①② 👩‍💻 🏳️‍🌈 「加载器」，中文（x）"),
        ("none", None, None),
        ("blank", "", "   "),
    ]
    assert cases(spark, rows) == [
        ("full", "text"), ("latin", "text"), ("mark", "title"), ("nbsp", "text"), ("nbsp", "title"), ("other", "text"), ("zero", "text"),
    ]


def test_canonical_text(spark):
    rows = [("a", "Résolution x", "ｌoad ѕуmbоl мoдуль zero​width 👩‍💻"), ("b", None, "plain"), ("b", None, "plain")]
    got = lk.canonical_text(table(spark, rows), "id", ["title", "text"])
    assert got.columns == ["id", "title", "text", "word", "key"]
    out = sorted(((r.id, r.title, r.text) for r in got.collect()), key=str)
    assert out == [("a", "Résolution x", "load symbol модуль zerowidth 👩‍💻"), ("b", None, "plain"), ("b", None, "plain")]


def test_frequent_member_wins_and_case_stays(spark):
    rows = [(str(i), None, "Ａblauf") for i in range(2)] + [("x", None, "Ablauf ABLAUF ａblauf")]
    out = {r.id: r.text for r in lk.canonical_text(table(spark, rows), "id", ["title", "text"]).collect()}
    assert out == {"0": "Ablauf", "1": "Ablauf", "x": "Ablauf ABLAUF ablauf"}


def test_long_and_repeated(spark):
    text = "wоrd " * 40_000
    assert cases(spark, [("a", None, text), ("a", None, text)]) == [("a", "text")]
    assert cases(spark, []) == []
