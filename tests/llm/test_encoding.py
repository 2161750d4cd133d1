from collections import Counter

import pytest
from pyspark.sql import functions as F

from textquarry.llm import encoding as en

DOCS = {
    "en": "The loader – at least here – resolves the symbol table. It’s safe to skip the naïve pool. © 2021 site. All rights reserved.",
    "de": "Die Gerätekennung prüft zuerst die Rücksprungadresse und überschreibt dann die Größenangabe der Schlüsselableitung.",
    "fr": "La clé de session chiffrée décompresse la mémoire tampon après l’évènement. La constante ÂGE_MAX limite la pile.",
    "zh": "注入脚本会在返回之前直接比较过期的方法缓存。这个签名校验看起来是冗余的，其实会偶尔跟踪它。",
    "ru": "Обработчик исключений возвращает адрес возврата и очищает буфер трассировки. Модуль отчётов скрыт.",
}


@pytest.fixture(scope="module")
def lengths():
    return en.Lengths({k: "\n".join([*v.split("。"), v]).encode() for k, v in DOCS.items()})


@pytest.mark.parametrize("wrong,right", [("cp1252", "utf-8"), ("gb18030", "utf-8"), ("latin-1", "utf-8")])
@pytest.mark.parametrize("lang", sorted(DOCS))
def test_round_trip(lengths, lang, wrong, right):
    try:
        garbled = DOCS[lang].encode(right).decode(wrong)
    except UnicodeDecodeError:
        pytest.skip("these bytes have no such reading")
    assert en.repair_line(garbled, lengths) == (DOCS[lang], True)


def test_twice_and_gbk(lengths):
    twice = DOCS["de"].encode().decode("cp1252").encode().decode("cp1252", "replace")
    if "�" not in twice:
        assert en.repair_line(twice, lengths)[0] == DOCS["de"]
    assert en.repair_line(DOCS["zh"].encode("gb18030").decode("latin-1"), lengths) == (DOCS["zh"], True)


@pytest.mark.parametrize("lang", sorted(DOCS))
def test_right_text_stays(lengths, lang):
    assert en.repair_line(DOCS[lang], lengths) == (DOCS[lang], False)


def test_losses(lengths):
    assert en.repair_line("The loader 鈥� at least here", lengths) == ("The loader – at least here", True)
    assert en.repair_line("�ndern", lengths) == ("�ndern", True)
    assert en.repair_line("锟斤拷锟斤拷", lengths)[1]


@pytest.mark.parametrize("wrong", ["mac_roman", "cp437", "cp850", "cp866"])
@pytest.mark.parametrize("lang", sorted(DOCS))
def test_older_code_pages(lengths, lang, wrong):
    assert en.repair_line(DOCS[lang].encode().decode(wrong), lengths) == (DOCS[lang], True)


def test_big5(lengths):
    garbled = DOCS["zh"].encode().decode("big5", "replace")
    fixed, found = en.repair_line(garbled, lengths)
    assert found and "注" not in garbled and fixed[0] == "注" and "个签" in fixed


def test_accents_read_as_ideographs(lengths):
    garbled = "Die Gerätekennung prüft".encode("cp1252").decode("gb18030")
    assert en.repair_line(garbled, lengths) == ("Die Gerätekennung prüft", True)


@pytest.mark.parametrize("right", ["d’émulateur.", "раз", "“Übung", "сам"])
def test_valid_by_chance(lengths, right):
    assert en.repair_line(right, lengths) == (right, False)


def test_tables(spark):
    rows = [("a", "x\n" + DOCS["de"].encode().decode("cp1252") + "\ny", 1), ("b", None, 1), ("c", "", 1), ("d", "plain", 1), ("e", DOCS["ru"], 1), ("e", DOCS["ru"], 1)]
    df = spark.createDataFrame(rows, "id string, text string, key int")
    labelled = spark.createDataFrame([(str(i), v, k) for i, (k, v) in enumerate(DOCS.items())], "key string, text string, lang string")
    dictionaries = en.train(labelled)
    assert sorted(dictionaries) == sorted(DOCS)
    assert [r.key for r in en.garbled_cases(df, "id", "text", dictionaries).collect()] == ["a"]
    out = {r.key: (r.text, r.garbled) for r in en.repair(df, "id", "text", dictionaries).collect()}
    assert out["a"] == ("x\n" + DOCS["de"] + "\ny", 1) and out["b"] == (None, 0) and out["c"] == ("", 0)
    assert en.train(labelled.limit(0)) == {}
    assert en.repair(df.limit(0), "id", "text", {}).count() == 0


def test_cyrillic_code_pages(lengths):
    for wrong, right in (("cp1251", "koi8-r"), ("koi8-r", "cp1251")):
        garbled = DOCS["ru"].encode(right).decode(wrong)
        assert en.repair_line(garbled, lengths) == (DOCS["ru"], True)
    assert en.repair_line(DOCS["zh"].encode("gb18030").decode("cp1251", "replace"), lengths)[1]


def test_span_beside_other_characters(lengths):
    span = "Die Gerätekennung".encode().decode("cp1252")
    assert en.repair_line(f"Обработчик исключений: {span}", lengths) == ("Обработчик исключений: Die Gerätekennung", True)


def test_many_losses_are_each_completed(lengths):
    garbled = (DOCS["ru"] * 8).encode().decode("cp1252", "replace")
    fixed, found = en.repair_line(garbled, lengths)
    assert found and garbled.count("\ufffd") > 24 and fixed.count("\ufffd") < garbled.count("\ufffd") / 2


def test_dictionaries_count_all_rows(spark):
    often = [f"line {i:03d} of two rows, which stands in no other one" for i in range(100)]
    rows = [(str(i), f"this is the only row with the number {i:05d} in it\n{often[i % 100] if i < 200 else ''}", "en") for i in range(7000)]
    got = en.train(spark.createDataFrame(rows, "key string, text string, lang string"))
    assert set(often) <= set(got["en"].decode().split("\n"))


@pytest.mark.parametrize("size", [600, 4000])
def test_dictionaries_against_plain_counts(spark, monkeypatch, size):
    monkeypatch.setattr(en, "DICTIONARY_BYTES", size)
    unclean = [f"{DOCS['de'][k:]} {k}".encode().decode("cp1252") for k in range(40)] * 30
    known = [(f"{lang} {k % 50} {'x' * (k % 7 * 30)} {v[k % 40 :]}", lang) for lang, v in DOCS.items() for k in range(300)]
    known += [(x, "de") for x in unclean] + [(None, "de"), (DOCS["fr"], None), (DOCS["fr"], "und")]
    free = [f"{k % 60} {'y' * (k % 5 * 40)} {v[k % 30 :]}" for v in DOCS.values() for k in range(200)] + [t for t, _ in known[:500]] + unclean
    labelled = spark.createDataFrame([(str(i), t, x) for i, (t, x) in enumerate(known)], "key string, text string, lang string")
    unlabelled = spark.createDataFrame([(str(i), t) for i, t in enumerate(free)], "key string, text string")
    n = Counter((x, t) for t, x in known if t and x and x != "und")
    alone = Counter(free)
    texts = {t for _, t in n}
    order = {r.line: r.h for r in spark.createDataFrame([(t,) for t in {*texts, *alone}], "line string").select("line", F.xxhash64("line").alias("h")).collect()}

    def chosen(counts):
        out = {}
        for lang in {x for x, _ in counts}:
            for short in (True, False):
                at = 0
                for (_, t), _k in sorted(((k, v) for k, v in counts.items() if k[0] == lang and (len(k[1]) <= 100) == short), key=lambda x: (-x[1], order[x[0][1]])):
                    if at < size // 2:
                        out.setdefault(lang, set()).add(t)
                    at += len(t.encode()) + 1
        return out

    def lines(dictionaries):
        return {k: set(v.decode().split("\n")[:-1]) for k, v in dictionaries.items()}

    assert lines(en.train(labelled)) == chosen(Counter({k: v for k, v in n.items() if en._clean(k[1])}))
    n = Counter({k: v + alone[k[1]] for k, v in n.items() if en._clean(k[1])})
    got = en.train(labelled, unlabelled)
    by = {k: en._compressor(v, en.TAG_LEVEL) for k, v in _first(spark, labelled, unlabelled).items()}
    for t, v in alone.items():
        if t not in texts and en._clean(t):
            n[min(by, key=lambda k: len(by[k].compress(t.encode()))), t] = v
    assert lines(got) == chosen(n)


def _first(spark, labelled, unlabelled):
    """The dictionaries that lines without label are told by: those of the labelled lines, counted in all rows."""
    texts = labelled.where("lang <> 'und'").select("text").distinct()
    return en.train(labelled, unlabelled.join(texts, "text", "left_semi").select("key", "text"))
