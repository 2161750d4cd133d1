"""Problem 2: text that looks the same but is stored with different characters.

Words are mapped to a look-alike form (full width to ASCII, letters of other alphabets to the
letter they look like, invisible characters dropped, no-break spaces to a space). All words whose
look-alike form is equal *under the accent-sensitive UNICODE collation* make one class: the
collation takes a composed letter and the letter plus combining accents for equal, but keeps
``e`` and ``é``, ``a`` and ``A`` apart. In each class one member is chosen as canonical - the most
frequent member that is right as it stands, else the composed look-alike form - and joined back.

Which alphabet a word belongs to is part of the class, so Russian words made of letters that also
exist in Latin stay Russian: letters that exist in one alphabet only decide; a word without such a
letter follows the rest of its value.

Defined results: a null value stays null and an empty one empty; a value without any non-ASCII
word passes through untouched; repeated rows stay repeated in :func:`canonical_text` and count
once in :func:`lookalike_cases`. Extra columns are carried along by :func:`canonical_text`.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.llm.common import store

# Letters of other alphabets and the Latin letter each looks like.
CYRILLIC_LIKE = "асԁеһіјӏорԛѕуѵԝхАВЕНІЈКМОРЅТУХԌҮѴԜ"
CYRILLIC_AS = "acdehijlopqsyvwxABEHIJKMOPSTYXGYVW"
GREEK_LIKE = "ονρικυαΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
GREEK_AS = "ovpikuaABEZHIKMNOPTYX"
# The letters of the Russian alphabet that have a Latin twin, for the way back.
LATIN_LIKE = "aceopxyABCEHKMOPTXY"
LATIN_AS_CYRILLIC = "асеорхуАВСЕНКМОРТХУ"
# Invisible characters, and spaces that forbid a line break.
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff"
NO_BREAK = "\u00a0\u2007\u202f"
FULL = "".join(chr(0xFEE0 + c) for c in [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)])
FULL_AS = "".join(chr(ord(c) - 0xFEE0) for c in FULL)

_EMOJI = r"\x{1F000}-\x{1FAFF}\x{2190}-\x{2BFF}\x{FE0F}"
#: a zero-width joiner between two emoji belongs to them, so such sequences are taken first
WORD = (
    rf"[{_EMOJI}](?:‍?[{_EMOJI}])+"
    rf"|[\p{{IsLatin}}\p{{IsGreek}}\p{{IsCyrillic}}\p{{M}}\p{{Nd}}{ZERO_WIDTH}]+|[{NO_BREAK}]"
)
#: any character that can make a word a variant
_ANY = rf"[Ͱ-ԯ０-９Ａ-Ｚａ-ｚ{ZERO_WIDTH}{NO_BREAK}]|\p{{M}}"
_GAP = rf"(?:{WORD})|(?s:.)"


def _drop(c: Column, chars: str) -> Column:
    return F.translate(c, chars, "")


def _plain(word: Column) -> Column:
    """Full width to ASCII, no-break space to space, without invisible characters."""
    return _drop(F.translate(word, FULL + NO_BREAK, FULL_AS + " " * len(NO_BREAK)), ZERO_WIDTH)


def _skeleton(word: Column) -> Column:
    return F.translate(_plain(word), CYRILLIC_LIKE + GREEK_LIKE, CYRILLIC_AS + GREEK_AS)


def _only(word: Column, script: str, twins: str) -> Column:
    """Whether a letter of ``script`` occurs that no other alphabet has."""
    return _drop(word, twins).rlike(rf"\p{{Is{script}}}")


def _script(word: Column, russian_value: Column) -> Column:
    """Alphabet of a word: L, C or G; N where it has no letters."""
    w = _plain(word)
    latin, cyrillic, greek = (w.rlike(rf"\p{{Is{s}}}") for s in ("Latin", "Cyrillic", "Greek"))
    one = latin.cast("int") + cyrillic.cast("int") + greek.cast("int")
    return (
        F.when(one == 0, "N")
        .when((one == 1) & latin, "L")
        .when((one == 1) & greek, F.when(F.char_length(w) <= 1, "G").when(_only(w, "Greek", GREEK_LIKE), "G").otherwise("L"))
        .when(_only(w, "Latin", LATIN_LIKE) & ~_only(w, "Cyrillic", CYRILLIC_LIKE), "L")
        .when(_only(w, "Cyrillic", CYRILLIC_LIKE), "C")
        .when(_only(w, "Greek", GREEK_LIKE) & ~latin, "G")
        .when(cyrillic & russian_value & ~w.rlike("[ԁһіјӏԛѕѵԝІЈЅԌҮѴԜ]"), "C")
        .otherwise("L")
    )


@F.pandas_udf(T.StringType())
def _compose(words: pd.Series) -> pd.Series:
    return words.map(lambda w: w if w is None else unicodedata.normalize("NFC", w))


def values(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, fld, val) of all non-null values that hold a character worth looking at."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("fld"), F.col(f).alias("val")) for f in fields)))
    return (
        df.select(F.col(key).alias("key"), each.alias("v"))
        .select("key", "v.fld", "v.val")
        .where(F.col("val").rlike(_ANY))
    )


def words(vals: DataFrame) -> DataFrame:
    """(key, fld, word, script): the distinct words of each value that are not plain ASCII."""
    found = F.filter(
        F.array_distinct(F.regexp_extract_all("val", F.lit(WORD), F.lit(0))), lambda w: w.rlike(r"[^\x00-\x7f]") & ~w.rlike(rf"[{_EMOJI}]")
    )
    russian = _only(F.col("val"), "Cyrillic", CYRILLIC_LIKE)
    return (
        vals.select("key", "fld", russian.alias("russian"), F.explode(found).alias("word"))
        .withColumn("script", _script(F.col("word"), F.col("russian")))
        .drop("russian")
    )


def canonical_words(found: DataFrame) -> DataFrame:
    """(word, script, canonical) for each word that isn't the canonical member of its class."""
    counted = found.groupBy("word", "script").agg(F.count("*").alias("n"))
    form = (
        F.when(F.col("script") == "L", _skeleton(F.col("word")))
        .when(F.col("script") == "C", F.translate(_plain(F.col("word")), LATIN_LIKE, LATIN_AS_CYRILLIC))
        .otherwise(_plain(F.col("word")))
    )
    member = (
        counted.withColumn("form", form)
        .withColumn("form", F.when(F.col("form").rlike(r"\p{M}"), _compose("form")).otherwise(F.col("form")))
        .withColumn("right", F.col("form") == F.col("word"))
        .withColumn("class", F.collate(_skeleton(F.col("word")), "UNICODE"))
    )
    best = member.groupBy("class", "script").agg(
        F.max(F.when(F.col("right"), F.struct(F.col("n"), F.col("word").alias("w")))).alias("best"),
    )
    return (
        member.join(best.select("class", "script", F.col("best.w").alias("best")), ["class", "script"])
        .select("word", "script", F.coalesce("best", "form").alias("canonical"))
        .where(F.col("word") != F.col("canonical"))
    )


def lookalike_cases(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, fld) of every stored value with at least one word that isn't canonical; distinct."""
    found = store(words(values(df, key, fields)))
    odd = canonical_words(found).select("word", "script")
    return found.join(odd, ["word", "script"], "left_semi").select("key", "fld").distinct()


def canonical_text(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``df`` with each of ``fields`` in its canonical form; all other columns as they are.

    Rows whose values hold no variant are never rewritten.
    """
    found = store(words(values(df.select(key, *fields).dropDuplicates([key]), key, fields)))
    odd = canonical_words(found)
    swaps = (
        found.join(odd, ["word", "script"])
        .groupBy("key")
        .pivot("fld", fields)
        .agg(F.map_from_entries(F.collect_set(F.struct("word", "canonical"))))
    )
    swaps = swaps.select(F.col("key").alias("_lk"), *(F.col(f).alias(f"_swap_{f}") for f in fields))
    out = df.join(swaps, F.col(key) == F.col("_lk"), "left")
    for f in fields:
        parts = F.regexp_extract_all(F.col(f), F.lit(_GAP), F.lit(0))
        swap = F.col(f"_swap_{f}")
        fixed = F.array_join(F.transform(parts, lambda p: F.coalesce(swap[p], p)), "")
        out = out.withColumn(f, F.when(F.size(F.map_keys(swap)) > 0, fixed).otherwise(F.col(f)))
    return out.drop("_lk", *(f"_swap_{f}" for f in fields))
