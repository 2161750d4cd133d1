"""Problem 1: noise in text from scanned pages.

All steps are DataFrame operations over the lines of the records:

* *Furniture.* Numbers of a line, also badly recognised ones, are masked; a masked line that
  stands at page edges of its record again and again is a running header or footer, a line that is
  nothing but a page number (with its decoration), or a short line with one set apart, always is. A
  line at the top of a page that ends although the next word would still have fitted is a header as
  well, and so is a short line at an edge that is made of parts of titles only, whichever record
  they are the titles of (numbers masked, glyphs made equal); this finds headers of single pages.
* *Misread words.* Words are grouped by a skeleton in which glyphs that scanners confuse are equal.
  A word is misread if another form of its skeleton is :data:`DOMINANCE` times as frequent over all
  records and supported by the context: somewhere in the corpus that form stands after the same
  word, or before the same word, as this one does. Of several such forms the one with more support
  is taken. Windows of Han characters hold their neighbours themselves. Without any support a form
  has to be :data:`BEYOND_DOUBT` times as frequent.
* *Broken words.* A line that ends with a hyphen is joined with the next body line, be it on the
  next page, unless the hyphenated form of the whole word is more frequent than the joined one.
* *Reflow.* Windows over the body lines number the paragraphs: a blank line or a sentence's end on
  a short line starts a new one.

Defined results: null and blank texts give no lines and an empty repaired text; a record delivered
twice is taken once (by key); results are distinct. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.llm.common import store

#: a form must be so many times as frequent as the word it replaces, and occur so often
DOMINANCE, ENOUGH = 8, 5
BEYOND_DOUBT = 60
# Signs that mark a word split at the end of a line.
HYPHENS = "-‐¬­"
# Glyphs that stand for a digit or letter, and groups of letters read as one letter.
GLYPHS, GLYPHS_AS = "0O1I|5698!†@éü", "oolllsbgbitabu"
PAIRS = (("e", "c"), ("ii", "u"), ("ri", "n"), ("li", "h"), ("rn", "m"), ("cl", "d"), ("vv", "w"), ("lc", "k"))
#: the same in another order: "lii" is either "hi" or "lu"
OTHER_PAIRS = (("e", "c"), ("li", "h"), ("ii", "u"), *PAIRS[2:])
# Han characters that scanners confuse, and the one of each pair used as skeleton.
HAN = "暖笺稈蜜洼捡琏拭玛蹦钠侧迸扯未土已曰人千巳析佑巿"
HAN_AS = "缓签程密注检链试码崩钥测进址末士己日入干己折估市"

_NUM = r"[0-9OolI|SBZ]{1,4}"
_NUMBER_LINE = "|".join(
    (
        rf"^(?=.*[0-9OlI|]){_NUM}$",
        rf"^[-–—\[(~.·|]+ ?{_NUM} ?[-–—\])~.·|]+$",
        rf"^\S{{3,6}} {_NUM} \S{{2,3}} {_NUM}$",
        rf"^\S? ?{_NUM} ?页$|^第 ?{_NUM} ?\S$",
        r"^[ivxlcdm1]{1,9}$",
    )
)
#: a page number set apart from a short title: by a wide space, or by a sign and at most one word
_BESIDE_NUMBER = rf"^{_NUM}\s{{3,}}\S|\S\s{{3,}}{_NUM}$|\S [·•|/–—] (?:\S{{1,4}} )?{_NUM}$"
#: how a title of several parts begins, be it badly recognised, and goes on
_TITLE_LIKE = r"^(?:[\p{Lu}\p{N}\p{IsHan}|!†@]|lib).*(?:\s[–—/·|-]\s|[:：,，的与])"
#: what parts of titles are set apart by, and names in brackets, which are no part
_PARTS, _BRACKETS = r"\s[–—/·|-]\s|[:：,，的与]", r"\([^()]*\)?"
_ENDS = ".!?:;,。！？：；，、)]）”\"'»…"
#: numbers, addresses and words that no writer would write: letters in numbers and the reverse; each begins with what is rare
_IMPOSSIBLE = (
    r"(?=[\dOlIS!†@])(?:(?<![\p{L}\p{N}])(?:Ox[0-9a-f]+|0x[0-9a-f]*[OolISZ][0-9a-zA-Z]*)(?![\p{L}\p{N}])"
    r"|(?<![\p{L}\p{N}.])(?:\d+[OolIS]+\d*|[OlIS]+\d+[OlIS\d]*)(?![\p{L}\p{N}])"
    r"|!(?=\p{Ll})(?:(?<=\p{L}!)|(?<!\S!))|†|@(?<=\p{Ll}@)\p{Ll}*(?![\w.-]*\.\w)|(?<!\S)@\p{Ll})"
)
_DIGIT_IN_WORD, _WORD_WITH_DIGIT = r"[01569](?<=\p{Ll}{2}.)\p{Ll}", r"(?<![\p{L}\p{N}])\p{Ll}{2,}[01569]\p{Ll}+(?!\p{N})"
_HAN_CHAR = re.compile("[一-鿿]")
_HAN_WINDOWS = re.compile(f"[一-鿿]?[{HAN}{HAN_AS}][一-鿿]?")
_ASCII_ENDS = re.compile(r"^[!-~]+|[!-~]+$")
_COMPOUND = re.compile(r"[^\W_]+(?:[-‐'’][^\W_]+)+")
_CAMEL = re.compile(r"(?<=[a-zß-öø-ÿа-яё])(?=[A-ZÀ-ÖØ-ÞА-ЯЁ])")
_WORDS = re.compile(r"(?:[0-9A-Za-zÀ-ɏЀ-ӿ|†@]|!(?=[a-z]))+")
#: the same for lines without "!", and for those of ASCII letters only
_PLAIN_WORDS, _ASCII_WORDS = re.compile(r"[0-9A-Za-zÀ-ɏЀ-ӿ|†@]+"), re.compile(r"[0-9A-Za-z|@]+")
_LETTER = re.compile(r"[^\W\d_]")
#: addresses and registers
_NAME = re.compile(r"[0O]x|[a-z]\d{1,2}$")

REC = ["tbl", "rec_key"]


def skeleton(word: Column, pairs: tuple[tuple[str, str], ...] = PAIRS) -> Column:
    """The word with all confusable glyphs made equal."""
    c = F.lower(F.translate(word, HAN + GLYPHS, HAN_AS + GLYPHS_AS))
    for pair, one in pairs:
        c = F.replace(c, F.lit(pair), F.lit(one))
    return c


def records(parsed: DataFrame, media: DataFrame) -> DataFrame:
    """(tbl, rec_key, text, title, pages) of pdf rows and of images with text, each record once."""
    pdf = parsed.where("source_type = 'pdf' and text is not null").select(
        F.lit("parsed_documents").alias("tbl"),
        F.col("doc_id").alias("rec_key"),
        "text",
        "title",
        F.col("metadata.page_count").alias("pages"),
    )
    images = media.where("ocr_text is not null").select(
        F.lit("media").alias("tbl"), F.col("local_path").alias("rec_key"), F.col("ocr_text").alias("text"), "title", F.lit(1).alias("pages")
    )
    return pdf.unionByName(images).dropDuplicates(REC)


def impossible(line: Column) -> Column:
    """Whether a line holds what no writer would write."""
    return line.rlike(_IMPOSSIBLE) | line.rlike(_DIGIT_IN_WORD) & line.rlike(_WORD_WITH_DIGIT)


def _mask(line: Column) -> Column:
    """A line without its numbers, glyphs made equal; what is repeated on the pages of a record."""
    numbers = rf"(?<![\p{{L}}\p{{N}}]){_NUM}(?![\p{{L}}\p{{N}}])"
    return skeleton(F.regexp_replace(F.regexp_replace(line, numbers, ""), r"[\s\d]+", ""))


def _parts(line: Column) -> Column:
    """The parts of a title or line, masked and hashed; parts of fewer than 4 characters don't count."""
    parts = F.transform(F.split(F.regexp_replace(line, _BRACKETS, ""), _PARTS), lambda x: F.regexp_replace(_mask(x), r"\P{L}+", ""))
    return F.transform(F.filter(parts, lambda x: F.char_length(x) >= 4), lambda x: F.xxhash64(x))


def _spaced(line: Column) -> Column:
    """A line with spaces for form feeds, tabs and returns, which few lines hold, and none at its ends."""
    odd = F.contains(line, F.lit("\f")) | F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r"))
    return F.trim(F.when(odd, F.regexp_replace(line, r"[\f\t\r]", " ")).otherwise(line))


def _open(s: Column) -> Column:
    """Whether a line goes on without the end of a sentence, as titles do."""
    return ~F.contains(F.lit(_ENDS), F.right(s, F.lit(1))) | s.rlike(r"\(\S*lib\S*\)$|\.\S?o\)$")


def edge_lines(recs: DataFrame) -> DataFrame:
    """(tbl, rec_key, line_no, s) of each record's lines of 4 to 70 characters near the edge of a page.

    All columns go to the workers, so that the shuffle of the records serves this as well.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [edges(text) for text in b["text"]]
            flat = [(*rec, *x) for *rec, xs in zip(b["tbl"], b["rec_key"], found, strict=True) for x in xs]
            if flat:
                yield pd.DataFrame(flat, columns=["tbl", "rec_key", "line_no", "s"])

    return recs.mapInPandas(run, "tbl string, rec_key string, line_no int, s string")


def edges(text: str) -> list[tuple[int, str]]:
    """The numbered lines of 4 to 70 characters within two of a blank line, of a page number or of an end of the text."""
    lines = text.split("\n")
    gap = [True, True, *(len(x) <= 6 or "\f" in x or not x.strip(" ") for x in lines), True, True]
    found = []
    for i, (x, *near) in enumerate(zip(lines, gap, gap[1:], gap[2:], gap[3:], gap[4:], strict=False)):
        if True in near and 4 <= len(short := x.strip(" \f\t\r")) <= 70:
            found.append((i, short.replace("\f", " ").replace("\t", " ").replace("\r", " ")))
    return found


def titled_lines(recs: DataFrame, titles: DataFrame) -> DataFrame:
    """(tbl, rec_key, titled): the numbers of each record's short lines that consist of parts of titles.

    ``titles`` (title) are those of the whole corpus; each part counts once, however often it
    stands in titles. All parts must be known; of three or more the last one may be cut off.
    """
    known = titles.where("title is not null").select(F.explode(_parts(F.col("title"))).alias("part")).distinct()
    short = edge_lines(recs).where(F.col("s").rlike(_TITLE_LIKE) & _open(F.col("s")))
    parts = short.select(*REC, "line_no", F.posexplode(_parts(F.col("s"))).alias("at", "part"))
    found = parts.join(known.withColumn("hit", F.lit(1)), "part", "left")
    last = F.max(F.struct("at", "hit"))
    by_line = found.groupBy(*REC, "line_no").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"), last.alias("last"))
    enough = (F.col("hits") == F.col("n")) | (F.col("n") > 2) & (F.col("hits") == F.col("n") - 1) & F.col("last.hit").isNull()
    return by_line.where(enough).groupBy(*REC).agg(F.collect_set("line_no").alias("titled"))


def page_lines(recs: DataFrame, titles: DataFrame) -> DataFrame:
    """(tbl, rec_key, line_no, s, blank_before, furniture) of every non-blank line; ``titles`` (title) are the corpus's."""
    w = Window.partitionBy(*REC).orderBy("line_no")
    whole = Window.partitionBy(*REC)
    # the number of a line, whether a page begins there and whether it is a page number: one code, shifted by one window
    coded = lambda c: (F.shiftright(c, 2), c.bitwiseAND(2) != 0, c.bitwiseAND(1) != 0)

    def starts(one: Column, before: Column) -> Column:
        (at, new_page, _), (at_before, _, number) = coded(one), coded(before)
        return (at - F.coalesce(at_before, F.lit(-2)) > 1) | new_page | F.coalesce(number, F.lit(False))

    shifts = {"last": 1, "last2": 2, "next1": -1, "next2": -2}
    code, last, last2, next1, next2 = map(F.col, ("code", *shifts))
    top, top2 = starts(code, last), last.isNotNull() & starts(last, last2)
    bottom = next1.isNull() | starts(next1, code) | coded(next1)[2]
    bottom2 = next1.isNotNull() & (next2.isNull() | starts(next2, next1) | coded(next2)[2])
    lines = (
        recs.join(titled_lines(recs, titles), REC, "left")
        .withColumn("title_skel", skeleton(F.col("title")))
        .select(*REC, "title_skel", "pages", "titled", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
        .withColumn("s", _spaced(F.col("raw")))
        .where("s <> ''")
        .withColumn("titled", F.coalesce(F.array_contains("titled", F.col("line_no")), F.lit(False)))
        .withColumn("number", (F.char_length("s") <= 24) & F.col("s").rlike(_NUMBER_LINE))
        .withColumn("code", F.expr("line_no * 4L + int(startswith(raw, '\f')) * 2 + int(number)"))
        .select(*REC, "title_skel", "pages", "titled", "line_no", "s", "number", "code")
        .select("*", *(F.lag("code", k).over(w).alias(n) for n, k in shifts.items()), F.lead("s").over(w).alias("next"))
        .withColumn("blank_before", F.col("line_no") - F.coalesce(coded(last)[0], F.lit(-2)) > 1)
        .withColumns({"top": F.coalesce(top, F.lit(False)), "bottom": F.coalesce(bottom, F.lit(False))})
        .withColumn("edge", F.col("top") | F.col("bottom") | F.coalesce(top2 | bottom2, F.lit(False)))
        .withColumn("open", (F.char_length("s") <= 90) & _open(F.col("s")))
        .withColumn("m", F.when((F.col("edge") & F.col("open") | F.col("titled")) & ~F.col("number"), _mask(F.col("s"))))
    )
    # what needs the title or the next line comes now, so that the windows below sort neither
    han = F.col("s").rlike(r"\p{IsHan}")
    next_word = F.when(han, F.lit(1)).otherwise(1 + F.char_length(F.regexp_extract("next", r"^\S+", 0)))
    capitals = (F.upper("s") == F.col("s")) & (F.lower("s") != F.col("s")) & F.col("s").rlike(r"\p{Lu}{4}") & ~han
    of_title = (F.char_length("s") >= 4) & F.startswith(F.col("title_skel"), skeleton(F.col("s")))
    outer = F.col("open") & (F.col("top") | F.col("bottom"))
    lines = (
        lines.withColumn("needs", F.when(F.col("open") & F.col("top") & F.col("next").isNotNull(), F.char_length("s") + next_word))
        .withColumn("at_edge", F.when(outer, capitals | F.coalesce(of_title, F.lit(False))).otherwise(False))
        .withColumn("at_edge", F.col("at_edge") | F.col("edge") & F.col("titled"))
        .select(*REC, "pages", "titled", "line_no", "s", "number", "blank_before", "edge", "open", "m", "needs", "at_edge")
    )
    again = Window.partitionBy(*REC, "m")
    lines = (
        lines.withColumn("times", F.when(F.col("m").isNotNull(), F.count("*").over(again)).otherwise(0))
        .select(
            "*",
            F.max(F.when(~F.col("edge"), F.char_length("s"))).over(whole).alias("width"),
            F.sum(F.col("number").cast("int")).over(whole).alias("numbers"),
            F.collect_set(F.when(F.col("times") >= 2, F.struct("m", "times"))).over(whole).alias("known"),
        )
        .withColumn("pages", F.greatest(F.coalesce(F.col("pages").cast("int"), F.col("numbers").cast("int")), F.lit(1)))
        .withColumn("repeated", (F.col("times") >= 2) & (F.col("times") >= 0.3 * F.col("pages")))
    )
    head = F.col("needs") <= F.col("width") - 3  # the next word would have fitted
    most = lambda k: F.greatest(F.lit(1), F.char_length(k) / 4)
    longer = lambda k: F.abs(F.char_length(k) - F.char_length("m"))  # noqa: E731 - cheap, no distance is less
    close = lambda k: (longer(k) <= most(k)) & (F.levenshtein(k, F.col("m")) <= most(k))
    alike = F.exists("known", lambda k: (k["times"] >= 0.3 * F.col("pages")) & close(k["m"]))
    digit = lambda end: F.contains(F.lit("0123456789OolI|SBZ"), end("s", F.lit(1)))  # noqa: E731 - cheap, before the pattern
    numbered = (F.char_length("s") <= 70) & (digit(F.left) | digit(F.right)) & F.col("s").rlike(_BESIDE_NUMBER)
    running = F.col("open") & F.col("edge") & (F.col("repeated") | head | F.col("at_edge") | alike)  # the dearest comes last
    furniture = F.col("number") | F.col("open") & numbered | running | F.col("titled") & F.col("repeated")
    lines = lines.withColumn("furniture", F.coalesce(furniture, F.lit(False)))
    # the split word at the end of a body line: what stands before the hyphen and opens the next body line
    following = F.lead("s").over(Window.partitionBy(*REC, "furniture").orderBy("line_no"))
    hyphened = F.contains(F.lit(HYPHENS), F.right("s", F.lit(1))) & ~F.col("furniture")
    return (
        lines.withColumn("a", F.when(hyphened, F.regexp_extract("s", rf"([\p{{L}}\p{{N}}'’-]*\p{{L}})[{HYPHENS}]$", 1)))
        .withColumn("b", following)
        .withColumn("b", F.when(hyphened, F.regexp_extract("b", r"^(\p{L}[\p{L}\p{N}'’-]*)", 1)))
        .withColumn("id", F.monotonically_increasing_id())
        .select("id", *REC, "line_no", "s", "blank_before", "width", "furniture", "a", "b")
    )


def words_in(s: str) -> tuple[dict[str, None], list[str]]:
    """What is judged by itself in a line, and its words in their order.

    Compounds as a whole are judged as well. Lines of Han text are cut within words, so their ends
    are left out; so is a hyphenated last word. Windows of Han characters and compounds have no
    words beside them.
    """
    alone: dict[str, None] = {}
    ascii_only = s.isascii()
    if not ascii_only and _HAN_CHAR.search(s):
        alone = dict.fromkeys(_HAN_WINDOWS.findall(s))
        inner = _ASCII_ENDS.sub(" ", s)
    else:
        inner = s if s[-1:] not in HYPHENS else s.rpartition(" ")[0]
        if "-" in inner or "‐" in inner:
            alone = dict.fromkeys(w.replace("‐", "-") for w in _COMPOUND.findall(inner))
    pattern = _WORDS if "!" in inner else _ASCII_WORDS if ascii_only else _PLAIN_WORDS
    return alone, [w for run in pattern.findall(inner) for w in _split[run]]


class _Judged(dict):
    """Whether a word can be judged; words come again and again."""

    def __missing__(self, w: str) -> bool:
        long = len(w) >= 4
        can = long if w.isalpha() else not w.isdigit() and bool(_LETTER.search(w)) and not _NAME.match(w)
        if len(self) < 200_000:
            self[w] = can
        return can


class _Split(dict):
    """The words of a run of letters, cut where a capital follows a small letter."""

    def __missing__(self, run: str) -> list[str]:
        words = _CAMEL.sub(" ", run).split(" ")
        if len(self) < 200_000:
            self[run] = words
        return words


_judged, _split = _Judged(), _Split()


class _Codes(dict):
    """A number for each word beside another, the same for words that look alike; 0 for none."""

    def __missing__(self, word: str) -> int:
        low = word.translate(_ALIKE).lower()
        for pair, one in PAIRS:
            low = low.replace(pair, one)
        code = int.from_bytes(hashlib.blake2b(low.encode(), digest_size=4).digest(), "big", signed=True) if word else 0
        if len(self) < 200_000:
            self[word] = code
        return code


_ALIKE = str.maketrans(GLYPHS, GLYPHS_AS)


def words_of(body: DataFrame) -> DataFrame:
    """(id, word, left, right): the distinct judged words of each line and their neighbours, written once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = _Codes()
        for b in batches:
            n, word, left, right = [], [], [], []
            for s in b["s"]:
                before = len(word)
                alone, words = words_in(s)
                if alone:
                    word.extend(alone)
                    left.extend([0] * len(alone))
                    right.extend([0] * len(alone))
                seen = set(alone)
                codes = [0, *map(code.__getitem__, words), 0]
                for w, x, y in zip(words, codes, codes[2:], strict=False):
                    if _judged[w] and w not in seen:
                        seen.add(w)
                        word.append(w)
                        left.append(x)
                        right.append(y)
                n.append(len(word) - before)
            beside = {"left": np.array(left, np.int32), "right": np.array(right, np.int32)}
            if word:
                yield pd.DataFrame({"id": np.repeat(b["id"].to_numpy(), n), "word": word, **beside})

    return store(body.select("id", "s").mapInPandas(run, "id bigint, word string, left int, right int"))


def word_counts(words: DataFrame) -> DataFrame:
    """(word, n, skel, other, low) of all words, written once."""
    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    other = skeleton(F.col("word"), OTHER_PAIRS)
    return store(counted.select("word", "n", skeleton(F.col("word")).alias("skel"), other.alias("other"), F.lower("word").alias("low")))


def other_forms(counted: DataFrame) -> DataFrame:
    """(word, low, form, times): each word with every form of its skeleton that is frequent enough to replace it.

    ``times`` is how many times as frequent it is. A form that is itself frequent enough is never replaced.
    """
    found = None
    for skel in ("skel", "other"):
        low = counted.groupBy(F.col(skel).alias("skel"), "low").agg(F.sum("n").alias("n"), F.max_by("word", F.struct("n", "word")).alias("form"))
        forms = low.where(F.col("n") >= ENOUGH).select("skel", F.col("low").alias("other_low"), F.col("n").alias("n_form"), "form")
        bad = low.drop("form").join(forms, "skel").where((F.col("other_low") != F.col("low")) & (F.col("n_form") >= DOMINANCE * F.col("n")))
        bad = bad.select("low", "form", (F.col("n_form") / F.col("n")).alias("times"))
        found = bad if found is None else found.unionByName(bad)
    found = found.groupBy("low", "form").agg(F.max("times").alias("times"))
    return counted.select("word", "low").join(found, "low")


def misread_words(words: DataFrame, counted: DataFrame) -> DataFrame:
    """(id, word, form): each misread word of a line with the form that its context supports."""
    forms = store(other_forms(counted))
    seen = store(words.join(forms.drop("low"), "word").select("id", "word", "form", "left", "right", "times"))
    support = None
    for side in ("left", "right"):
        asked = seen.where(F.col(side) != 0).select(F.lower("form").alias("low"), side).distinct()
        there = words.where(F.col(side) != 0).select(F.lower("word").alias("low"), side)
        one = there.join(asked, ["low", side]).groupBy("low", side).agg(F.count("*").alias(f"n_{side}"))
        support = (seen.withColumn("low", F.lower("form")) if support is None else support).join(one, ["low", side], "left")
    by_itself = F.col("word").rlike(r"\p{IsHan}") | F.col("word").contains("-")
    n = F.coalesce("n_left", F.lit(0)) + F.coalesce("n_right", F.lit(0))
    fit = support.withColumn("support", n).where((F.col("support") > 0) | by_itself | (F.col("times") >= BEYOND_DOUBT))
    return fit.groupBy("id", "word").agg(F.max_by("form", F.struct("support", "times", "form")).alias("form"))


def broken_words(body: DataFrame, counted: DataFrame) -> DataFrame:
    """(id, joined) of each body line whose last word goes on in the next one."""
    ends = body.where("a <> '' and b <> ''").select("id", F.concat("a", "b").alias("joined"), F.concat_ws("-", "a", "b").alias("kept"))
    ends = ends.withColumn("joined_skel", skeleton(F.col("joined"))).withColumn("kept_skel", skeleton(F.col("kept")))
    wanted = ends.select(F.explode(F.array("joined_skel", "kept_skel")).alias("skel")).distinct()
    counts = counted.join(wanted, "skel", "left_semi").groupBy("skel").agg(F.sum("n").alias("n"))
    one = counts.select(F.col("skel").alias("joined_skel"), F.col("n").alias("n_joined"))
    two = counts.select(F.col("skel").alias("kept_skel"), F.col("n").alias("n_kept"))
    return (
        ends.join(one, "joined_skel", "left")
        .join(two, "kept_skel", "left")
        .where(F.coalesce("n_kept", F.lit(0)) <= F.coalesce("n_joined", F.lit(0)))
        .select("id", "joined")
    )


def _titles(parsed: DataFrame, media: DataFrame) -> DataFrame:
    return parsed.select("title").unionByName(media.select("title"))


def noise_cases(parsed: DataFrame, media: DataFrame) -> DataFrame:
    """(tbl, rec_key, line_no, kind): every line that is furniture, broken or misread; distinct."""
    lines = store(page_lines(records(parsed, media), _titles(parsed, media)))
    body = lines.where("not furniture")
    words = words_of(body)
    counted = word_counts(words)
    by_word = misread_words(words, counted).select("id")
    misread = by_word.unionByName(body.where(impossible(F.col("s"))).select("id")).distinct()
    kinds = misread.select("id", F.lit("misread").alias("kind")).unionByName(
        broken_words(body, counted).select("id", F.lit("broken").alias("kind"))
    )
    place = [*REC, F.col("line_no").cast("bigint").alias("line_no")]
    return (
        lines.select("id", *place)
        .join(kinds, "id")
        .select(*REC, "line_no", "kind")
        .unionByName(lines.where("furniture").select(*place, F.lit("furniture").alias("kind")))
    )


def repaired_text(parsed: DataFrame, media: DataFrame) -> DataFrame:
    """(tbl, rec_key, text): each record as continuous paragraphs, separated by blank lines."""
    lines = store(page_lines(records(parsed, media), _titles(parsed, media)))
    body = lines.where("not furniture")
    words = words_of(body)
    counted = word_counts(words)
    swaps = (
        misread_words(words, counted)
        .groupBy("id")
        .agg(F.map_from_entries(F.collect_set(F.struct("word", "form"))).alias("swap"))
    )
    broken = broken_words(body, counted).select("id", F.lit(True).alias("broken"))

    def fix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            swap = [None if x is None else dict(x) for x in b["swap"]]
            b["t"] = [s if not m else _swapped(s, m) for s, m in zip(b["s"], swap, strict=True)]
            yield b.drop(columns=["swap"])

    joined = body.join(swaps, "id", "left").join(broken, "id", "left").withColumn("broken", F.coalesce("broken", F.lit(False)))
    fields = ["tbl", "rec_key", "line_no", "s", "blank_before", "width", "broken"]
    kinds = dict(joined.dtypes)
    fixed = joined.select(*fields, "swap").mapInPandas(fix, ", ".join(f"{c} {kinds[c]}" for c in fields) + ", t string")
    w = Window.partitionBy(*REC).orderBy("line_no")
    end = F.col("s").rlike(r"""[.!?:。！？：][)”"'»）]*$""")
    flowing = (
        fixed.withColumn("t", F.when(F.col("broken"), F.expr("left(t, char_length(t) - 1)")).otherwise(F.col("t")))
        .withColumn("short_end", F.lag(end & (F.char_length("s") < 0.85 * F.col("width"))).over(w))
        .withColumn("blank_end", F.col("blank_before") & F.lag(end).over(w))
        .withColumn("starts", F.coalesce(F.col("short_end") | F.col("blank_end"), F.lit(True)).cast("int"))
        .withColumn("paragraph", F.sum("starts").over(w))
        .withColumn("glue", F.when(F.col("broken") | F.col("s").rlike(r"\p{IsHan}"), "").otherwise(" "))
    )
    ordered = F.array_sort(F.collect_list(F.struct("line_no", F.concat("t", "glue").alias("t"))))
    paragraphs = flowing.groupBy(*REC, "paragraph").agg(F.trim(F.array_join(F.transform(ordered, lambda x: x["t"]), "")).alias("t"))
    whole = F.array_sort(F.collect_list(F.struct("paragraph", "t")))
    texts = paragraphs.groupBy(*REC).agg(F.array_join(F.transform(whole, lambda x: x["t"]), "\n\n").alias("text"))
    every = records(parsed, media).select(*REC)
    return every.join(texts, REC, "left").select(*REC, F.coalesce("text", F.lit("")).alias("text"))


def _swapped(s: str, forms: dict[str, str]) -> str:
    """The line with its misread words replaced, at word boundaries only."""
    for word, form in forms.items():
        if _HAN_CHAR.search(word):
            s = s.replace(word, form)
        else:
            s = re.sub(rf"(?<![^\W_]){re.escape(word)}(?![^\W_A-Z])|(?<=[a-z]){re.escape(word)}(?![^\W_A-Z])", lambda _: form, s)
    return s
