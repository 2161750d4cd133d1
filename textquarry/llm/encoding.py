"""Problem 5: text that was decoded with the wrong character encoding.

For every line that isn't plain ASCII all chains of "encode with the wrong codec, decode with the
right one" that are possible without contradiction are candidates (one or two steps). Each
candidate, and the line as it stands, is compressed with zstandard dictionaries, one per language,
trained on clean lines of the corpus; its description length is the shortest compressed size plus
a cost for each step of the chain. The line keeps its text unless a chain is shorter.

Bytes lost on the way (U+FFFD) are open places in a chain: what is certain is restored, and a
missing byte is filled in where exactly one completion has the least description length. Where a line holds other characters as well, each
run of it that a step fits is a candidate by itself.

Lines are judged one by one, so a text of which only some lines are garbled is repaired in place.
The dictionaries are bounded, not what they are chosen from: their lines are counted over all rows.

Defined results: null and empty texts are no cases and stay as they are; repeated rows give
repeated results in :func:`repair` and count once in :func:`garbled_cases`; an empty table gives
an empty result. Only the key and the text column are read, so other columns may have any name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import category

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.llm.common import cut, spread, store

DICTIONARY_BYTES = 64 << 10
#: hashes of lines that are sent to all tasks at once
MOST_SENT = 1_000_000
#: thorough match search: sizes of short lines must not depend on which match is found first
LEVEL = 15
#: telling the languages of clean lines apart needs no more than this
TAG_LEVEL = 3
#: description length of one byte of the text itself; decides where compressed sizes are equal
RAW_COST = 0.75
#: description length of a letter (or accent) from a block of 256 that no dictionary has one of
NEW_BLOCK_COST = 12.0
#: and of one that only this very character is missing of
NEW_CHAR_COST = 2.0
#: a block with fewer characters than this in all dictionaries counts as new: stray ones occur anywhere
KNOWN_FROM = 20
# Wrong codec and right codec of one step, and its cost in bytes.
STEPS = {
    ("cp1252", "utf-8"): 0.1,
    ("gb18030", "utf-8"): 0.1,
    ("cp1251", "utf-8"): 0.5,
    ("koi8-r", "utf-8"): 0.5,
    ("mac_roman", "utf-8"): 0.5,
    ("cp437", "utf-8"): 0.5,
    ("cp850", "utf-8"): 1.0,
    ("cp866", "utf-8"): 1.0,
    ("big5", "utf-8"): 0.5,
    ("cp950", "utf-8"): 0.5,
    ("cp1252", "gb18030"): 2.0,
    ("cp1252", "cp1251"): 4.0,
    ("gb18030", "cp1252"): 0.5,
    ("cp1251", "gb18030"): 2.0,
    ("cp1251", "koi8-r"): 2.0,
    ("koi8-r", "cp1251"): 2.0,
}
#: what a second step with the same codecs is ahead, in bytes: such texts went through one wrong setting twice
AGAIN = 2.0
STRICT = [x for x in STEPS if x[1] == "utf-8"]
#: what must stand in a line for a step between two codecs that fit nearly any bytes
_HINTS = {
    ("cp1252", "gb18030"): re.compile(r"[\x80-\xff]{4}"),
    ("cp1252", "cp1251"): re.compile(r"[\x80-\xff]{4}"),
    # signs of the upper half of a code page beside its letters
    ("cp1251", "gb18030"): re.compile("[А-яЁё][Ѐ-ЏѐђѓєѕіјџҐґ¤¦§©«¬®°±µ¶·№»]+[А-яЁё]"),
    # one of the two has small letters where the other has capitals
    ("cp1251", "koi8-r"): re.compile("[А-ЯЁ]{4}"),
    ("koi8-r", "cp1251"): re.compile("[А-ЯЁ]{4}"),
    # what a single accented letter and its neighbour become where two bytes make one ideograph
    ("gb18030", "cp1252"): re.compile("[A-Za-z][\u3400-\u9fff]|[\u3400-\u9fff][A-Za-z]"),
}
# What is typically left of a punctuation mark whose last byte was lost.
COMPLETIONS = "–—‘’“”…•«»"
#: the beginning of a UTF-8 sequence before the open place, and the end of one after it
_AROUND_OPEN = re.compile("(?:[\udcc2-\udcf4][\udc80-\udcbf]{0,2})?\x1a[\udc80-\udcbf]{0,2}")
#: characters on either side of a lost one that its completions are compared in
AROUND = 60
LOST = "�"
#: stands for a lost character inside the bytes of a chain; it occurs in no text
_OPEN = "\x1a"
#: bytes that are no character, around the place where one was lost
_BROKEN = re.compile("[\udc80-\udcff]*\x1a[\udc80-\udcff]*|[\udc80-\udcff]+")

_CP1252 = {bytes([b]).decode("cp1252", "replace"): bytes([b]) for b in range(256)}
_CP1252 |= {chr(b): bytes([b]) for b in range(256) if bytes([b]).decode("cp1252", "replace") == LOST}
_CP1252.pop(LOST, None)
#: the C1 controls are what ISO 8859-1 makes of bytes for which this code page has a character
_TABLE_1252 = {c: c for c in range(0x80, 0xA0)} | {ord(c): b[0] for c, b in _CP1252.items()}
#: a run of characters that one garbled span can consist of
_RUN = re.compile(r"[^\x00-\x7f\ufffd]{2,}")


def _to_bytes(s: str, codec: str) -> bytes | None:
    if codec == "cp1252":  # bytes without a character in this code page pass as they are
        try:
            return s.encode("cp1252")
        except UnicodeEncodeError:
            t = s.translate(_TABLE_1252)
            try:
                return t.encode("latin-1") if all(ord(c) in _TABLE_1252 for c in s) else None
            except UnicodeEncodeError:
                return None
    try:
        return s.encode(codec)
    except UnicodeEncodeError:
        return None


def _step(s: str, wrong: str, right: str) -> str | None:
    """One step of a chain; None where it contradicts the text. Lost characters stay lost."""
    if _OPEN in s:
        return None
    lossy = LOST in s
    raw = _to_bytes(s.replace(LOST, _OPEN) if lossy else s, wrong)
    if raw is None:
        return None
    if not lossy:
        try:
            out = raw.decode(right)
        except UnicodeDecodeError:
            return None
        return None if out == s or any(c < " " and c not in "\t\r\f\v" for c in out) else out
    if right != "utf-8" or not re.search(r"[^\x00-\x7f\ufffd]", s):
        return None
    text = raw.decode(right, "surrogateescape")
    out = _BROKEN.sub(LOST, text)
    # each lost character may break one sequence: more contradictions mean another chain
    if out.count(LOST) > s.count(LOST):
        return None
    # without a restored character, all that speaks for the chain are well-formed left-overs
    if not re.search(r"[^\x00-\x7f\ufffd]", out) and not all(map(_AROUND_OPEN.fullmatch, _BROKEN.findall(text))):
        return None
    return out


def _spans(s: str, lengths: Lengths) -> str:
    """The line with each run decoded that is shorter, within its surroundings, than as it stands."""

    def one(m: re.Match) -> str:
        run, before, after = m.group(), s[max(0, m.start() - AROUND) : m.start()], s[m.end() : m.end() + AROUND]
        best, least = run, None
        for step in STRICT:
            text = _step(run, *step)
            if text is None:
                continue
            if least is None:
                least = lengths.of(before + run + after)
            size = lengths.of(before + text + after) + STEPS[step]
            if size < least:
                best, least = text, size
        return best

    return _RUN.sub(one, s)


def _completions(s: str, wrong: str, right: str) -> list[list[str]]:
    """For each lost character of ``_step(s, wrong, right)`` what its left-over bytes can have been."""
    raw = _to_bytes(s.replace(LOST, _OPEN), wrong)
    out = []
    for m in _BROKEN.finditer(raw.decode(right, "surrogateescape")):
        before, _, after = (x.encode("ascii", "surrogateescape") for x in m.group().partition(_OPEN))
        options = []
        if 1 <= len(before) + len(after) <= 2:
            for b in range(0x80, 0xF0):
                try:
                    options.append((before + bytes([b]) + after).decode(right))
                except UnicodeDecodeError:
                    pass
        out.append([x for x in options if len(x) == 1] or list(COMPLETIONS if before[:1] in (b"", b"\xe2") else ""))
    return out


def _candidates(s: str) -> Iterator[tuple[str, float, tuple]]:
    """(text, cost of the chain, how it came about) of every chain that doesn't contradict the line."""
    yield from _chains(s)
    open_marks = re.sub(r"(?<=[^\x00-\x7f])\?+|\?+(?=[^\x00-\x7f])", lambda m: LOST * len(m.group()), s)
    if open_marks != s:  # some decoders write a question mark for what they can't decode
        yield from _chains(open_marks)


def _chains(s: str) -> Iterator[tuple[str, float, tuple]]:
    for step, cost in STEPS.items():
        if step in _HINTS and not _HINTS[step].search(s):
            continue
        one = _step(s, *step)
        if one is None or one == s:
            continue
        yield one, cost, (s, *step)
        if not one.isascii() and LOST not in one:  # a second step on lost bytes would only invent
            for step2 in STRICT:
                two = _step(one, *step2)
                if two is not None and two != one:
                    yield two, cost + (-AGAIN if step2 == step else STEPS[step2]), (one, *step2)


def _block(c: str) -> tuple[int, str]:
    """Where a character stands in Unicode; all ideographs are one block."""
    return min(ord(c), 0x3400) >> 8, category(c)[0]


def _compressor(raw: bytes, level: int) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=level)
    return zstandard.ZstdCompressor(
        level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False
    )


class Lengths:
    """Description lengths under the dictionaries of all languages."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.by = {lang: _compressor(raw, LEVEL) for lang, raw in dictionaries.items()}
        if not self.by:
            self.by[""] = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        known = "".join(raw.decode("utf-8", "replace") for raw in dictionaries.values())
        self.chars = set(known)
        self.blocks = {x for x, n in Counter(map(_block, known)).items() if n >= KNOWN_FROM}

    @lru_cache(maxsize=20_000)  # noqa: B019 - one object per Python worker
    def of(self, s: str, lang: str | None = None) -> float:
        """The description length of ``s``, under the dictionary of ``lang`` only if one is given."""
        raw = s.replace(LOST, "?").encode("utf-8", "surrogatepass")  # however a loss is written
        new = 0.0
        if not s.isascii():
            for c in s:
                if c >= "\x80" and c not in self.chars and (x := _block(c))[1] in "LM":
                    new += NEW_CHAR_COST if x in self.blocks else NEW_BLOCK_COST
        by = self.by.values() if lang is None else [self.by[lang]]
        return min(len(c.compress(raw)) for c in by) + RAW_COST * len(raw) + new

    def language(self, s: str) -> str | None:
        if not self.by.keys() - {""}:
            return None
        raw = s.encode("utf-8", "surrogatepass")
        return min(self.by, key=lambda k: len(self.by[k].compress(raw)))


def _fill(s: str, options: list[list[str]], lengths: Lengths) -> str:
    """Fill lost characters in, from the left, where one completion is clearly the shortest.

    Completions are compared within their surroundings, so the cost is linear in the losses.
    """
    if s.count(LOST) != len(options):
        return s
    at, lang = 0, lengths.language(re.sub(r"[^\u0400-\uffff]+|\ufffd", "", s) or s)
    for choices in options:
        at = s.index(LOST, at)
        before, after = s[max(0, at - AROUND) : at], s[at + 1 : at + 1 + AROUND]
        tries = sorted((lengths.of(before + c + after, lang), i) for i, c in enumerate(choices))
        if tries and (len(tries) == 1 or tries[0][0] < tries[1][0]):
            s = s[:at] + choices[tries[0][1]] + s[at + 1 :]
        at += 1
    return s


def repair_line(s: str, lengths: Lengths) -> tuple[str, bool]:
    """The line as it was meant, and whether it was garbled."""
    if s.isascii():
        return s, False
    best, found = s, LOST in s or "锟斤拷" in s
    least = chain = None
    for text, cost, how in _candidates(s):
        if least is None:
            least = lengths.of(s)
        size = lengths.of(text) + cost
        if size < least:
            least, best, chain, found = size, text, how, True
    if not chain:
        best = _spans(s, lengths)
        found |= best != s
    elif LOST in best and LOST in chain[0]:
        best = _fill(best, _completions(*chain), lengths)
    return best, found


def repair_text(text: str, lengths: Lengths) -> tuple[str, int]:
    """The repaired text and the number of its garbled lines."""
    if text.isascii():
        return text, 0
    n, out = 0, []
    for line in text.split("\n"):
        fixed, bad = repair_line(line, lengths)
        n += bad
        out.append(fixed)
    return ("\n".join(out) if n else text), n


def _clean(line: str) -> bool:
    """Whether a line can be taken for right: no chain leads from it, or any part, to anything else."""
    if len(line) <= 3 or LOST in line or "锟" in line:
        return False
    # two characters are valid in some code page by chance, as in "d’émulateur"
    parts = [x for x in re.findall(r"[^\x00-\x7f]{2,}", line) if len(x) > 2 or _step(x, "cp1252", "utf-8")]
    return next(_candidates(line), None) is None and all(_step(x, *y) is None for x in parts for y in STRICT)


def train(labelled: DataFrame, unlabelled: DataFrame | None = None) -> dict[str, bytes]:
    """One dictionary per language: the most frequent clean lines of all rows.

    ``labelled`` has (key, text, lang). Lines that stand in ``unlabelled`` (key, text) only are given
    the language whose first dictionary compresses them best, so that its vocabulary counts as well;
    others have the languages of their labelled rows. Lines are counted over all rows and judged from
    the most frequent ones on until no other can come into a dictionary. The driver sees the chosen
    ones only.
    """
    known = labelled.where("lang is not null and lang <> 'und' and text is not null")
    texts = known.select(F.lit(True).alias("labelled"), "lang", "text")
    if unlabelled is not None:
        others = unlabelled.where("text is not null")
        texts = texts.unionByName(others.select(F.lit(False).alias("labelled"), F.lit("").alias("lang"), "text"))
    lines = _lines(texts)
    counts = _counts(lines)
    parts = _parts(counts)
    size = 2 * DICTIONARY_BYTES
    while True:
        taken = parts.where(F.col("labelled") & (F.col("at") < size))
        clean = cut(_judged(lines.where("labelled"), counts, taken, None))
        more = parts.where("labelled").groupBy("lang", "short").agg(F.max("at").alias("end")).where(F.col("end") >= size)
        if more.join(_filled(clean), ["lang", "short"], "left_anti").isEmpty():
            break
        size *= 2
    first = _dictionaries(clean)
    if unlabelled is None or not first:
        return first
    size = 2 * len(first) * DICTIONARY_BYTES  # lines without language are to serve all of them
    while True:
        taken = parts.where(~F.col("labelled") & (F.col("at") < size))
        merged = clean.unionByName(cut(_judged(lines.where("not labelled"), counts, taken, first)))
        if _settled(merged, parts, size, len(first)):
            return _dictionaries(merged)
        size *= 2


def _lines(texts: DataFrame) -> DataFrame:
    """``texts`` by lines, with a hash and the bytes of each; these two stand for the line."""
    each = texts.select("labelled", "lang", F.explode(F.split("text", "\n")).alias("line"))
    length = F.char_length("line")
    return each.where(length > 3).select(
        "*", F.xxhash64("line").alias("h"), (F.octet_length("line") + 1).alias("size"), (length <= 100).alias("short")
    )


def _counts(lines: DataFrame) -> DataFrame:
    """(labelled, lang, h, size, short, n, part): how often each line stands in all rows, without the lines themselves.

    Lines of labelled rows count under their languages only, with their unlabelled rows.
    """
    each = lines.groupBy("labelled", "lang", "h", "size", "short").agg(F.count("*").alias("n"))
    here = Window.partitionBy("h", "size")
    free = F.sum(F.when(F.col("labelled"), 0).otherwise(F.col("n"))).over(here)
    named = F.max("labelled").over(here)
    rows = each.withColumn("free", free).withColumn("named", named).where("labelled = named")
    n = F.when(F.col("labelled"), F.col("n") + F.col("free")).otherwise(F.col("n"))
    return store(rows.select("labelled", "lang", "h", "size", "short", n.alias("n"), F.shiftright("h", 52).alias("part")))


def _parts(counts: DataFrame) -> DataFrame:
    """(labelled, lang, short, n, part, at): lines in the order of dictionaries, many at once, and the bytes before them.

    ``part`` is the upper 12 bits of the hash, so lines of one number are at most 4,096 rows here.
    """
    order = Window.partitionBy("labelled", "lang", "short").orderBy(F.desc("n"), "part")
    before = F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, -1))
    each = counts.groupBy("labelled", "lang", "short", "n", "part").agg(F.sum("size").alias("bytes"))
    return cut(each.withColumn("at", F.coalesce(before, F.lit(0))).drop("bytes"))


def _judged(lines: DataFrame, counts: DataFrame, taken: DataFrame, tag_by: dict[str, bytes] | None) -> DataFrame:
    """(lang, line, n, h, size, short, part): the clean ones among the lines of the parts ``taken``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = {k: _compressor(v, TAG_LEVEL) for k, v in (tag_by or {}).items()}
        for b in batches:
            b = b[[_clean(x) for x in b["line"]]].copy()
            if by:
                raw = [x.encode("utf-8", "surrogatepass") for x in b["line"]]
                b["lang"] = [min(by, key=lambda k: len(by[k].compress(x))) for x in raw]
            yield b

    some = cut(counts.join(taken.drop("at"), ["labelled", "lang", "short", "n", "part"]))
    wanted = some.select("labelled", "h", "size").distinct()
    if some.count() < MOST_SENT:  # else dictionaries are hard to fill, and lines are moved to their hashes
        wanted = F.broadcast(wanted)
    found = lines.join(wanted, ["labelled", "h", "size"]).groupBy("h", "size").agg(F.min("line").alias("line"))
    named = some.join(found, ["h", "size"]).select("lang", "line", "n", "h", "size", "short", "part")
    count = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return named.repartition(count).mapInPandas(run, named.schema)


def _filled(lines: DataFrame) -> DataFrame:
    """(lang, short): of which ``lines`` fill their half of the dictionary."""
    return lines.groupBy("lang", "short").agg(F.sum("size").alias("bytes")).where(F.col("bytes") >= DICTIONARY_BYTES // 2)


def _settled(merged: DataFrame, parts: DataFrame, size: int, langs: int) -> bool:
    """Whether no unlabelled line behind the first ``size`` bytes can come before those that fill the dictionaries."""
    rest = parts.where(~F.col("labelled") & (F.col("at") >= size)).groupBy("short")
    following = rest.agg(F.min_by(F.struct("n", "part"), "at").alias("next")).collect()  # two rows at most
    for short, (n, part) in following:
        before = merged.where((F.col("n") > n) | (F.col("n") == n) & (F.col("part") < part))
        if _filled(before).where(F.col("short") == short).count() < langs:
            return False
    return True


def _foremost(lines: DataFrame, size: int) -> DataFrame:
    """The most frequent short and long lines of each language, ``size`` bytes of either, with where each begins."""
    order = Window.partitionBy("lang", "short").orderBy(F.desc("n"), "h", "line")
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return lines.withColumn("at", F.coalesce(before, F.lit(0))).where(F.col("at") < size)


def _dictionaries(lines: DataFrame) -> dict[str, bytes]:
    """Raw dictionary content of each language: half of it long lines, half of it short ones.

    The most frequent short lines come last, where they are cheapest to refer to.
    """
    chosen = _foremost(lines, DICTIONARY_BYTES // 2).select("lang", "short", "line", "at").collect()  # bounded
    out: dict[str, bytes] = {}
    for r in sorted(chosen, key=lambda r: (r["lang"], r["short"], -r["at"])):
        out[r["lang"]] = out.get(r["lang"], b"") + r["line"].encode("utf-8", "surrogatepass") + b"\n"
    return out


def repair(df: DataFrame, key: str, text: str, dictionaries: dict[str, bytes]) -> DataFrame:
    """(key, text, garbled): the repaired text of each row and its number of garbled lines."""
    shared = df.sparkSession.sparkContext.broadcast(dictionaries)  # a few times 64 KB

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lengths = Lengths(shared.value)
        for b in batches:
            done = [(None, 0) if t is None else repair_text(t, lengths) for t in b["text"]]
            yield pd.DataFrame({"key": b["key"], "text": [t for t, _ in done], "garbled": [n for _, n in done]})

    return spread(df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))).mapInPandas(
        run, "key string, text string, garbled int"
    )


def garbled_cases(df: DataFrame, key: str, text: str, dictionaries: dict[str, bytes]) -> DataFrame:
    """(key) of each row whose text holds at least one wrongly decoded sequence; distinct."""
    some = df.select(key, text).where(F.col(text).rlike(r"[^\x00-\x7f]"))
    return repair(some, key, text, dictionaries).where("garbled > 0").select("key").distinct()
