"""Problem 8: keyword-stuffed and link-list pages.

Two views of each whole text are measured. What spam is made of gives the weak labels:
:func:`stuffed` is the share of characters in lines that are links with few words, repeat their
words, or string tags together; pages where it is large are taken for spam, where it is small for
clean, and those between stay unlabelled. The trees don't see that share. They get content and
link features of another kind (:func:`features`: sentences, code, lengths, capitals, vocabulary,
addresses), are bagged (Spark ML, all features at each split), trained on a bounded sample of
labelled pages, and score every page, labelled or not. So they overrule wrong labels where the
other features say otherwise. The scores are smoothed with the spam rate of the page's host: the
log-odds of a page move towards the log-odds of its host, by a weight that grows with the host's
pages; it decides pages that the trees leave open.

Defined results: null and blank texts are no cases; repeated texts are cases under each id; a null
source is a host of its own; an empty table, or one with labels of one kind only, gives the weak
labels. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import cut, spread

#: at most about so many labelled pages train the trees
TRAIN_ROWS = 20_000
TREES, DEPTH, LEAF = 15, 6, 2
#: shares of characters in stuffed lines that give a weak label
SPAM_FROM, CLEAN_TO = 0.6, 0.4
#: a link needs so many words around it to be more than an entry of a list
WORDS_A_LINK = 8
#: marks between tags for each word of a tag list, and the share of distinct words below which a line repeats itself
MARKS, DISTINCT = 0.3, 0.62
#: a single line of fewer characters without a link is never labelled as spam
SHORT = 40
#: most weight of a host in the log-odds of its pages, and the pages it takes to get half of it
HOST_WEIGHT, HOST_HALF = 0.15, 50.0

_URL = re.compile(r"https?://\S+|\b[a-z0-9-]+(?:\.[a-z0-9-]+)*?\.(?:com|net|org|info|test|example|invalid)\b(?:/\S*)?")
_HOST = re.compile(r"\.(?:com|net|org|info|test|example|invalid)\b")
_MARKER = re.compile(r"^\s*(?:[-*+•]\s+|\d+[.)]\s+)?")
_CUT = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])\s*")
_END = re.compile(r"""[.!?。！？;；][)）\]”"'»]*$""")
_START = re.compile(r"[A-ZÀ-ÞА-ЯЁ/0-9“\"«(]|[一-鿿]|(?:lib|[a-z]+\.[A-Z])|[a-z]+[A-Z]")
_TARGET = re.compile(r"\]\([^)\s]*\)")
#: Han words set apart by spaces are keywords
_SPACED = re.compile(r"[一-鿿] (?=[一-鿿])")
_LEAD = re.compile(r"^(?:\[[^\]]*\]\s*[–—-]\s*|[^:：.。]{1,60}[:：]\s+)")
_CODE = re.compile(
    r"^\s*(?:[.@]\w|//|/\*|\*/|(?:const|invoke|if|return|move|goto|var|let|def|class|import|private|public|static|for|while)\b[ /({-])|[=()].*[;{}]\s*$|^\s*[{}()]+;?\s*$|\w\(.*\)\s*[;{]?\s*$"
)
_HAN = re.compile("[一-鿿]")
_UPPER, _DIGIT = re.compile(r"[A-ZÀ-ÞА-ЯЁ]"), re.compile(r"\d")
_HEAD = re.compile(r"#{1,6}\s\S|!?\[[^\]]*\d+: |!\[")
_FENCE = re.compile(r"^\s*(?:```|~~~)")
_WORD = re.compile(r"[^\W_]+")
_MARK = re.compile(r"#\w|\[[^\]\n]{1,30}\]|[|•,;]|\s[/-]\s|[，、](?=[^，、。]{1,12}[，、])")
_STRUCTURE = re.compile(r"[{}=]\s*$|\)\s*;$|\w\(.*\)|^\s*[.@/*]|^\||^```|^\s*#{1,6}\s")
_STOP = re.compile("[。！？；]")
_CLOSED = re.compile(r"""[.!?。！？;；:：…][)）\]”"'»]*$""")
FEATURES = (
    "sentence", "code", "markup", "url_chars", "urls", "link_lines", "short_lines", "separators",
    "distinct", "top_word", "repeated_pairs", "upper", "digits", "log_length", "line_length",
)


def _sentence_chars(line: str) -> int:
    """Characters of a line that belong to sentences."""
    body = _MARKER.sub("", line, count=1)
    if "](" in body:
        body = _TARGET.sub("]", body)
    if "://" in body or _HOST.search(body):
        body = _URL.sub("", body)
    body = body.strip()
    total = 0
    pieces = [x.strip() for x in _CUT.split(body) if x.strip()]
    for i, p in enumerate(pieces):
        lead = _LEAD.match(p)
        rest = p[lead.end() :] if lead and _START.match(p[lead.end() :]) else p
        rest_text = rest.strip()
        han = 0 if rest_text.isascii() else len(_HAN.findall(rest_text))
        if len(rest_text) < (12 if han >= 6 else 25) or not _START.match(rest):
            continue
        if not _END.search(rest_text) and not (total and i == len(pieces) - 1):  # the text may end in mid-sentence
            continue
        if len(_SPACED.findall(rest_text)) > 1:
            continue
        words = _WORD.findall(rest_text.lower())
        if han < 6 and (len(words) < 5 or len(set(words)) < 0.6 * len(words)):
            continue
        total += len(p)
    return len(line.strip()) if total > 0.6 * len(body) else min(total, len(body))


def stuffed(text: str) -> float:
    """The share of a text's characters in lines of links, repeated words or tags."""
    total = bad = 0
    entries: list[tuple[str, int]] = []  # short lines: first word and length
    for s in filter(None, map(str.strip, text.split("\n"))):
        n = len(s)
        total += n
        if ("://" in s or _HOST.search(s)) and (urls := len(_URL.findall(s))):
            rest = _URL.sub(" ", s)
            if len(_WORD.findall(rest)) + len(_HAN.findall(rest)) // 2 < WORDS_A_LINK * urls:
                bad += n
            continue
        han = 0 if s.isascii() else len(_HAN.findall(s))
        if _STRUCTURE.search(s) or han > 0.3 * n and _STOP.search(s):
            continue
        words, marks = _WORD.findall(s.lower()), len(_MARK.findall(s))
        if marks >= 2 and marks >= MARKS * len(words):
            bad += n
        elif len(words) < 8 and not (han and n >= 30 and _CLOSED.search(s)):
            if not _CLOSED.search(s):
                entries.append((words[0] if words else "", n))
        elif len(words) >= 12 and len(set(words)) < DISTINCT * len(words):
            bad += n
    if len(entries) >= 5 and len({w for w, _ in entries}) < 0.6 * len(entries):
        bad += sum(n for _, n in entries)
    if total < SHORT and "\n" not in text.strip() and not _URL.search(text):  # too short to tell
        return 0.0
    return bad / max(1, total)


def features(text: str) -> tuple[float, ...]:
    """The values of :data:`FEATURES` for one text; shares are of non-blank lines' characters."""
    lines = [x for x in text.split("\n") if x.strip()]
    n = sum(len(x.strip()) for x in lines) or 1
    sentence = code = markup = link = short = 0
    fence = False
    for x in lines:
        s = x.strip()
        if _FENCE.match(x):
            fence = not fence
            code += len(s)
        elif fence:
            code += len(s)
        elif s.startswith("|") and s.endswith("|"):
            markup += len(s)
        elif s[0] in "#![" and _HEAD.match(s):
            markup += len(s)
        else:
            inside = _sentence_chars(x)
            has_url = not inside and ("://" in s or bool(_HOST.search(s))) and bool(_URL.search(s))
            if not inside and not has_url and _CODE.search(x):
                code += len(s)
                continue
            sentence += min(len(s), inside)
            if not inside:
                link += len(s) if has_url else 0
                short += len(s) if len(s) < 60 else 0
    linked = "://" in text or bool(_HOST.search(text))
    urls = _URL.findall(text) if linked else []
    low = text.lower()
    words = _WORD.findall(_URL.sub(" ", low) if linked else low)
    count = Counter(w for w in words if len(w) > 2 and not w.isdigit())
    pairs = len(set(zip(words, words[1:], strict=False)))
    w = max(1, len(words))
    return (
        sentence / n,
        code / n,
        markup / n,
        min(1.0, sum(map(len, urls)) / n),
        100 * len(urls) / n,
        link / n,
        short / n,
        sum(text.count(c) for c in (",", "•", " | ", " / ", " - ", "，", "、")) / w,
        len(count) / max(1, sum(count.values())),
        max(count.values(), default=0) / w,
        1 - pairs / max(1, len(words) - 1) if len(words) > 1 else 0.0,
        len(_UPPER.findall(text)) / len(text),
        len(_DIGIT.findall(text)) / len(text),
        math.log1p(n),
        n / max(1, len(lines)),
    )


def page_features(df: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """(key, host, stuffed, *FEATURES) of each row with a text that isn't blank."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            values = pd.DataFrame([features(t) for t in b["text"]], columns=list(FEATURES), dtype=float)
            values.insert(0, "stuffed", [stuffed(t) for t in b["text"]])
            yield pd.concat([b[["key", "host"]].reset_index(drop=True), values], axis=1)

    rows = df.select(F.col(key).alias("key"), F.col(host).alias("host"), F.col(text).alias("text"))
    rows = rows.where(F.col("text").rlike(r"\S"))
    kind = dict(df.dtypes)[key]
    return spread(rows).mapInPandas(run, f"key {kind}, host string, stuffed double, " + ", ".join(f"{f} double" for f in FEATURES))


def scores(pages: DataFrame) -> DataFrame:
    """``pages`` with ``p``, the smoothed probability of spam."""
    label = F.when(F.col("stuffed") >= SPAM_FROM, 1.0).when(F.col("stuffed") <= CLEAN_TO, 0.0)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(pages.withColumn("label", label))
    labelled = vectors.where("label is not null")
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return pages.withColumn("p", F.coalesce(label, F.lit(0.5)))
    share = min(1.0, TRAIN_ROWS / sum(counts.values()))
    train = labelled.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(1_000_000 * share) + 1).select("vector", "label")
    trees = RandomForestClassifier(
        featuresCol="vector", labelCol="label", numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=LEAF, featureSubsetStrategy="all", seed=7
    ).fit(train)
    scored = trees.transform(vectors).withColumn("q", vector_to_array("probability")[1])
    # a leaf without a counter-example isn't certainty
    clipped = F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col("q")))
    host = F.coalesce("host", F.lit("\0"))
    rates = scored.groupBy(host.alias("h")).agg(F.count("*").alias("pages"), F.avg("q").alias("rate"))
    rate = F.greatest(F.lit(0.02), F.least(F.lit(0.98), F.col("rate")))
    weight = HOST_WEIGHT * F.col("pages") / (F.col("pages") + HOST_HALF)
    odds = (1 - weight) * F.log(clipped / (1 - clipped)) + weight * F.log(rate / (1 - rate))
    return (
        scored.withColumn("h", host)
        .join(rates, "h")
        .withColumn("p", 1 / (1 + F.exp(-odds)))
        .select(*pages.columns, "p")
    )


def spam_pages(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(key, p): the pages that are spam."""
    return scores(cut(page_features(df, key, text, host))).where("p > 0.5").select("key", "p")
