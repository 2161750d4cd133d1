"""Decoding of bytes whose encoding isn't known."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.functions.text import GARBLE_MARKERS, GARBLE_SAMPLE

_MARKERS = frozenset(GARBLE_MARKERS)


def garble_score(text: str) -> int:
    s = text[:GARBLE_SAMPLE]
    if s.isascii():
        return 0
    return 4 * sum(map(_MARKERS.__contains__, s)) + s.count("�") + 3 * (s.count("Ã") + s.count("Â") + s.count("â€"))


def repaired(text: str) -> str:
    """The text, or what it was before being decoded as GBK where that is clearly better."""
    score = garble_score(text)
    if score < 2:
        return text
    for codec in ("gb18030", "gbk", "cp936"):
        other = text.encode(codec, "replace").decode("utf-8", "replace")
        if 3 * garble_score(other) < score:
            return other
    return text


def decoded(data: bytes) -> str:
    """Text of a file: UTF-8 (a byte order mark stays), else GB 18030, else Latin-1; repaired."""
    for codec in ("utf-8", "gb18030"):
        try:
            return repaired(data.decode(codec))
        except UnicodeDecodeError:
            pass
    return repaired(data.decode("latin-1"))


@F.pandas_udf(T.StringType())
def _decode(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else decoded(bytes(b)))


def decode_text(content: Column) -> Column:
    return _decode(content)

