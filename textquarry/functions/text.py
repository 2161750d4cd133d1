"""Text functions as Spark expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from textquarry.model import SPACE

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: characters of a word besides letters and digits
WORD_SIGNS = r"_.$/@:#-"
INDEX_TOKEN = rf"[\p{{L}}\p{{N}}\p{{Co}}{WORD_SIGNS}]+"
QUERY_TOKEN = r"[A-Za-z0-9_.$/@:#-]+|[\x{4e00}-\x{9fff}]+"
TERM_TOKEN = r"[A-Za-z0-9_.$/@:#-]{2,}"
HAN_RUN = r"[\x{4e00}-\x{9fff}]+"
SPACES = "".join(rf"\x{{{ord(c):x}}}" for c in SPACE)


def _accents() -> tuple[str, str]:
    """Latin letters with diacritics and the letters left without them."""
    pairs = {}
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(cp).lower())
        if len(base) > 1 and base[0].isascii() and base[0].isalpha():
            pairs[chr(cp)] = base[0]
    return "".join(pairs), "".join(pairs.values())


ACCENTED, PLAIN = _accents()
MARKS = "".join(map(chr, range(0x300, 0x332)))


def strip(c: Column) -> Column:
    """Without white space at both ends, as Unicode defines it."""
    return F.trim(c, F.lit(SPACE))


def ascii_lower(c: Column) -> Column:
    """Lower case for ASCII letters only, which is what LIKE ignores."""
    return F.translate(c, UPPER, LOWER)


def folded(c: Column) -> Column:
    """Lower case without Latin diacritics."""
    return F.translate(F.translate(F.lower(c), ACCENTED, PLAIN), MARKS, "")


def index_tokens(c: Column) -> Column:
    """Tokens of the full-text index: folded, signs kept in words."""
    return F.coalesce(F.regexp_extract_all(folded(c), F.lit(INDEX_TOKEN), F.lit(0)), F.array().cast("array<string>"))


def fold_token(token: str) -> str:
    """The index form of one query token."""
    return token.lower().translate(str.maketrans(ACCENTED, PLAIN, MARKS))


def query_tokens(query: str) -> list[str]:
    return re.findall(r"[A-Za-z0-9_.$/@:#-]+|[一-鿿]+", query)


def has_han(text: str) -> bool:
    return re.search("[一-鿿]", text) is not None


def han_grams(run: str) -> list[str]:
    """The n-grams under which a run of Han characters is indexed: sizes 2 to 4 and the whole run."""
    if len(run) <= 2:
        return [run]
    return sorted({run, *(run[i : i + n] for n in (2, 3, 4) for i in range(len(run) - n + 1))})


def term_groups(query: str) -> list[list[str]]:
    """One group of alternative terms for each token of the query."""
    return [han_grams(t) if has_han(t) else [t.lower()] for t in query_tokens(query)]


def han_grams_of(run: Column) -> Column:
    """The same n-grams as an expression, not sorted."""
    sizes = F.filter(F.array(F.lit(2), F.lit(3), F.lit(4)), lambda n: n <= F.char_length(run))
    grams = F.flatten(
        F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.char_length(run) - n + 1), lambda i: F.substring(run, i, n)))
    )
    return F.when(F.char_length(run) <= 2, F.array(run)).otherwise(F.array_append(grams, run))


def terms_of(c: Column) -> Column:
    """All terms of one text: ASCII tokens of at least two characters and Han n-grams; distinct."""
    c = F.coalesce(c, F.lit(""))
    words = F.regexp_extract_all(F.translate(c, UPPER, LOWER), F.lit(TERM_TOKEN), F.lit(0))
    grams = F.flatten(F.transform(F.regexp_extract_all(c, F.lit(HAN_RUN), F.lit(0)), han_grams_of))
    return F.array_distinct(F.concat(words, grams))


def chunk_terms(texts: list[Column], max_terms: int) -> Column:
    """Sorted terms of several texts; a text is left out if those before it fill ``max_terms``."""
    none = F.array().cast("array<string>")
    # a fold evaluates each text once, where nested conditions would repeat the earlier ones
    fill = lambda acc, more: F.when(F.size(acc) >= max_terms, acc).otherwise(F.array_union(acc, more))
    terms = F.aggregate(F.array(*(terms_of(t) for t in texts)), none, fill)
    return F.slice(F.array_sort(terms), 1, max_terms)


# Characters that are frequent in UTF-8 text decoded as GBK and rare in right text.
GARBLE_MARKERS = "鏌钖疉椋帶鍙傛暟鍒嗘瀽鍘熷垱瀛ｄ笢骞鏈鏃姹熻嫃寰绯诲垪猻浼氫粠澶村紑濮嬶紝鑻ユ姄鍖呮垨鑰呭叾瀹冨彲浠ョ湅涔嬪墠鐨勬枃绔狅"
GARBLE_SAMPLE = 1_000_000


def garble_score(c: Column) -> Column:
    """How much a text looks like wrongly decoded: weighted counts of typical characters."""
    s = F.substring(c, 1, GARBLE_SAMPLE)
    count = lambda chars: F.char_length(s) - F.char_length(F.translate(s, chars, ""))
    pairs = (F.char_length(s) - F.char_length(F.replace(s, F.lit("â€")))) / 2
    return (4 * count(GARBLE_MARKERS) + count("�") + 3 * (count("ÃÂ") + pairs)).cast("bigint")


def one_line(text: str, limit: int) -> str:
    line = " ".join(text.split())
    return line if len(line) <= limit else line[: limit - 3] + "..."
