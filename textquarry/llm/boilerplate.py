"""Problem 3: site furniture mixed into the text of web pages.

The stored text is Markdown-like, so each line is written as the markup it stands for - headings,
paragraphs, table cells, list items, links, ``pre`` - and the page is streamed line by line into
the parser of the standard library. The parser's events give, for each line, the characters of
content, those inside links to the own site, and the tags. A label (a line that is no sentence,
heading, table or list item) stands for a link; a link to another site is a citation, not
navigation; headings, cells, code and images stand for a block of fixed size.

The logarithm of the text-to-tag ratio of each line is smoothed over the page with a Gaussian, and
the lines are clustered by a threshold that two-means finds on the page's own smoothed ratios,
within fixed bounds, as some pages have no furniture and some hardly anything else. The cluster
alone decides whether a line is kept.

Templates count as tags: a line that, digits and host name masked, stands on n pages of its site
(or 4 n of all sites) has its tags multiplied by a power of n. These counts are made over all pages
by grouping line hashes in Spark (with map-side combine; a hot line is one group, a count).

Defined results: null, empty and blank texts have no lines; a page without a first-level heading
is judged like any other; the same page delivered twice counts once in the statistics; the
results of :func:`furniture_lines` are distinct.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: width of the Gaussian in lines, and the bounds of the threshold (logarithms of ratios)
SIGMA, LOWEST, HIGHEST = 0.6, 1.1, 2.5
#: a line on n pages counts n to this power times its tags; pages of other sites count for less
POWER, OTHER_SITES = 2.3, 4
#: characters that a block stands for whatever its own length
BLOCKS = {"pre": 60, "td": 60, "img": 60, "cite": 60, "h1": 80, "h2": 60, "h3": 30, "h4": 30, "h5": 30, "h6": 30}
#: blocks that templates don't count against: fence marks and table heads are alike everywhere
_OWN = {"pre", "td", "img", "h1", "h2"}
#: what a linked character counts for in a list, which may be the author's, and the ratio of an empty line
LINKED, EMPTY = 0.1, 0.2
#: the logarithm of a ratio is at least this, so that one line can't outweigh its neighbours
FLOOR = -3.0

_LINK = re.compile(r"\[([^\]\n]*)\]\(([^)\s]*)\)|(https?://[^\s)]+)|\((/[^\s)]*|https?://[^\s)]+)\)")
_HOST = re.compile(r"https?://([^/\s)]+)")
_SENTENCE_END = re.compile(r"""[.!?。！？…；;][)）\]”"'»」]*$""")
_FENCE = re.compile(r"^\s*(```|~~~)")
_LIST = re.compile(r"^\s*(?:[-*+•»·>]|\d+[.)])\s+")
_TABLE = re.compile(r"^\|.*\|$")
_IMAGE = re.compile(r"^!?\[[^\]]*\d+:|^!\[")
_HEADING = re.compile(r"(#{1,6})\s+")
_BARS = tuple(map(escape, (" | ", " › ", " » ", " > ")))


class Events(HTMLParser):
    """Counts, line by line, what the parser reports of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self._open: list[str] = []
        self.next_line()

    def next_line(self) -> None:
        self.text = self.linked = self.tags = 0
        self.block = "pre" if "pre" in self._open else ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.block = tag
        else:
            self.tags += tag in ("a", "i", "li")
        if tag != "img":
            self._open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self._open:
            del self._open[len(self._open) - 1 - self._open[::-1].index(tag) :]

    def handle_data(self, data: str) -> None:
        n = len(data.strip())
        if "a" in self._open:
            self.linked += n * ("li" in self._open)
        else:
            self.text += n


def _inline(body: str) -> str:
    """Links and bars of a line as tags."""
    out, at = [], 0
    for m in _LINK.finditer(body):
        out.append(escape(body[at : m.start()]))
        out.append(f'<a href="{escape(m.group(2) or m.group(3) or m.group(4) or "")}">{escape(m.group(1) or "")}</a>')
        at = m.end()
    html = "".join(out) + escape(body[at:])
    for bar in _BARS:
        if bar in html:
            html = "<i>" + html.replace(bar, "</i><i>") + "</i>"
    return html


def markup(line: str, host: str, fenced: bool) -> str:
    """The markup a line of the stored text stands for; ``fenced``: it stands between fences."""
    s = line.strip()
    if _FENCE.match(line):
        return "</pre>" if fenced else "<pre>"
    if fenced:
        return escape(s)
    if _TABLE.match(s):
        return f"<td>{escape(s)}</td>"
    if _IMAGE.match(s):
        return f'<img alt="{escape(s)}">'
    if m := _HEADING.match(s):
        return f"<h{len(m.group(1))}>{escape(s[m.end() :])}</h{len(m.group(1))}>"
    sentence = bool(_SENTENCE_END.search(s)) or len(s) >= 90
    if m := _LIST.match(s):
        body = s[m.end() :]
        if any(h != host for h in _HOST.findall(s)):
            return f"<li><cite>{escape(body)}</cite></li>"
        return f"<li>{_inline(body)}</li>" if sentence else f"<li><a>{escape(body)}</a></li>"
    return f"<p>{_inline(s)}</p>" if sentence else f"<a>{escape(s)}</a>"


def line_ratios(lines: list[str], copies: list[float], host: str = "") -> np.ndarray:
    """The logarithm of each line's text-to-tag ratio; ``copies`` are the pages a line counts for."""
    events, out, fenced = Events(), np.empty(len(lines)), False
    for i, line in enumerate(lines):
        events.next_line()
        events.feed(markup(line, host, fenced))
        fenced ^= bool(_FENCE.match(line))
        block = events.block
        text = max(events.text, BLOCKS["cite"]) if block == "cite" else BLOCKS.get(block, events.text + LINKED * events.linked)
        tags = 0 if block else events.tags - (events.tags > 1 and events.linked > 0)
        ratio = math.log((text + EMPTY) / (1 + tags))
        out[i] = max(FLOOR, ratio - (0 if block in _OWN else POWER * math.log(max(1.0, copies[i]))))
    return out


def _smooth(x: np.ndarray) -> np.ndarray:
    r = math.ceil(3 * SIGMA)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / SIGMA) ** 2)
    return np.convolve(np.pad(x, r, mode="edge"), k / k.sum(), mode="valid")


def _threshold(x: np.ndarray) -> float:
    """Two-means on the smoothed ratios: the midpoint of the two centres, within its bounds."""
    lo, hi = float(x.min()), float(x.max())
    for _ in range(20):
        mid = (lo + hi) / 2
        low, high = x[x <= mid], x[x > mid]
        if not len(low) or not len(high):
            break
        a, b = float(low.mean()), float(high.mean())
        if (a, b) == (lo, hi):
            break
        lo, hi = a, b
    return min(max((lo + hi) / 2, LOWEST), HIGHEST)


def main_lines(lines: list[str], copies: list[float], host: str = "") -> list[bool]:
    """For each line whether it belongs to the main body."""
    keep = [False] * len(lines)
    at = [i for i, x in enumerate(lines) if x.strip()]
    if at:
        smooth = _smooth(line_ratios([lines[i] for i in at], [copies[i] for i in at], host))
        for i, dense in zip(at, smooth > _threshold(smooth), strict=True):
            keep[i] = bool(dense)
    return keep


def mask(line: Column, host: Column) -> Column:
    """A line as its template has it: without host name, link targets and digits."""
    c = F.when(F.length(host) > 3, F.replace(line, host, F.lit("#"))).otherwise(line)
    c = F.regexp_replace(c, r"https?://[^\s)]+|\(/[^\s)]*\)", "@")
    return F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}@#]+", " "), r"\p{N}+", "0")


def template_lines(pages: DataFrame) -> DataFrame:
    """(h, host, copies): what each masked line, by hash, that isn't single counts for on its site."""
    hashes = F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.xxhash64(mask(x, F.col("host")))))
    by_site = pages.select(F.explode(hashes).alias("h"), "host").groupBy("h", "host").agg(F.count("*").alias("n"))
    over_all = by_site.groupBy("h").agg(F.sum("n").alias("on_pages")).where("on_pages > 1")
    copies = F.greatest(F.col("n").cast("double"), F.col("on_pages") / OTHER_SITES)
    return by_site.join(over_all, "h").select("h", "host", copies.alias("copies")).where("copies > 1")


def site_of(path: Column) -> Column:
    return F.split(path, "/")[2]


def pages_of(df: DataFrame) -> DataFrame:
    """(key, text, host) of the html rows, each page once."""
    host = F.regexp_replace(F.coalesce(site_of(F.col("source_path")), F.lit("")), r"-(?=[^-]*$)", ".")
    return (
        df.where("source_type = 'html' and text is not null")
        .select(F.col("doc_id").alias("key"), "text", host.alias("host"))
        .dropDuplicates(["key"])
    )


def _judge(df: DataFrame, schema: str, row) -> DataFrame:
    """Apply ``row(key, lines, keep)``, which yields tuples of ``schema``, to each html page."""
    pages = pages_of(df)
    per_page = (
        pages.select("key", "host", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        .where(F.trim("line") != "")
        .select("key", "host", "line_no", F.xxhash64(mask(F.col("line"), F.col("host"))).alias("h"))
        .join(template_lines(pages), ["h", "host"])
        .groupBy("key")
        .agg(F.collect_list(F.struct("line_no", "copies")).alias("seen"))
    )
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, host, text, seen in zip(b["key"], b["host"], b["text"], b["seen"], strict=True):
                lines = text.split("\n")
                copies = [1.0] * len(lines)
                for x in seen if seen is not None else ():
                    copies[x["line_no"]] = x["copies"]
                out.extend(row(key, lines, main_lines(lines, copies, host)))
            yield pd.DataFrame(out, columns=names)

    return pages.join(per_page, "key", "left").select("key", "host", "text", "seen").mapInPandas(run, schema)


def furniture_lines(df: DataFrame) -> DataFrame:
    """(key, line_no) of each non-blank line of an html page that isn't main body."""
    return _judge(
        df,
        "key string, line_no bigint",
        lambda key, lines, keep: [(key, i) for i, x in enumerate(lines) if x.strip() and not keep[i]],
    )


def main_text(df: DataFrame) -> DataFrame:
    """(key, text): each html page with its main body only, blank lines collapsed."""

    def row(key: str, lines: list[str], keep: list[bool]) -> list[tuple[str, str]]:
        text = "\n".join(x for x, k in zip(lines, keep, strict=True) if k or not x.strip())
        return [(key, re.sub(r"\n{3,}", "\n\n", text).strip())]

    return _judge(df, "key string, text string", row)
