"""Text of DOCX and PDF files; the standard library is enough for both."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.etree import ElementTree as ET


def docx_text(data: bytes) -> tuple[str, str]:
    """(text, title): paragraphs and tables of the body, blocks joined by blank lines."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        title = ""
        if "docProps/core.xml" in z.namelist():
            found = (e.text.strip() for e in ET.fromstring(z.read("docProps/core.xml")).iter() if e.tag.endswith("title") and e.text)
            title = next(found, "")
        root = ET.fromstring(z.read("word/document.xml"))
    body = next((e for e in root if e.tag.endswith("body")), root)
    blocks = []
    for e in body:
        if e.tag.endswith("p"):
            blocks.append(_run_text(e))
        elif e.tag.endswith("tbl"):
            rows = [[t for c in r if c.tag.endswith("tc") and (t := _run_text(c))] for r in e.iter() if r.tag.endswith("tr")]
            blocks.append(_grid([r for r in rows if r]))
    return "\n\n".join(filter(None, blocks)).strip(), title


def _run_text(node: ET.Element) -> str:
    signs = {"tab": "\t", "br": "\n"}
    out = []
    for e in node.iter():
        if e.tag.endswith("t") and e.text:
            out.append(e.text)
        else:
            out.extend(s for end, s in signs.items() if e.tag.endswith(end))
    return "".join(out).strip()


def _grid(rows: list[list[str]]) -> str:
    width = max(map(len, rows), default=0)
    return "\n".join(" | ".join(r + [""] * (width - len(r))) for r in rows)


_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_LITERAL = r"\((?:\\.|[^\\)])*\)"
_SHOW, _SHOW_MANY = re.compile(rf"({_LITERAL})\s*Tj"), re.compile(r"\[(.*?)\]\s*TJ", re.S)
#: what a page of plain text may hold: printable ASCII, tabs and Han characters
_UNREADABLE = re.compile(r"[^\x09\x0a\x0d\x20-\x7e一-鿿]+")


def pdf_text(data: bytes) -> str:
    """The strings that the content streams show; without any, the readable lines of the file."""
    texts = []
    for m in _STREAM.finditer(data):
        raw = m.group(1)
        try:
            shown = _shown(zlib.decompress(raw)) or _shown(raw)
        except zlib.error:
            shown = _shown(raw)
        texts.append(shown)
    found = "\n\n".join(filter(None, texts))
    return found or "\n".join(_readable(data.decode("latin-1")))


def _shown(stream: bytes) -> str:
    s = stream.decode("latin-1")
    literals = _SHOW.findall(s) + [x for many in _SHOW_MANY.findall(s) for x in re.findall(_LITERAL, many)]
    return " ".join(filter(None, (_unescaped(x[1:-1]) for x in literals))).strip()


def _unescaped(s: str) -> str:
    # the order counts: an escaped backslash before n becomes a line end
    for a, b in ((r"\(", "("), (r"\)", ")"), (r"\\", "\\"), (r"\n", "\n"), (r"\r", "\n"), (r"\t", "\t")):
        s = s.replace(a, b)
    return s


def _readable(text: str) -> list[str]:
    lines = (_UNREADABLE.sub(" ", x).strip() for x in text.splitlines())
    return [x for x in lines if len(x) >= 24 and sum(map(str.isalpha, x)) >= 8]
