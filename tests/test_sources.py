import io
import struct
import zipfile
import zlib

import pytest

from textquarry.functions.encoding import decoded, repaired
from textquarry.sources import html, images, office

PNG = "data:image/png;base64,iVBORw0KGgo="


def page(body, **kw):
    return html.read(f"<html><body>{body}</body></html>", "corpus/a.html", **kw)


def test_headings_links_and_skipped():
    p = html.read("<title> T </title><nav>no</nav><h2>Head</h2><p>a <a href='/x'>link</a></p><pre>code</pre><script>no</script><code>c</code>")
    assert p.title == "T"
    assert p.text == "## Head\n\na link (/x)\n\n```text\ncode\n```\n`c`"


def test_white_space_only_data_is_dropped():
    assert page("<b>a</b> <i>b</i>").text == "ab"


def test_unfinished_tail_is_lost():
    assert html.read("<p>a</p><b").text == "a"


def test_double_unescape():
    assert page("<p>&amp;lt;x&amp;gt;</p>").text == "<x>"


def test_table_spans_and_caption():
    t = (
        "<table><caption>字段表</caption><tr><th>参数</th><th>含义</th></tr>"
        "<tr><td rowspan='2'>x-mini-sig</td><td colspan='1'>签名</td></tr><tr><td>第二行|x</td></tr></table>"
    )
    p = page(t)
    assert p.tables == 1
    assert p.text == "Table: 字段表\n\n| 参数 | 含义 |\n| --- | --- |\n| x-mini-sig | 签名 |\n| x-mini-sig | 第二行\\|x |"


def test_spans_are_clamped():
    assert page("<table><tr><td colspan='99'>a</td></tr></table>").text.count("a") == 50
    assert page("<table><tr><td colspan='x'>a</td></tr></table>").text == "| a |"


def test_inline_image_and_texts_beside_it():
    p = page(f"<p><img src='{PNG}' alt='流程图'></p>")
    (path, data), = p.files
    assert data == b"\x89PNG\r\n\x1a\n" and path.startswith("data/images/") and path.endswith(".png")
    assert p.images[0]["src"] == "[inline-image]" and p.images[0]["mime_type"] == "image/png"
    assert p.text.startswith("[Image 1: 流程图] path=data/images/")
    again = page(f"<img src='{PNG}' alt='流程图'>", beside=lambda _: ("seen  text", "what it shows"))
    assert "ocr=seen text" in again.text and "description=what it shows" in again.text


def test_linked_image():
    p = page("<img data-src='a.png' title='t'>")
    assert p.text == "[Image 1: t] src=a.png\n![t](a.png)"


@pytest.mark.parametrize(
    "data,mime",
    [
        (b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 30, 20), "image/png"),
        (b"GIF89a" + struct.pack("<HH", 30, 20), "image/gif"),
        (b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 20, 30) + b"\0" * 8, "image/jpeg"),
        (b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (29).to_bytes(3, "little") + (19).to_bytes(3, "little"), "image/webp"),
        (b"RIFF\0\0\0\0WEBPVP8 " + b"\0" * 10 + struct.pack("<HH", 30, 20), "image/webp"),
        (b"RIFF\0\0\0\0WEBPVP8L" + b"\0" * 5 + (29 | 19 << 14).to_bytes(4, "little"), "image/webp"),
    ],
)
def test_dimensions(data, mime):
    assert images.dimensions(data, mime) == (30, 20)
    assert images.dimensions(data[:7], mime) == (None, None)


def docx(body, title=None):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="urn:w"><w:body>{body}</w:body></w:document>')
        if title:
            z.writestr("docProps/core.xml", f'<c xmlns:d="urn:d"><d:title>{title}</d:title></c>')
    return buf.getvalue()


def test_docx():
    p = "<w:p><w:r><w:t>JNI_OnLoad</w:t><w:tab/><w:t>RegisterNatives</w:t></w:r></w:p>"
    t = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc/><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    assert office.docx_text(docx(p + t, "sample")) == ("JNI_OnLoad\tRegisterNatives\n\na | b", "sample")


def test_pdf():
    wrap = lambda s: b"%PDF-1.4\nstream\n" + s + b"\nendstream\n%%EOF"
    assert office.pdf_text(wrap(b"(JNI_OnLoad RegisterNatives) Tj")) == "JNI_OnLoad RegisterNatives"
    assert office.pdf_text(wrap(zlib.compress(b"[(a) -3 (b\\)c)] TJ (first) Tj"))) == "first a b)c"
    assert office.pdf_text(wrap(rb"(a\\nb) Tj")) == "a\nb"
    assert "a readable line of more than 24" in office.pdf_text(b"\x00a readable line of more than 24 letters\x01\nshort")


def test_decoding():
    assert decoded("﻿a".encode()) == "﻿a"
    assert decoded("设备指纹".encode("gb18030")) == "设备指纹"
    assert decoded(b"\xff\xfe\xfd") == "ÿþý"
    garbled = "人工智能分析报告".encode().decode("gb18030", "replace")
    assert repaired("plain") == "plain" and repaired(garbled).startswith("人")


def test_grid():
    cell = lambda t, c=1, r=1: f"<td colspan='{c}' rowspan='{r}'>{t}</td>"
    t = f"<table><tr>{cell('a', 1, 3)}{cell('b', 2)}</tr><tr>{cell('c')}{cell('d')}</tr><tr></tr><tr>{cell('e')}</tr></table>"
    assert page(t).text == "| a | b | b |\n| --- | --- | --- |\n| a | c | d |\n| a |  |  |\n| e |  |  |".replace("|  |  |", "| | |")
    nested = "<table><tr><td>x<table><tr><td>y</td></tr></table></td></tr></table>"
    assert page(nested).tables == 1 and "y" in page(nested).text
    assert page("<table><tr><td> </td></tr></table>").tables == 0
