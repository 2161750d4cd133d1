"""Reading a corpus folder: binary files to parsed documents.

Files are read as a binary table and parsed in tasks, a batch of files at a time; a file that can't
be parsed gives a row with ``error`` and no text, so one bad file never fails a run.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions.encoding import decoded
from textquarry.model import PARSED, source_type_of
from textquarry.sources import html, office

#: texts beside an image, by priority
OCR_SUFFIXES, DESCRIPTION_SUFFIXES = (".ocr.txt", ".txt"), (".desc.txt", ".description.txt", ".md")


def scan(spark: SparkSession, corpus: str, root: str) -> DataFrame:
    """(source_path, source_type, content, size_bytes, mtime) of all supported files below ``corpus``.

    ``source_path`` is relative to ``root``. The suffix filter only needs the path, so contents of
    other files are never read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(corpus)
    return relative(files, root)


def relative(files: DataFrame, root: str) -> DataFrame:
    base = "file:" + root.rstrip("/") + "/" if "://" not in root and not root.startswith("file:") else root.rstrip("/") + "/"
    path = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")
    kind = source_type_of(F.col("path"))
    return files.where(kind.isNotNull()).select(
        F.replace(path, F.lit(base), F.lit("")).alias("source_path"),
        kind.alias("source_type"),
        "content",
        F.col("length").alias("size_bytes"),
        (F.unix_micros("modificationTime").cast("double") / 1e6).alias("mtime"),
    )


def stem(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[0] if "." in name[1:] else name


def parse_file(source_path: str, source_type: str, data: bytes, folder: str = "data/images", beside=None) -> tuple[dict, list[tuple[str, bytes]]]:
    """The text, title and metadata of one file, and the images found inside."""
    meta = {"parser": source_type, "language": None, "page_count": None, "table_count": None, "images": []}
    found: list[tuple[str, bytes]] = []
    title = stem(source_path)
    if source_type == "html":
        page = html.read(decoded(data), source_path, folder, beside)
        text, title, found = page.text, page.title or title, page.files
        meta |= {"table_count": page.tables, "images": page.images}
    elif source_type == "pdf":
        text, meta["parser"] = office.pdf_text(data), "pdf-basic"
    elif source_type == "docx":
        text, own = office.docx_text(data)
        title = own or title
    else:
        text = decoded(data).strip()
        if source_type == "code":
            meta["language"] = source_path.rsplit(".", 1)[-1].lower()
    return {"title": title, "text": text, "metadata": meta}, found


def parse(files: DataFrame, folder: str = "data/images", sidecars: DataFrame | None = None) -> DataFrame:
    """Parsed documents of (source_path, source_type, content, size_bytes, mtime).

    ``sidecars`` (source_path, texts map<string, string>) holds the texts beside images of a source.
    """
    with_texts = files.join(sidecars, "source_path", "left") if sidecars is not None else files.withColumn("texts", F.lit(None).cast("map<string,string>"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, kind, content, size, mtime, texts in zip(
                b["source_path"], b["source_type"], b["content"], b["size_bytes"], b["mtime"], b["texts"], strict=True
            ):
                data = bytes(content)
                row = {
                    "doc_id": hashlib.sha256(path.encode()).hexdigest(), "source_path": path, "source_type": kind,
                    "sha256": hashlib.sha256(data).hexdigest(), "size_bytes": size, "mtime": mtime, "error": None,
                }
                try:
                    row |= parse_file(path, kind, data, folder, _beside(dict(texts) if texts is not None else {}))[0]
                except Exception as e:  # noqa: BLE001 - any file may be broken in any way
                    row |= {"title": None, "text": None, "metadata": None, "error": f"{type(e).__name__}: {e}"}
                out.append(row)
            yield pd.DataFrame(out, columns=[re.split(r"[ ]", c)[0] for c in _columns()])

    return with_texts.select("source_path", "source_type", "content", "size_bytes", "mtime", "texts").mapInPandas(run, PARSED)


def _columns() -> list[str]:
    return ["doc_id", "source_path", "source_type", "title", "text", "sha256", "size_bytes", "mtime", "metadata", "error"]


def _beside(texts: dict[str, str]):
    def find(local_path: str) -> tuple[str, str]:
        pick = lambda suffixes: next((texts[local_path + s].strip() for s in suffixes if local_path + s in texts), "")
        return pick(OCR_SUFFIXES), pick(DESCRIPTION_SUFFIXES)

    return find


def inline_images(files: DataFrame, folder: str = "data/images") -> DataFrame:
    """(local_path, source_path, content): the bytes of the images inside html files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["source_path"], b["content"], strict=True):
                page = html.read(decoded(bytes(content)), path, folder)
                rows.extend((p, path, d) for p, d in page.files)
            yield pd.DataFrame(rows, columns=["local_path", "source_path", "content"])

    pages = files.where("source_type = 'html'").select("source_path", "content")
    return pages.mapInPandas(run, "local_path string, source_path string, content binary")

