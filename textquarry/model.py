"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGE = (
    "struct<index: int, src: string, alt: string, title: string, local_path: string, mime_type: string, "
    "extracted: boolean, sha256: string, size_bytes: bigint, width: int, height: int, ocr_text: string, "
    "description: string>"
)
METADATA = f"struct<parser: string, language: string, page_count: int, table_count: int, images: array<{IMAGE}>>"
PARSED = (
    "doc_id string, source_path string, source_type string, title string, text string, sha256 string, "
    f"size_bytes bigint, mtime double, metadata {METADATA}, error string"
)
DOCUMENTS = (
    "doc_id string, source_path string, source_type string, title string, sha256 string, size_bytes bigint, "
    f"mtime double, created_at timestamp, updated_at timestamp, metadata {METADATA}"
)
CHUNKS = (
    "chunk_id string, doc_id string, source_path string, source_type string, title string, section string, "
    f"chunk_index bigint, text string, metadata {METADATA}"
)
MEDIA = f"local_path string, source_path string, image {IMAGE}"

# File suffixes and the source type each stands for.
SUFFIXES = {
    "html": (".html", ".htm"),
    "markdown": (".md", ".markdown"),
    "text": (".txt",),
    "pdf": (".pdf",),
    "docx": (".docx",),
    "code": (".smali", ".java", ".kt", ".js", ".ts", ".py", ".json", ".xml", ".c", ".cpp", ".h", ".hpp"),
}

#: every character Python's str.strip removes
SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
MAX_CHARS, OVERLAP_CHARS, TOP_K, MAX_TERMS = 1200, 160, 5, 8000


def doc_id_of(source_path: Column) -> Column:
    return F.sha2(source_path, 256)


def chunk_id_of(doc_id: Column, chunk_index: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws(":", doc_id, chunk_index.cast("string"), text), 256)


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def source_type_of(path: Column) -> Column:
    """Source type by suffix; null for files that aren't ingested."""
    c = None
    for kind, suffixes in SUFFIXES.items():
        hit = suffix_of(path).isin(*suffixes)
        c = F.when(hit, kind) if c is None else c.when(hit, kind)
    return c


def stem_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
