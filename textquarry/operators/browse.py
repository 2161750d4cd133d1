"""Document listing, outlines, sections and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions.text import ascii_lower


def like(c: Column, pattern: str) -> Column:
    """LIKE as selectors use it: wildcards count, ASCII case doesn't, null never matches."""
    return F.coalesce(ascii_lower(c).like(pattern.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))), F.lit(False))


def list_documents(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, source_path, source_type, title, chunk_count, updated_at), by type and path.

    Chunks are counted before the join; documents without chunks stay with 0.
    """
    counts = chunks.groupBy("doc_id").agg(F.count("chunk_id").alias("chunk_count"))
    return (
        docs.join(counts, "doc_id", "left")
        .select("doc_id", "source_path", "source_type", "title", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), "updated_at")
        .orderBy("source_type", "source_path")
    )


def resolve(docs: DataFrame, selector: str) -> DataFrame:
    """(doc_id) of the one document a selector means: id, else path, else part of path or title."""
    part = f"%{selector}%"
    rank = F.when(F.col("doc_id") == selector, 0).when(F.col("source_path") == selector, 1).otherwise(2)
    hit = (F.col("doc_id") == selector) | (F.col("source_path") == selector) | like(F.col("source_path"), part) | like(F.col("title"), part)
    return docs.where(hit).orderBy(rank, "source_path", "doc_id").limit(1).select("doc_id")


def outline(docs: DataFrame, chunks: DataFrame, selector: str) -> DataFrame:
    """(section, first_chunk, chunk_count) of a document; equal section names are one row."""
    own = chunks.join(F.broadcast(resolve(docs, selector)), "doc_id", "left_semi")  # one row
    return own.groupBy("section").agg(F.min("chunk_index").alias("first_chunk"), F.count("*").alias("chunk_count")).orderBy("first_chunk")


def outlines(chunks: DataFrame) -> DataFrame:
    """The outlines of all documents: (doc_id, section, first_chunk, chunk_count)."""
    return chunks.groupBy("doc_id", "section").agg(F.min("chunk_index").alias("first_chunk"), F.count("*").alias("chunk_count"))


def document_chunks(docs: DataFrame, chunks: DataFrame, selector: str, section: str | None = None, limit: int | None = None) -> DataFrame:
    """The chunks of a document in order, those with a fragment in section or text if asked."""
    own = chunks.join(F.broadcast(resolve(docs, selector)), "doc_id", "left_semi")  # one row
    if section:
        own = own.where(like(F.col("section"), f"%{section}%") | like(F.col("text"), f"%{section}%"))
    own = own.orderBy("chunk_index", "chunk_id")
    return own.limit(limit) if limit else own


def by_type(docs: DataFrame) -> DataFrame:
    """(source_type, documents), by type."""
    return docs.groupBy("source_type").agg(F.count("*").alias("documents")).orderBy("source_type")


def by_type_line(docs: DataFrame) -> DataFrame:
    """(by_type): the same in one line, ``none`` for no documents."""
    rows = F.array_sort(F.collect_list(F.struct("source_type", "documents")))
    line = F.array_join(F.transform(rows, lambda r: F.concat_ws("=", r["source_type"], r["documents"].cast("string"))), ", ")
    return by_type(docs).agg(line.alias("line")).select(F.when(F.col("line") == "", "none").otherwise(F.col("line")).alias("by_type"))


def status(**tables: DataFrame) -> DataFrame:
    """(name, rows) of each table, and of the documents of each type as ``documents: type``."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    if "documents" in tables:
        types = tables["documents"].groupBy("source_type").agg(F.count("*").alias("rows"))
        out = out.unionByName(types.select(F.concat(F.lit("documents: "), F.coalesce("source_type", F.lit("none"))).alias("name"), "rows"))
    return out
