"""Inverted index and term index as ordinary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions.text import chunk_terms, index_tokens
from textquarry.model import MAX_TERMS

FIELDS = ("title", "section", "text")


def tokens_of_chunk() -> Column:
    """All tokens of the three indexed fields."""
    return F.concat(*(index_tokens(F.coalesce(F.col(c), F.lit(""))) for c in FIELDS))


def postings(chunks: DataFrame) -> DataFrame:
    """(term, chunk_id, tf): how often each token occurs in each chunk."""
    return (
        chunks.select("chunk_id", F.explode(tokens_of_chunk()).alias("term"))
        .groupBy("term", "chunk_id")
        .agg(F.count("*").cast("int").alias("tf"))
    )


def lengths(chunks: DataFrame) -> DataFrame:
    """(chunk_id, dl): tokens in each chunk."""
    return chunks.select("chunk_id", F.size(tokens_of_chunk()).alias("dl"))


def terms(chunks: DataFrame, max_terms: int = MAX_TERMS) -> DataFrame:
    """(term, chunk_id): the terms of title, section, text and path of each chunk; distinct."""
    texts = [F.coalesce(F.col(c), F.lit("")) for c in ("title", "section", "text", "source_path")]
    return chunks.select(F.explode(chunk_terms(texts, max_terms)).alias("term"), "chunk_id")


def vocabulary(chunks: DataFrame) -> DataFrame:
    """(term, chunks, occurrences) of the full-text index."""
    return postings(chunks).groupBy("term").agg(F.count("*").alias("chunks"), F.sum("tf").alias("occurrences"))
