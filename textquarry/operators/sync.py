"""Incremental maintenance: what changed, what to keep, what to drop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(stored: DataFrame, current: DataFrame, indexed_docs: DataFrame | None = None) -> DataFrame:
    """(source_path, status) of every path: new, changed, unchanged or deleted.

    A document is unchanged if hash and size are equal and, where ``indexed_docs`` (doc_id) is
    given, it has at least one indexed term. Both sides need one row for each path.
    """
    old = stored.select("source_path", F.col("doc_id").alias("old_id"), F.col("sha256").alias("old_sha"), F.col("size_bytes").alias("old_size"))
    if indexed_docs is not None:
        marked = indexed_docs.select(F.col("doc_id").alias("old_id")).distinct().withColumn("has_terms", F.lit(True))
        old = old.join(marked, "old_id", "left")
    else:
        old = old.withColumn("has_terms", F.lit(True))
    new = current.select("source_path", F.col("sha256").alias("new_sha"), F.col("size_bytes").alias("new_size"), F.lit(True).alias("here"))
    same = (F.col("old_sha") == F.col("new_sha")) & (F.col("old_size") == F.col("new_size")) & F.coalesce("has_terms", F.lit(False))
    return old.join(new, "source_path", "full_outer").select(
        "source_path",
        F.when(F.col("here").isNull(), "deleted")
        .when(F.col("old_id").isNull(), "new")
        .when(F.coalesce(same, F.lit(False)), "unchanged")
        .otherwise("changed")
        .alias("status"),
    )


#: what a run counts, in the order it is reported
COUNTERS = ("seen", "indexed", "skipped", "chunks", "deleted", "media_deleted_files", "media_deleted_entries", "failed")


def counters(changes: DataFrame, chunks: DataFrame, deleted_files: DataFrame, deleted_entries: DataFrame) -> DataFrame:
    """One row with :data:`COUNTERS`.

    ``changes`` has the status of all paths, also ``failed``; ``chunks`` are those of new and
    changed documents; the others are the media files and manifest entries that go.
    """
    n = lambda *s: F.coalesce(F.sum(F.col("status").isin(*s).cast("int")), F.lit(0)).cast("bigint").alias
    by_status = changes.agg(
        n("new", "changed", "unchanged", "failed")("seen"), n("new", "changed")("indexed"), n("unchanged")("skipped"),
        n("deleted")("deleted"), n("failed")("failed"),
    )
    one = by_status
    for name, rows in (("chunks", chunks), ("media_deleted_files", deleted_files), ("media_deleted_entries", deleted_entries)):
        one = one.crossJoin(rows.agg(F.count("*").alias(name)))  # one row each
    return one.select(*COUNTERS)


def merged(stored: DataFrame, current: DataFrame, changes: DataFrame, now: str) -> DataFrame:
    """The documents after a run: kept rows, and new or changed ones with ``created_at`` preserved."""
    stays = changes.where("status = 'unchanged'").select("source_path")
    fresh = changes.where("status in ('new', 'changed')").select("source_path")
    kept = stored.join(stays, "source_path", "left_semi")
    born = stored.select("source_path", F.col("created_at").alias("born"))
    at = F.lit(now).cast("timestamp")
    extra = [c for c in stored.columns if c not in ("created_at", "updated_at")]
    written = (
        current.join(fresh, "source_path", "left_semi")
        .join(born, "source_path", "left")
        .select(*extra, F.coalesce("born", at).alias("created_at"), at.alias("updated_at"))
    )
    return kept.select(*written.columns).unionByName(written)


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among those gone; the cascade of a deletion."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def latest(rows: DataFrame, key: str, at: str, tie: str = "sha256") -> DataFrame:
    """One row for each key: the one delivered last."""
    whole = F.struct(*(F.col(c) for c in rows.columns))
    return rows.groupBy(key).agg(F.max_by(whole, F.struct(F.col(at), F.col(tie))).alias("r")).select("r.*")
