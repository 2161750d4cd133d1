"""The manifest of extracted images and its garbage collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def updated(manifest: DataFrame, sources: DataFrame, images: DataFrame) -> DataFrame:
    """The manifest after ``sources`` (source_path) were read again and gave ``images``."""
    kept = manifest.join(sources.select("source_path").distinct(), "source_path", "left_anti")
    return kept.unionByName(images.where("local_path <> ''").select(*manifest.columns))


def dropped(manifest: DataFrame, stays: DataFrame) -> DataFrame:
    """The entries of the manifest that :func:`collect` doesn't keep."""
    return manifest.join(stays.select("local_path"), "local_path", "left_anti")


def collect(manifest: DataFrame, active: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entries that stay, and the files to delete: (local_path).

    An entry goes if its source is no longer a document or its file is missing; a file goes if no
    remaining entry names it, unless it is a text beside an image.
    """
    alive = manifest.join(active.select("source_path").distinct(), "source_path", "left_semi")
    stays = alive.join(files.select("local_path").distinct(), "local_path", "left_semi")
    orphans = files.select("local_path").distinct().where(~F.lower("local_path").rlike(r"\.(txt|md)$"))
    return stays, orphans.join(stays.select("local_path"), "local_path", "left_anti")
