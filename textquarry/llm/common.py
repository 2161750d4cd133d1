"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the files."""
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """A scan whose rows cost far more than reading them, on all cores of the session.

    Only a table of too few files to occupy them is dealt out; a larger one is never shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table below the checkpoint folder and read it again.

    Like :func:`cut`, but columnar and compressed, for larger results that are read several times.
    The table is removed when the session ends.
    """
    path = f"{_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _remove_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    """Leave the removal to the file system that holds ``path``, when the driver's JVM ends."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def _folder(spark: SparkSession) -> str:
    """The folder all executors share: the session's own, or ``spark.checkpoint.dir``.

    A session on one machine may go without and gets a temporary one; on a cluster that would be
    another folder on each machine, so there the setting is required.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="textquarry-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()
