"""The index folder: one Parquet table a relation, in buckets, as versions behind a pointer.

Documents and all that derives from them lie in buckets by a hash of ``doc_id``. A run writes a new
version of the buckets that its changes touch and then replaces the pointer file by one atomic
rename, so readers see the old or the new state, never a mixture or none; a run that fails leaves
only unreferenced folders. Folders that neither the current nor the previous pointer names are
removed after a run.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.model import CHUNKS, DOCUMENTS, MEDIA

#: relations in buckets; postings and terms carry the bucket of their chunk
BUCKETED = {
    "documents": DOCUMENTS,
    "chunks": CHUNKS,
    "postings": "term string, chunk_id string, tf int",
    "lengths": "chunk_id string, dl int",
    "terms": "term string, chunk_id string",
}
#: the image manifest is written as a whole
WHOLE = {"media": MEDIA}
TABLES = {**BUCKETED, **WHOLE}
BUCKETS = 64


def bucket_of(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(BUCKETS)).cast("int")


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # --- files ---

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        return self._files().exists(self._path(name))

    def pointer(self) -> dict:
        """{"tables": {table: {bucket: version}}, "previous": [versions]}."""
        if not self._exists("CURRENT"):
            return {"tables": {t: {} for t in TABLES}, "previous": []}
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.path}/CURRENT").collect()))

    def _point(self, pointer: dict) -> None:
        out = self._files().create(self._path("NEXT"), True)
        out.write(bytearray(json.dumps(pointer).encode()))
        out.close()
        jvm = self.spark._jvm
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files().getUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(context.makeQualified(self._path("NEXT")), context.makeQualified(self._path("CURRENT")), how)

    # --- tables ---

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table of the current version, or some of its buckets; empty before the first run."""
        at = self.pointer()["tables"][name]
        wanted = None if buckets is None else set(map(str, buckets))
        folders = [f"{self.path}/{v}/{name}/bucket={b}" for b, v in at.items() if wanted is None or b in wanted]
        empty = self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(empty.schema).parquet(*folders) if folders else empty

    def write(self, touched: list[int], **tables: DataFrame) -> str:
        """Write a new version of the ``touched`` buckets, and of the whole tables, and make it current.

        Bucketed tables come with a column ``bucket`` and hold rows of touched buckets only.
        """
        version, old = f"v{time.time_ns()}", self.pointer()
        new = {t: dict(v) for t, v in old["tables"].items()}
        for name, df in tables.items():
            buckets = touched if name in BUCKETED else [0]
            if name in WHOLE:
                df = df.withColumn("bucket", F.lit(0))
            elif name in ("postings", "terms"):  # sorted, so that row groups can be skipped by term
                df = df.repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term")
            else:
                df = df.repartitionByRange("bucket", "doc_id" if "doc_id" in df.columns else "chunk_id")
            if buckets:
                df.write.partitionBy("bucket").parquet(f"{self.path}/{version}/{name}")
            for b in buckets:
                if self._exists(f"{version}/{name}/bucket={b}"):
                    new[name][str(b)] = version
                else:  # nothing is left in it
                    new[name].pop(str(b), None)
        self._point({"tables": new, "previous": sorted(_versions(old["tables"]))})
        self._drop(_versions(new) | _versions(old["tables"]))
        return version

    def _drop(self, keep: set[str]) -> None:
        for s in self._files().listStatus(self._path("")):
            name = s.getPath().getName()
            if s.isDirectory() and name.startswith("v") and name not in keep:
                self._files().delete(s.getPath(), True)


def _versions(tables: dict[str, dict[str, str]]) -> set[str]:
    return {v for at in tables.values() for v in at.values()}
