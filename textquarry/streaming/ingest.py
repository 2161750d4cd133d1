"""Structured Streaming form of ingestion: new files are parsed and chunked as they arrive.

A file stream reports arrivals, not deletions; pruning stays with the batch run. Each micro-batch
appends to the tables with an id of its own, so a batch that is retried replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textquarry.operators import chunking, index
from textquarry.sources import files

BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def arrivals(spark: SparkSession, corpus: str, files_per_batch: int = 1000) -> DataFrame:
    return (
        spark.readStream.format("binaryFile")
        .schema(BINARY)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(corpus)
    )


def start(spark: SparkSession, corpus: str, root: str, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write documents, chunks and their index tables below ``out``, one folder for each batch.

    Files that can't be parsed are listed in ``failed`` with the error.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        every = files.parse(files.relative(df, root)).persist()
        parsed = every.where("error is null")
        typed = parsed.select("doc_id", "source_type", F.col("metadata.language").alias("language"), "text")
        cols = ["doc_id", "source_path", "source_type", "title"]
        chunks = chunking.chunk_documents(typed).join(parsed.select(*cols), "doc_id").persist()
        parsed.drop("text", "error").write.mode("overwrite").parquet(f"{out}/documents/batch={epoch}")
        chunks.write.mode("overwrite").parquet(f"{out}/chunks/batch={epoch}")
        for name, rows in (("postings", index.postings(chunks)), ("lengths", index.lengths(chunks)), ("terms", index.terms(chunks))):
            rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={epoch}")
        every.where("error is not null").select("source_path", "error").write.mode("overwrite").parquet(f"{out}/failed/batch={epoch}")
        chunks.unpersist()
        every.unpersist()

    stream = arrivals(spark, corpus).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (stream.trigger(**trigger) if trigger else stream).start()

