"""The engine: ingest a corpus folder, search it, browse it, keep it in sync."""

from __future__ import annotations

import datetime
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions.encoding import decode_text
from textquarry.model import MAX_CHARS, MAX_TERMS, OVERLAP_CHARS, TOP_K
from textquarry.operators import browse, chunking, index, media, search, sync
from textquarry.sources import files, images
from textquarry.store import BUCKETS, Store, bucket_of

CHUNK_COLUMNS = ["chunk_id", "doc_id", "source_path", "source_type", "title", "section", "chunk_index", "text", "metadata"]


class Engine:
    """``root`` holds the corpus; the index and extracted images go to ``data`` below it."""

    def __init__(
        self, spark: SparkSession, root: str, corpus: str = "corpus", data: str = "data",
        max_chars: int = MAX_CHARS, overlap_chars: int = OVERLAP_CHARS, top_k: int = TOP_K,
    ):
        self.spark, self.root = spark, root.rstrip("/") if "://" in root else os.path.abspath(root)
        self.corpus, self.data = f"{self.root}/{corpus}", data
        self.images = f"{data}/images"
        self.max_chars, self.overlap_chars, self.top_k = max_chars, overlap_chars, top_k
        self.store = Store(spark, f"{self.root}/{data}/index")

    # --- ingest ---

    def ingest(self, full: bool = False) -> dict[str, int]:
        """Bring the index up to date with the corpus; counters of what was done.

        Files are compared by hash before any is parsed. A file that fails to parse keeps its old
        document and chunks. Only the buckets of changed documents are read, tokenised and written.
        """
        found = self._files()
        names = ("documents", "chunks", "terms", "media")
        old = {t: self.store.read(t) for t in names}
        if full:
            old = {t: df.limit(0) for t, df in old.items()}
        current = found.select(
            F.sha2("source_path", 256).alias("doc_id"), "source_path", F.sha2("content", 256).alias("sha256"), "size_bytes"
        )
        with_terms = old["chunks"].select("chunk_id", "doc_id").join(old["terms"].select("chunk_id").distinct(), "chunk_id", "left_semi")
        changes = sync.diff(old["documents"], current, with_terms.select("doc_id")).persist()
        fresh = changes.where("status in ('new', 'changed')").select("source_path")
        todo = found.join(fresh, "source_path", "left_semi")
        parsed = files.parse(todo, self.images, self._sidecars()).persist()
        failed = parsed.where("error is not null").select("source_path")
        good = parsed.where("error is null")
        changes = changes.join(failed, "source_path", "left_anti").unionByName(failed.withColumn("status", F.lit("failed")))
        now = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%d %H:%M:%S")

        bucket = bucket_of(F.sha2("source_path", 256)).alias("bucket")
        moved = changes.where("status in ('new', 'changed', 'deleted')").select(bucket).distinct()
        touched = list(range(BUCKETS)) if full else sorted(r["bucket"] for r in moved.collect())  # at most BUCKETS
        documents, chunks, new_chunks = self._touched(touched, full, changes, good, now)
        n_images, manifest, gone, dropped = self._media(old["media"], good, todo.join(failed, "source_path", "left_anti"), changes)
        place = chunks.select("chunk_id", "bucket")
        self.store.write(
            touched, documents=documents, chunks=chunks, media=manifest,
            postings=index.postings(chunks).join(place, "chunk_id"), lengths=index.lengths(chunks).join(place, "chunk_id"),
            terms=index.terms(chunks, MAX_TERMS).join(place, "chunk_id"),
        )
        counts = sync.counters(changes, new_chunks, gone, dropped).first().asDict()
        self._unlink(gone)
        for df in (changes, parsed, chunks, gone, manifest):
            df.unpersist()
        return counts | {"images": n_images}

    def _touched(self, touched: list[int], full: bool, changes: DataFrame, good: DataFrame, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The documents and chunks of the touched buckets as they will be, and the new chunks among them."""
        before = self.store.read("documents", touched), self.store.read("chunks", touched)
        if full:
            before = before[0].limit(0), before[1].limit(0)
        kept = before[0].join(changes.where("status in ('unchanged', 'failed')").select("source_path"), "source_path", "left_semi")
        written = sync.merged(before[0].limit(0), good, good.select("source_path").withColumn("status", F.lit("new")), now)
        born = before[0].select("source_path", F.col("created_at").alias("born"))
        written = written.join(born, "source_path", "left").withColumn("created_at", F.coalesce("born", "created_at")).drop("born")
        documents = kept.unionByName(written.select(*kept.columns)).withColumn("bucket", bucket_of(F.col("doc_id")))

        typed = good.select("doc_id", "source_type", F.col("metadata.language").alias("language"), "text")
        pieces = chunking.chunk_documents(typed, self.max_chars, self.overlap_chars)
        new = pieces.join(good.select("doc_id", "source_path", "source_type", "title", "metadata"), "doc_id").select(*CHUNK_COLUMNS)
        chunks = before[1].join(kept.select("doc_id"), "doc_id", "left_semi").select(*CHUNK_COLUMNS).unionByName(new)
        return documents, chunks.withColumn("bucket", bucket_of(F.col("doc_id"))).persist(), new

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _files(self) -> DataFrame:
        if not self._exists(self.corpus):
            empty = "source_path string, source_type string, content binary, size_bytes bigint, mtime double"
            return self.spark.createDataFrame([], empty)
        return files.scan(self.spark, self.corpus, self.root)

    def _in_images(self, suffixes: str = "*") -> DataFrame | None:
        """(local_path, content) of the files in the image folder; contents are read only where they are used."""
        folder = f"{self.root}/{self.images}"
        if not self._exists(folder):
            return None
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", suffixes).load(folder)
        return found.select(F.replace(F.regexp_replace("path", "^file:/+", "/"), F.lit(self.root + "/"), F.lit("")).alias("local_path"), "content")

    def _sidecars(self) -> DataFrame | None:
        """(source_path, texts): none before any image was extracted."""
        texts = self._in_images("*.{txt,md}")
        if texts is None:
            return None
        rows = texts.select(F.col("local_path").alias("local"), decode_text(F.col("content")).alias("text"))
        # the folder of an image is named by the first digits of its source's hash
        rows = rows.withColumn("place", F.element_at(F.split("local", "/"), -2))
        by_place = rows.groupBy("place").agg(F.map_from_entries(F.collect_list(F.struct("local", "text"))).alias("texts"))
        paths = self._files().select("source_path", F.substring(F.sha2("source_path", 256), 1, 12).alias("place"))
        return paths.join(by_place, "place").select("source_path", "texts")

    def _media(self, manifest: DataFrame, parsed: DataFrame, todo: DataFrame, changes: DataFrame) -> tuple[int, DataFrame, DataFrame, DataFrame]:
        """Write the images of parsed pages, then update and collect the manifest."""
        images.write(files.inline_images(todo, self.images), self.root)
        found = parsed.select("source_path", F.explode("metadata.images").alias("image")).where("image.local_path <> ''")
        found = found.select(F.col("image.local_path").alias("local_path"), "source_path", "image")
        merged = media.updated(manifest, parsed.select("source_path"), found)
        listing = self._in_images()
        listing = self.spark.createDataFrame([], "local_path string") if listing is None else listing.select("local_path")
        stays, gone = media.collect(merged, changes.where("status <> 'deleted'").select("source_path"), listing)
        # both are needed after files have been deleted, so they are settled before
        stays, gone = stays.persist(), gone.persist()
        return found.count(), stays, gone, media.dropped(merged, stays)

    def _unlink(self, gone: DataFrame) -> int:
        """Delete the files ``gone`` (local_path) where they lie, in tasks."""
        n = gone.count()
        if n:
            images.delete(gone.where(F.startswith("local_path", F.lit(f"{self.images}/"))), self.root)
        return n

    def collect_media(self) -> int:
        """Delete image files that no entry of the manifest names any more."""
        listing = self._in_images()
        if listing is None:
            return 0
        gone = media.collect(self.store.read("media"), self.store.read("documents"), listing.select("local_path"))[1].persist()
        n = self._unlink(gone)
        gone.unpersist()
        return n

    # --- read ---

    def search(self, query: str, top_k: int | None = None, source_type: str | None = None, mode: str = "any") -> DataFrame:
        """Results (*chunk columns, score, snippet), best first; stages run only while results lack."""
        chunks, k = self.store.read("chunks"), top_k or self.top_k
        hits = search.bm25_postings(self.store.read("postings"), self.store.read("lengths"), chunks, query, mode, source_type, k).cache()
        if k > 0 and search.has_han(query) and hits.count() < k:
            for stage in (search.term_search, search.substring_search):
                args = (self.store.read("terms"),) if stage is search.term_search else ()
                more = stage(chunks.join(hits.select("chunk_id"), "chunk_id", "left_anti"), *args, query, mode, source_type, k - hits.count())
                hits = hits.unionByName(more).cache()
                if hits.count() >= k:
                    break
        marked = search.with_snippets(hits, query)
        plain = search.plain_snippet(F.col("text"), query)
        return marked.withColumn("snippet", F.when((F.col("score") != 0) & (F.col("snippet") != ""), F.col("snippet")).otherwise(plain))

    def neighbours(self, hits: DataFrame, radius: int) -> DataFrame:
        return search.neighbours(self.store.read("chunks"), hits, radius)

    def list_documents(self) -> DataFrame:
        return browse.list_documents(self.store.read("documents"), self.store.read("chunks"))

    def outline(self, selector: str) -> DataFrame:
        return browse.outline(self.store.read("documents"), self.store.read("chunks"), selector)

    def show(self, selector: str, section: str | None = None, limit: int | None = None) -> DataFrame:
        return browse.document_chunks(self.store.read("documents"), self.store.read("chunks"), selector, section, limit)

    def media(self) -> DataFrame:
        return self.store.read("media").orderBy("local_path")

    def status(self) -> DataFrame:
        names = {"documents": "documents", "chunks": "chunks", "fts_rows": "lengths", "term_rows": "terms", "media": "media"}
        return browse.status(source_files=self._files(), **{n: self.store.read(t) for n, t in names.items()})
