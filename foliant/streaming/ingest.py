"""Continuous ingestion: a stream of files, each micro-batch committed as events and passages.

A batch's id is part of every path it writes, so a batch that is run again replaces itself.
The last thing written is the log; readers take the passages of each document's last success.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import pages
from ..plans import parsing
from ..plans.service import embedding_text
from ..sources import recognition
from ..sources.files import ALLOWED, extension, register
from ..sources.providers import Embedder, embedded


def file_stream(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """path, filename, content of files as they arrive."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "content").filter(extension("filename").isin(*ALLOWED) & ~F.col("filename").startswith("~$"))


def absent(e: Exception) -> bool:
    return any(name in str(e) for name in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"))


def table(spark: SparkSession, path: str) -> DataFrame | None:
    """A table, or None before anything was written."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if not absent(e):
            raise
        return None


@dataclass(frozen=True)
class Processor:
    """Turns files into passages under `library`: pages, answers, lines, blocks, chunks and vectors of each batch.

    extract reads a file's pages (pages.extracted), recognise a batch of a document's scanned
    pages (recognition.recognised); without it scanned pages have no text. every: all pages go
    to recognition. A failure stays with its document.
    """

    library: str
    extract: Callable[[bytes], Iterable[tuple]]
    recognise: Callable[[int, list[int]], tuple[str, str]] | None = None
    embedder: Embedder | None = None
    every: bool = False

    def kept(self, df: DataFrame, name: str, batch: int) -> DataFrame:
        path = f"{self.library}/{name}/batch={batch}"
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def __call__(self, files: DataFrame, batch: int) -> DataFrame:
        """files: doc_id, content -> doc_id, n_pages, n_ocr, n_chunks, error."""
        extracted = self.kept(pages.extracted(files, self.extract), "pages", batch)
        asked = parsing.asked_batches(extracted, self.every)
        recognise = self.recognise or (lambda doc_id, numbers: ("[]", "{}"))
        answers = self.kept(recognition.recognised(asked, recognise), "answers", batch)
        result = parsing.parsed(extracted, answers, self.every)
        self.kept(result.lines, "lines", batch)
        chunks = self.kept(parsing.Parsed(self.kept(result.blocks, "blocks", batch), result.lines, result.counts).chunks(), "chunks", batch)
        found = parsing.outcomes(result.counts, chunks)
        if self.embedder is None:
            return found
        units = chunks.select(F.concat_ws(":", "doc_id", "seq").alias("id"), embedding_text().alias("text"))
        own = [F.substring_index("id", ":", at).cast(kind).alias(name) for name, kind, at in (("doc_id", "bigint", 1), ("seq", "int", -1))]
        vectors = self.kept(embedded(units, self.embedder, failing=True).select(*own, "v", "error"), "vectors", batch)
        wrong = vectors.filter("error IS NOT NULL").groupBy("doc_id").agg(F.min("error").alias("_wrong"))
        return found.join(wrong, "doc_id", "left").withColumn("error", F.coalesce("error", "_wrong")).drop("_wrong")


def ingest(stream: DataFrame, library: str, checkpoint: str, work: Callable[[DataFrame, int], DataFrame]) -> StreamingQuery:
    """Appends to library/events what becomes of each file; content that the log knows is not worked on again.

    work: (doc_id, content of new files), batch id -> doc_id, error and whatever else the log
    shall hold. doc_id is a 64-bit hash of the content.
    """

    def commit(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(F.xxhash64("path").alias("ord"), "filename", F.sha2("content", 256).alias("sha256"), "content")
        log = table(batch.sparkSession, f"{library}/events")
        judged = register(rows.select("ord", "filename", "sha256"), log.filter(F.col("batch") < batch_id).select("sha256").distinct() if log is not None else None)
        doc_id = F.xxhash64("sha256").alias("doc_id")
        new = rows.join(judged.filter("NOT duplicate AND error IS NULL").select("ord"), "ord", "left_semi").select(doc_id, "content")
        done = work(new, batch_id).withColumnsRenamed({"doc_id": "_doc", "error": "_error"})
        events = judged.select(doc_id, "sha256", "filename", "duplicate", "error").join(done, (F.col("doc_id") == F.col("_doc")) & ~F.col("duplicate"), "left").drop("_doc")
        message = F.coalesce("error", "_error")
        op = F.when(F.col("duplicate"), "duplicate").when(message.isNotNull(), "failed").otherwise("done")
        events.withColumns({"op": op, "message": message}).drop("duplicate", "error", "_error").write.mode("overwrite").parquet(f"{library}/events/batch={batch_id}")

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def published(events: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows (with doc_id and batch) of each document's last success; those of a failed or unfinished batch stay unseen, and older ones stay until a newer success."""
    last = events.filter("op = 'done'").groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["doc_id", "batch"], "left_semi")


def requeue(spark: SparkSession, library: str, files: DataFrame, batch: int, work: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """Works on files (doc_id, sha256, filename, content) again under a new batch id and logs what becomes of them: doc_id, op, message."""
    done = work(files.select("doc_id", "content"), batch).select("doc_id", "error")
    events = files.select("doc_id", "sha256", "filename").join(done, "doc_id", "left")
    events = events.select("*", F.when(F.col("error").isNotNull(), "failed").otherwise("done").alias("op"), F.col("error").alias("message")).drop("error")
    path = f"{library}/events/batch={batch}"
    events.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).select("doc_id", "op", "message")
