"""The library's entities as views over the test tables, and the same views in SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ascii_lower
from ..operators import retrieval

#: (application, folder of the tables, name) -> where a derived table was written.
WRITTEN: dict[tuple[str, str, str], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def library_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, filename, ext, sha256, size, status, text."""
    d = table(spark, sf_dir, "documents")
    turn = F.col("doc_id") % 20
    return d.select(
        (F.col("doc_id") + 1).alias("id"),
        F.concat("source", F.lit("_"), "lang", F.lit("_"), "doc_id", F.lit(".pdf")).alias("filename"),
        F.lit(".pdf").alias("ext"),
        F.sha2("text", 256).alias("sha256"),
        F.octet_length("text").cast("bigint").alias("size"),
        F.when(turn == 0, "failed").when(turn == 1, "queued").when(turn == 2, "parsing").otherwise("done").alias("status"),
        "text",
    )


DOCS = """docs AS (SELECT doc_id + 1 AS id, source || '_' || lang || '_' || doc_id || '.pdf' AS filename, '.pdf' AS ext, sha256(text) AS sha256,
  octet_length(encode(text))::BIGINT AS size, CASE doc_id % 20 WHEN 0 THEN 'failed' WHEN 1 THEN 'queued' WHEN 2 THEN 'parsing' ELSE 'done' END AS status, text FROM documents)"""


def line_chunks(docs: DataFrame) -> DataFrame:
    """id, doc_id, seq, kind, heading, text, page_start, y: the non-blank lines of each document, eight to a page."""
    rows = docs.select(F.col("id").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("seq", "text")).filter(F.trim("text") != "")
    return rows.select(
        (F.col("doc_id") * 1000000 + F.col("seq")).alias("id"),
        "doc_id",
        "seq",
        F.when(F.instr("text", "|") > 0, "table").otherwise("text").alias("kind"),
        F.when(F.col("seq") % 7 == 3, "").otherwise(F.concat(F.lit("Part "), F.floor(F.col("seq") / 5))).alias("heading"),
        "text",
        F.floor(F.col("seq") / 8).cast("int").alias("page_start"),
        (F.col("seq") % 8 * 90 + 30).cast("double").alias("y"),
    )


CHUNKS = """lines AS (SELECT id AS doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(0, len(string_split(text, chr(10)))))::INTEGER AS seq FROM docs),
chunks AS (SELECT doc_id * 1000000 + seq AS id, doc_id, seq, CASE WHEN contains(text, '|') THEN 'table' ELSE 'text' END AS kind,
  CASE WHEN seq % 7 = 3 THEN '' ELSE 'Part ' || (seq // 5) END AS heading, text, (seq // 8)::INTEGER AS page_start, (seq % 8 * 90 + 30)::DOUBLE AS y FROM lines WHERE trim(text, ' ') <> '')"""
LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and all run on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master or ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="foliant-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stored(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that importing writes once, before any query: derived from the test tables at first use in a session, then read. The test tables don't change."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in WRITTEN:
        path = f"{shared_dir(spark)}/foliant-{name}-{uuid.uuid4().hex}"
        make().write.parquet(path)
        WRITTEN[key] = path
    return spark.read.parquet(WRITTEN[key])


def parts(df: DataFrame) -> int:
    """Files of a derived table: one for each split of its source, and enough for all cores."""
    return max(df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions())


def views(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents, and their passages as stored: in ranges of doc_id, with the form that exact search looks in."""
    docs = library_documents(spark, sf_dir)

    def make() -> DataFrame:
        ordered = docs.select("id", "text").repartitionByRange(parts(docs), "id").sortWithinPartitions("id")  # whole texts are dealt out; their lines are in order then
        return line_chunks(ordered).withColumn("low", ascii_lower("text"))

    return docs, stored(spark, sf_dir, "chunks", make)


def index(spark: SparkSession, sf_dir: str, name: str, units: DataFrame) -> retrieval.Index:
    """The inverted index of units (id, text), as stored: in ranges of terms, so that a query reads only its terms' row groups."""
    postings = stored(spark, sf_dir, f"{name}-postings", lambda: retrieval.sized_postings(units).repartitionByRange(parts(units), "term").sortWithinPartitions("term", "id"))
    return retrieval.Index(postings, stored(spark, sf_dir, f"{name}-sizes", lambda: retrieval.sizes(units)))
