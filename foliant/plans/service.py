"""The library's calls: one function for each thing that a client may ask. Bounds are checked here; the plans behind know none."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import occurrences_of_all, terms_of
from ..operators import highlight, jobs, library, retrieval, search
from ..sources import files
from ..sources.providers import Breaker, Embedder, Reranker

MODES = ("keyword", "hybrid", "semantic")
QUERY_MOST, HITS_MOST, PAGE_MOST, NAME_MOST, IDS_MOST = 500, 2000, 500, 200, 100_000
RERANK_QUERY, RERANK_TEXT = 4000, 12000


class Refused(ValueError):
    """A request outside the bounds, or one that the present state doesn't allow."""


class Missing(LookupError):
    """A document that the library doesn't have."""


class Unavailable(RuntimeError):
    """A mode that needs a service that doesn't answer."""


def need(ok: bool, what: str) -> None:
    if not ok:
        raise Refused(what)


@dataclass
class Library:
    """docs: id, filename, size, status; chunks: id, doc_id, seq, heading, text, page_start, regions; vectors: id, v; words: the index of headings and texts; lines, glyphs: as highlights() takes them."""

    docs: DataFrame
    chunks: DataFrame
    vectors: DataFrame | None = None
    embedder: Embedder | None = None
    reranker: Reranker | None = None
    semantic: bool = False
    breaker: Breaker | None = None
    words: retrieval.Index | None = None
    lines: DataFrame | None = None
    glyphs: DataFrame | None = None

    def search(self, q: str, mode: str = "keyword", doc_id: int | None = None) -> tuple[DataFrame, bool]:
        """Documents found, and whether the semantic part took part."""
        need(0 < len(q) <= QUERY_MOST, "query length")
        need(mode == "keyword" or mode in MODES and self.semantic, f"mode {mode!r}")
        if mode == "keyword" or not q.strip():
            return search.grouped(self.chunks, self.docs, q, doc_id), False
        return self.ranked(q, mode, doc_id)

    def ranked(self, q: str, mode: str, doc_id: int | None) -> tuple[DataFrame, bool]:
        """Hybrid search goes on without vectors when the embedder fails; semantic search can't."""
        units = self.chunks.filter(F.col("doc_id") == doc_id) if doc_id else self.chunks
        tokens = [r[0] for r in self.docs.sparkSession.range(1).select(F.explode(F.array_distinct(retrieval.tokens(F.lit(q.strip())))))
                  .collect()]  # the query's own words
        index = self.words or retrieval.index_of(self.chunks.select("id", retrieval_text().alias("text")), tokens)
        words = retrieval.bm25(index, tokens, only=units.select("id") if doc_id else None) if mode == "hybrid" and tokens else None
        try:
            [query] = self.embedder.embed([q])
            own = self.vectors.join(units.select("id"), "id", "left_semi") if doc_id else self.vectors
            near, ok = retrieval.cosine_neighbours(own, query), True
        except Exception as e:
            if words is None:
                raise Unavailable("no embeddings") from e
            near, ok = words.limit(0), False
        fused = retrieval.fused(words if words is not None else near.limit(0), near)
        rows = retrieval.with_bonus(fused, units, terms_of(q)) if mode == "hybrid" else fused.join(units.select("id"), "id", "left_semi")
        rows = self.rerank(q, rows, units)
        terms = terms_of(q)
        counted = units.select("id", "doc_id", F.lower("text").alias("_low")).join(F.broadcast(rows), "id").withColumn("n_hits", occurrences_of_all(F.col("_low"), terms))
        best = counted.groupBy("doc_id").agg(F.min("rank").alias("best"), F.count("*").alias("chunk_count"), F.sum("n_hits").alias("hit_count"))
        named = search.filename_hits(self.docs, q, doc_id).select("doc_id", F.lit(True).alias("filename_match"))
        found = best.join(named, "doc_id", "full_outer").join(self.docs.select(F.col("id").alias("doc_id"), "filename"), "doc_id", "left")
        found = found.select("doc_id", F.coalesce("filename", F.lit("")).alias("filename"), F.coalesce("filename_match", F.lit(False)).alias("filename_match"), F.coalesce("hit_count", F.lit(0)).alias("hit_count"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), "best")
        return retrieval.ranked(found, F.desc("filename_match"), F.col("best").asc_nulls_last(), "doc_id"), ok

    def rerank(self, q: str, rows: DataFrame, units: DataFrame) -> DataFrame:
        """The head of at most thirty rows is sorted by the reranker, if there is one and it answers."""
        if self.reranker is None:
            return rows
        head = rows.filter(F.col("rank") <= retrieval.RERANKED).join(units, "id").select("id", F.left(retrieval_text(), F.lit(RERANK_TEXT)).alias("t")).orderBy("id").collect()
        ask = lambda: self.reranker.scores(q[:RERANK_QUERY], [r["t"] for r in head])
        scores = self.breaker.call(ask) if self.breaker else ask()
        if scores is None:
            return rows
        spark = self.docs.sparkSession
        return retrieval.reranked(rows.select("id", "rank"), spark.createDataFrame([(r["id"], float(s)) for r, s in zip(head, scores)], "id long, score double"))

    def hits(self, doc_id: int, q: str, offset: int = 0, limit: int = 500) -> DataFrame:
        need(0 < len(q) <= QUERY_MOST and offset >= 0 and 1 <= limit <= HITS_MOST, "bounds")
        return search.hits_page(self.chunks, self.docs, q, doc_id, offset, limit)

    def highlights(self, doc_id: int, q: str) -> DataFrame:
        """Places of all hits of a document, in reading order: the passages that exact search finds, on their pages."""
        need(0 < len(q) <= QUERY_MOST, "query length")
        need(self.lines is not None, "no pages")
        found = search.keyword_matches(self.chunks, self.docs, q, doc_id).select("id")
        own = self.chunks.filter(F.col("doc_id") == doc_id).join(found, "id", "left_semi").select("doc_id", "id", "seq", "text", "regions")
        mine = [p if p is None else p.filter(F.col("doc_id") == doc_id) for p in (self.lines, self.glyphs)]
        return highlight.highlights(own, mine[0], terms_of(q), mine[1])

    def health(self) -> DataFrame:
        """One row: documents, passages, documents that are being worked on."""
        busy = self.docs.agg(F.count("*").alias("n_documents"), F.count_if(~F.col("status").isin(*jobs.FINISHED)).alias("n_pending"))
        return busy.crossJoin(self.chunks.agg(F.count("*").alias("n_chunks")))  # one row each

    def page(self, number: int = 1, size: int = 50, status: str = "all", q: str = "") -> DataFrame:
        need(number >= 1 and 1 <= size <= PAGE_MOST and len(q) <= NAME_MOST and status in library.CLASSES, "bounds")
        return library.page(self.docs, number, size, status, q)

    def document(self, doc_id: int) -> DataFrame:
        """The document's row."""
        row = self.docs.filter(F.col("id") == doc_id)
        if row.isEmpty():
            raise Missing(f"document {doc_id}")
        return row

    def delete(self, ids: list[int]) -> tuple[DataFrame, DataFrame]:
        """Documents and passages that remain."""
        need(len(ids) <= IDS_MOST, "ids")
        gone = self.docs.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], "doc_id long")
        return jobs.cascade_delete(self.docs.withColumnRenamed("id", "doc_id"), gone).withColumnRenamed("doc_id", "id"), jobs.cascade_delete(self.chunks, gone)

    def requeue(self, ids: list[int] | None = None) -> DataFrame:
        state = self.docs.select(F.col("id").alias("doc_id"), "status")
        return jobs.requeue(state, None if ids is None else self.docs.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], "doc_id long"))


def retrieval_text():
    """What is reranked: heading, line feed, text; the line feed also without a heading."""
    return F.concat(F.coalesce("heading", F.lit("")), F.lit("\n"), "text")


def embedding_text():
    """What is embedded: the heading and a line feed only if there is one."""
    return F.when(F.coalesce("heading", F.lit("")) != "", F.concat("heading", F.lit("\n"), "text")).otherwise(F.col("text"))


def import_folder(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """Registered files of a folder: filename, sha256, duplicate, error."""
    rows = files.scan_folder(spark, path).select(F.xxhash64("path").alias("ord"), "filename", F.sha2("content", 256).alias("sha256"))
    return files.register(rows, known)
