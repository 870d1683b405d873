"""Exact search: literal terms, complete counts, grouped by document.

One plan answers a query: the term predicate is a filter on the chunk scan, file names are
matched on the small side, and text is only joined to the rows that are shown. Joins are left
to the planner, which broadcasts the documents' side when its size allows and else shuffles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, contains_any, occurrences_of_all, terms_of

PREVIEWS = 3


def lowered(chunks: DataFrame) -> Column:
    """The form of a passage that terms are looked for in: stored beside the text, or made of it."""
    return F.col("low") if "low" in chunks.columns else ascii_lower("text")


def searchable(docs: DataFrame, doc_id: int | None = None) -> DataFrame:
    """Documents that exact search sees; 0 and None ask for all."""
    done = docs.filter("status = 'done'")
    return done.filter(F.col("id") == doc_id) if doc_id else done


def filename_hits(docs: DataFrame, query: str, doc_id: int | None = None) -> DataFrame:
    """doc_id, filename of the documents whose name has all terms; none for a blank query."""
    terms = terms_of(query)
    named = reduce(lambda a, t: a & (F.instr(ascii_lower("filename"), t) > 0), terms, F.lit(bool(terms)))
    return searchable(docs, doc_id).filter(named).select(F.col("id").alias("doc_id"), "filename")


def keyword_matches(chunks: DataFrame, docs: DataFrame, query: str, doc_id: int | None = None) -> DataFrame:
    """id, doc_id, seq, page_start, n_hits of the matching chunks: each term in the text or in the file's name, and one in the text."""
    terms = terms_of(query)
    low = lowered(chunks)
    rows = chunks.filter(contains_any(low, terms) if terms else F.lit(False))
    if doc_id:
        rows = rows.filter(F.col("doc_id") == doc_id)
    rows = rows.select("id", "doc_id", "seq", "page_start", occurrences_of_all(low, terms).alias("n_hits"), *[(F.instr(low, t) > 0).alias(f"_t{i}") for i, t in enumerate(terms)])
    names = searchable(docs, doc_id).select(F.col("id").alias("doc_id"), *[(F.instr(ascii_lower("filename"), t) > 0).alias(f"_n{i}") for i, t in enumerate(terms)])
    both = rows.join(names, "doc_id")
    if len(terms) > 1:
        both = both.filter(reduce(lambda a, b: a & b, [F.col(f"_t{i}") | F.col(f"_n{i}") for i in range(len(terms))]))
    return both.select("id", "doc_id", "seq", "page_start", "n_hits")


def reading_order() -> list[Column]:
    return [F.col("page_start"), F.col("seq"), F.col("id")]


def grouped(chunks: DataFrame, docs: DataFrame, query: str, doc_id: int | None = None, top: int | None = None) -> DataFrame:
    """doc_id, filename, filename_match, hit_count, chunk_count, rank: documents with a hit in text or name; the `top` first ones, or all."""
    hits = keyword_matches(chunks, docs, query, doc_id).groupBy("doc_id").agg(F.sum("n_hits").alias("hit_count"), F.count("*").alias("chunk_count"))
    named = filename_hits(docs, query, doc_id).select("doc_id", F.lit(True).alias("named"))
    found = hits.join(named, "doc_id", "full_outer").join(docs.select(F.col("id").alias("doc_id"), "filename"), "doc_id", "left")
    rows = found.select("doc_id", F.coalesce("filename", F.lit("")).alias("filename"), F.coalesce("named", F.lit(False)).alias("filename_match"), F.coalesce("hit_count", F.lit(0)).alias("hit_count"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))
    order = [F.desc("filename_match"), F.desc("hit_count"), F.col("filename"), F.col("doc_id")]
    if top is not None:
        rows = rows.orderBy(*order).limit(top)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def totals(chunks: DataFrame, docs: DataFrame, query: str) -> DataFrame:
    """One row: documents, hits and chunks found."""
    hits = keyword_matches(chunks, docs, query).groupBy("doc_id").agg(F.sum("n_hits").alias("h"), F.count("*").alias("c"))
    named = filename_hits(docs, query).select("doc_id", F.lit(0).cast("bigint").alias("h"), F.lit(0).cast("bigint").alias("c"))
    per = hits.unionByName(named).groupBy("doc_id").agg(F.sum("h").alias("h"), F.sum("c").alias("c"))
    return per.agg(F.count("*").alias("total_docs"), F.coalesce(F.sum("h"), F.lit(0)).alias("total_hits"), F.coalesce(F.sum("c"), F.lit(0)).alias("total_chunks"))


def previews(chunks: DataFrame, docs: DataFrame, query: str, most: int = PREVIEWS) -> DataFrame:
    """The first matching chunks of each document, with their text."""
    first = Window.partitionBy("doc_id").orderBy(*reading_order())
    shown = keyword_matches(chunks, docs, query).withColumn("place", F.row_number().over(first)).filter(F.col("place") <= most)
    return shown.select("id", "place", "n_hits").join(chunks, "id").select("doc_id", "id", "place", "n_hits", "heading", "text")


def hits_page(chunks: DataFrame, docs: DataFrame, query: str, doc_id: int, offset: int = 0, limit: int = 500) -> DataFrame:
    """One page of a document's matching chunks in reading order; total counts all of them."""
    everything = Window.partitionBy("doc_id")
    hits = keyword_matches(chunks, docs, query, doc_id).withColumn("place", F.row_number().over(everything.orderBy(*reading_order()))).withColumn("total", F.count("*").over(everything))
    page = hits.filter((F.col("place") > offset) & (F.col("place") <= offset + limit))
    return page.select("id", "place", "total", "n_hits").join(chunks.filter(F.col("doc_id") == doc_id), "id").select("id", "place", "total", "n_hits", "text")


def many_queries(chunks: DataFrame, docs: DataFrame, queries: list[str]) -> DataFrame:
    """query, documents and hits of each of several queries, in one pass over the chunks."""
    asked = [(q, terms_of(q)) for q in dict.fromkeys(queries)]
    every = list(dict.fromkeys(t for _, ts in asked for t in ts))
    low, name = lowered(chunks), ascii_lower("filename")
    rows = chunks.filter(contains_any(low, every) if every else F.lit(False)).select("doc_id", low.alias("low"))
    names = searchable(docs).select(F.col("id").alias("doc_id"), name.alias("name"))
    both = rows.join(names, "doc_id")

    def found(terms: list[str]) -> Column:
        if not terms:
            return F.lit(False)
        everywhere = reduce(lambda a, b: a & b, [(F.instr("low", t) > 0) | (F.instr("name", t) > 0) if len(terms) > 1 else F.instr("low", t) > 0 for t in terms])
        return everywhere & contains_any(F.col("low"), terms)

    answers = F.array(*[F.struct(F.lit(q).alias("query"), F.when(found(ts), occurrences_of_all(F.col("low"), ts)).alias("n")) for q, ts in asked])
    per = both.select("doc_id", F.inline(F.filter(answers, lambda a: a["n"].isNotNull()))).groupBy("query", "doc_id").agg(F.sum("n").alias("n"), F.count("*").alias("c"))
    return per.groupBy("query").agg(F.count("*").alias("docs"), F.sum("n").alias("hits"), F.sum("c").alias("chunks"))
