"""The file library: listing, counts, queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower

CLASSES = ("all", "busy", "done", "failed")


def in_class(status: str) -> Column:
    if status not in CLASSES:
        raise ValueError(f"unknown status {status!r}")
    if status == "all":
        return F.lit(True)
    return ~F.col("status").isin("done", "failed") if status == "busy" else F.col("status") == status


def listed(docs: DataFrame, status: str = "all", q: str = "") -> DataFrame:
    """Documents of a status class whose name holds the whole of q, in either ASCII case."""
    rows = docs.filter(in_class(status))
    q = q.strip().lower()
    return rows.filter(F.instr(ascii_lower("filename"), q) > 0) if q else rows


def queue_positions(docs: DataFrame) -> DataFrame:
    """id, queue_pos of the queued documents, by id."""
    return docs.filter("status = 'queued'").select("id", F.row_number().over(Window.orderBy("id")).cast("bigint").alias("queue_pos"))


def page(docs: DataFrame, number: int = 1, size: int = 50, status: str = "all", q: str = "") -> DataFrame:
    """One page, newest first, with the place in the whole queue of those that wait."""
    shown = listed(docs, status, q).orderBy(F.desc("id")).offset((number - 1) * size).limit(size)
    return shown.join(queue_positions(docs), "id", "left").select("id", "filename", "size", "status", "queue_pos")


def class_counts(docs: DataFrame, q: str = "") -> DataFrame:
    """Documents of each class under the name filter, in one pass."""
    return listed(docs, "all", q).agg(*[F.count_if(in_class(c)).alias(f"n_{c}") for c in CLASSES])


def overall(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("n_all"), F.coalesce(F.count_if(in_class("busy")), F.lit(0)).alias("n_busy"))


def next_job(docs: DataFrame) -> DataFrame:
    return docs.filter("status = 'queued'").agg(F.min("id").alias("id"))


def pager(pages: DataFrame) -> DataFrame:
    """pages: total, size, page -> the page numbers shown: first, last, two around the current one; gap: whether numbers are left out before."""
    last = F.greatest(F.lit(1), F.ceil(F.col("total") / F.col("size")).cast("int"))
    near = F.array(F.lit(1), *[F.col("page") + i for i in range(-2, 3)], last)
    shown = F.array_sort(F.array_distinct(F.filter(near, lambda x: (x >= 1) & (x <= last))))
    rows = pages.select("total", "size", "page", F.posexplode(shown).alias("at", "number"), shown.alias("s"))
    before = F.when(F.col("at") == 0, 0).otherwise(F.expr("s[greatest(at - 1, 0)]"))
    return rows.select("total", "size", "page", "number", (F.col("number") - before > 1).alias("gap"), (F.col("number") == F.col("page")).alias("current"))


def recent_queries(log: DataFrame, most: int = 30) -> DataFrame:
    """log: at, q. The last distinct queries, newest first."""
    last = log.filter(F.trim("q") != "").groupBy(F.trim("q").alias("q")).agg(F.max("at").alias("at"))
    return last.withColumn("place", F.row_number().over(Window.orderBy(F.desc("at"), "q"))).filter(F.col("place") <= most)


def named(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """rows (with doc_id) and the filename of each one's document, empty where there is none."""
    names = docs.select(F.col("id").alias("doc_id"), "filename")
    return rows.join(names, "doc_id", "left").select(*rows.columns, F.coalesce("filename", F.lit("")).alias("filename"))
