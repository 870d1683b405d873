"""From characters and images of a page to its raw blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import join_lines, rows_text
from .blocks import outside_tables


def block_fonts(spans: DataFrame) -> DataFrame:
    """spans: doc_id, block, ord, text, size, bold -> doc_id, block, size (of most stripped characters; of equals the first), bold (of more than half)."""
    n = F.length(F.trim("text"))
    per = spans.groupBy("doc_id", "block", "size").agg(F.sum(n).alias("n"), F.min("ord").alias("first"), F.sum(F.when(F.col("bold"), n).otherwise(0)).alias("heavy"))
    return per.groupBy("doc_id", "block").agg(F.min_by("size", F.struct(-F.col("n"), "first")).alias("size"), (2 * F.sum("heavy") > F.sum("n")).alias("bold"))


def image_ratios(images: DataFrame, pages: DataFrame) -> DataFrame:
    """images: doc_id, page, x0..y1; pages: doc_id, page, width, height -> doc_id, page, img_ratio: clipped image areas over the page's; overlaps count twice."""
    wide = F.greatest(F.lit(0.0), F.least("x1", "width") - F.greatest("x0", F.lit(0.0)))
    high = F.greatest(F.lit(0.0), F.least("y1", "height") - F.greatest("y0", F.lit(0.0)))
    seen = pages.join(images, ["doc_id", "page"], "left")
    return seen.groupBy("doc_id", "page").agg((F.coalesce(F.sum(wide * high), F.lit(0.0)) / F.first(F.when(F.col("width") * F.col("height") == 0, 1.0).otherwise(F.col("width") * F.col("height")))).alias("img_ratio"))


def accepted_table(rows: Column) -> Column:
    """At least two rows and columns, and some text."""
    return (F.size(rows) >= 2) & (F.array_max(F.transform(rows, lambda r: F.size(r))) >= 2) & F.exists(rows, lambda r: F.exists(r, lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))


def merged_order(local: DataFrame, recognised: DataFrame) -> DataFrame:
    """Blocks of both kinds of pages with one ord for each document: by page, text layer before recognition, own order."""
    both = local.withColumn("_from", F.lit(0)).unionByName(recognised.withColumn("_from", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("ord", (F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "_from", "ord")) - 1).cast("int")).drop("_from")


def with_tables(blocks: DataFrame) -> DataFrame:
    """blocks: doc_id, page, ord, is_table, y0, ...: tables go before the first text block that starts lower; text keeps its order. Each block sees its page's texts, one page's worth."""
    page, text = Window.partitionBy("doc_id", "page"), ~F.col("is_table")
    rows = blocks.withColumn("_nth", F.count_if(text).over(page.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_texts", F.array_sort(F.collect_list(F.when(text, F.struct("_nth", F.col("y0").alias("top")))).over(page)))
    lower = F.filter("_texts", lambda t: t["top"] > F.col("y0"))
    spot = F.when(text, F.col("_nth")).otherwise(F.coalesce(F.get(lower, F.lit(0))["_nth"], F.lit(2**62)))
    order = page.orderBy(spot, F.desc("is_table"), F.when(F.col("is_table"), F.col("y0")), "ord")
    kind = blocks.schema["ord"].dataType
    return rows.withColumn("ord", (F.row_number().over(order) - 1).cast(kind)).select(*blocks.columns)


def turned(blocks: DataFrame) -> DataFrame:
    """Boxes of a page turned clockwise by rotation (0, 90, 180, 270), in the turned page's coordinates; width, height: before."""
    turn = F.pmod("rotation", F.lit(360))
    x0, y0, x1, y1, w, h = (F.col(c) for c in ("x0", "y0", "x1", "y1", "width", "height"))
    pick = lambda a, b, c, d: F.when(turn == 90, b).when(turn == 180, c).when(turn == 270, d).otherwise(a)
    return blocks.select(*[c for c in blocks.columns if c not in ("x0", "y0", "x1", "y1")], pick(x0, h - y1, w - x1, y0).alias("x0"), pick(y0, x0, h - y1, w - x1).alias("y0"), pick(x1, h - y0, w - x0, y1).alias("x1"), pick(y1, x1, h - y0, w - x0).alias("y1"))


def by_cost(pages: DataFrame, tasks: int, local: int = 1, recognised: int = 30) -> DataFrame:
    """pages: doc_id, page, scanned -> dealt out so that tasks have like work; a scanned page costs as much as thirty others."""
    rows = pages.withColumn("_cost", F.when(F.col("scanned"), recognised).otherwise(local))
    slot = F.pmod(F.xxhash64("doc_id", "page"), F.lit(tasks))
    return rows.withColumn("_slot", slot).repartition(tasks, "_slot").drop("_slot", "_cost")


#: What a deployment's extractor gives for each page, after the page's number; a block has lines of text, or rows of cells if it is a table.
PAGE = "width double, height double, rotation int, n_chars int, n_bad int, img_ratio double, n_drawings int, blocks array<struct<x0: double, y0: double, x1: double, y1: double, lines: array<string>, rows: array<array<string>>, size: double, bold: boolean>>"
FIELDS, BLOCK = [f.split()[0] for f in PAGE.partition(", blocks")[0].split(", ")], ("x0", "y0", "x1", "y1", "lines", "rows", "size", "bold")


def extracted(files: DataFrame, extract: Callable[[bytes], Iterable[tuple]]) -> DataFrame:
    """files: doc_id, content -> one row a page: doc_id, page, PAGE, error. A file that can't be read is one row with its error, cut to 500 characters.

    extract(content) gives (*FIELDS, blocks) of each page, a block as a tuple in BLOCK's order.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for doc_id, content in zip(f["doc_id"], f["content"]):
                try:
                    rows = [(doc_id, i, *page[:-1], [dict(zip(BLOCK, b)) for b in page[-1]], None) for i, page in enumerate(extract(content))]
                except Exception as e:  # the other files go on
                    rows = [(doc_id, 0, *[None] * len(FIELDS), None, str(e)[:500])]
                yield pd.DataFrame(rows, columns=["doc_id", "page", *FIELDS, "blocks", "error"]).astype(object)

    return files.select("doc_id", "content").mapInPandas(run, f"doc_id long, page int, {PAGE}, error string")


def raw_blocks(pages: DataFrame) -> DataFrame:
    """Raw blocks of extracted pages as they are shown: turned, text inside tables dropped, tables in their place, ord counting through the document."""
    rows = pages.select("doc_id", "page", "rotation", "width", "height", F.posexplode("blocks").alias("ord", "b"))
    rows = rows.filter(F.col("b.rows").isNull() | accepted_table(F.col("b.rows")))
    is_table, lines = F.col("b.rows").isNotNull(), F.filter(F.coalesce("b.lines", F.expr("cast(array() as array<string>)")), lambda x: x != "")
    text = F.when(is_table, rows_text(F.col("b.rows"))).otherwise(join_lines(lines))
    sideways = F.pmod("rotation", F.lit(180)) != 0
    rows = turned(rows.select("doc_id", "page", "ord", "rotation", "width", "height", *[f"b.{c}" for c in ("x0", "y0", "x1", "y1", "size", "bold")], text.alias("text"), is_table.alias("is_table"), F.size(lines).alias("nlines"), F.when(sideways, F.col("width")).otherwise(F.col("height")).alias("page_height")))
    rows = rows.filter("text <> ''").drop("rotation", "width", "height")
    tables = rows.filter("is_table")
    placed = with_tables(outside_tables(rows.filter("NOT is_table"), tables).unionByName(tables))
    return placed.withColumn("ord", F.shiftleft(F.col("page").cast("bigint"), 32) + F.col("ord"))
