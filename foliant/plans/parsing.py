"""From extracted pages and recognised ones to blocks, lines and passages of whole documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import progress
from ..operators import blocks, chunking, pages
from ..sources import recognition

NO_TEXT = "no text was found"


@dataclass(frozen=True)
class Parsed:
    """blocks: classified, in order, with cont; lines: recognised lines in the page's own size; counts: doc_id, n_pages, n_ocr, error."""

    blocks: DataFrame
    lines: DataFrame
    counts: DataFrame

    def chunks(self) -> DataFrame:
        return chunking.build_chunks(self.blocks)


def routes(extracted: DataFrame, every: bool = False) -> DataFrame:
    """doc_id, page, scanned: pages for the recognition service; all of them if `every`. Files that couldn't be read have none."""
    scanned = F.lit(True) if every else F.coalesce(blocks.needs_ocr(), F.lit(False))
    return extracted.filter("error IS NULL").select("doc_id", "page", scanned.alias("scanned"))


def asked_batches(extracted: DataFrame, every: bool = False) -> DataFrame:
    """doc_id, batch, pages: what the recognition service is asked."""
    return recognition.page_batches(routes(extracted, every).filter("scanned"))


def parsed(extracted: DataFrame, answers: DataFrame, every: bool = False) -> Parsed:
    """extracted: pages.extracted(); answers: recognition.recognised(asked_batches()); both should be stored, as they are read more than once.

    A document whose file or any batch failed has an error and no blocks. Margins are judged
    on the pages with a text layer, as many as those are; recognised blocks come classified.
    A page's blocks are text layer before recognition; continuation runs over both.
    """
    route = routes(extracted, every)
    failures = extracted.select("doc_id", "error").unionByName(answers.select("doc_id", "error")).filter("error IS NOT NULL")
    errors = failures.groupBy("doc_id").agg(F.min("error").alias("error"))
    numbers = route.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.count_if("scanned").alias("n_ocr"))
    counts = extracted.select("doc_id").distinct().join(numbers, "doc_id", "left").join(errors, "doc_id", "left").fillna(0, ["n_pages", "n_ocr"])
    own = route.filter("NOT scanned")
    raws = pages.raw_blocks(extracted.filter("error IS NULL").join(own.select("doc_id", "page"), ["doc_id", "page"], "left_semi").join(errors, "doc_id", "left_anti"))
    local = blocks.classify(blocks.drop_margins(raws, own.groupBy("doc_id").agg(F.count("*").alias("n_pages"))))
    sideways = F.pmod("rotation", F.lit(180)) != 0
    shown = [F.when(sideways, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("width", "height"), ("height", "width"))]
    sizes = extracted.select("doc_id", F.col("page").alias("_page"), *shown)
    good = answers.filter("error IS NULL").join(errors, "doc_id", "left_anti")
    items = recognition.content_items(good, blocks.ITEM).withColumn("_page", F.get("pages", F.coalesce("item.page_idx", F.lit(0)))).join(sizes, ["doc_id", "_page"]).drop("_page")
    remote = blocks.item_blocks(items)
    ordered = pages.merged_order(local, remote)
    spans = recognition.page_spans(good).join(sizes.withColumnRenamed("_page", "page"), ["doc_id", "page"])
    lines = blocks.rescaled_lines(spans.withColumns({"pw": F.coalesce("pw", "width"), "ph": F.coalesce("ph", "height")}))
    return Parsed(blocks.continuations(ordered), lines, counts)


def outcomes(counts: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, n_pages, n_ocr, n_chunks, error: a document without passages fails."""
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    rows = counts.join(n, "doc_id", "left").fillna(0, ["n_chunks"])
    return rows.withColumn("error", F.coalesce("error", F.when(F.col("n_chunks") == 0, NO_TEXT)))


def page_reports(route: DataFrame, each: int = 20) -> DataFrame:
    """route: doc_id, page, scanned -> doc_id, page, share: progress shown while the text layer is read, at every `each`-th of its pages; recognition has the rest."""
    counts = route.groupBy("doc_id").agg(F.count_if(~F.col("scanned")).alias("_n"), F.count_if("scanned").alias("_s"))
    nth = F.row_number().over(pages.Window.partitionBy("doc_id").orderBy("page")) - 1
    rows = route.filter("NOT scanned").withColumn("_k", nth).filter(F.col("_k") % each == 0).join(counts, "doc_id")
    return rows.select("doc_id", "page", (progress.recognition_share(F.col("_n"), F.col("_s")) * F.col("_k") / F.col("_n")).alias("share"))
