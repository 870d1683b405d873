"""From page blocks to classified blocks: scanned pages, margins, headings, continued paragraphs.

raw_blocks: doc_id, ord, page, x0, y0, x1, y1, text, is_table, size, bold, nlines, page_height.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

DEFAULT_SIZE = 10.5
SKIPPED_ITEMS = ("header", "footer", "page_number", "aside_text", "page_footnote", "discarded")


def needs_ocr() -> Column:
    """Over page_stats: n_chars (without white space), n_bad (replacement and private-use characters), img_ratio, n_drawings."""
    garbled = (F.col("n_chars") >= 30) & (F.col("n_bad") / F.col("n_chars") > 0.3)
    scanned = (F.col("img_ratio") > 0.5) & (F.col("n_chars") < 300)
    outlined = (F.col("n_chars") < 30) & ((F.col("img_ratio") > 0.1) | (F.col("n_drawings") > 200))
    return garbled | scanned | outlined


def in_margin() -> Column:
    return (F.col("y0") < F.col("page_height") * 0.08) | (F.col("y1") > F.col("page_height") * 0.92)


def drop_margins(raws: DataFrame, pages: DataFrame) -> DataFrame:
    """Without page numbers and texts that many pages repeat in their margins. pages: doc_id, n_pages."""
    rows = raws.join(pages.select("doc_id", F.col("n_pages").alias("_n_pages")), "doc_id", "left")
    rows = rows.withColumn("_key", F.when(in_margin() & ~F.col("is_table"), X.margin_key("text")))
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("doc_id", "_key", "page").orderBy("ord")))
    rows = rows.withColumn("_on", F.count_if(F.col("_nth") == 1).over(Window.partitionBy("doc_id", "_key")))
    often = F.col("_n_pages").isNotNull() & (F.col("_on") >= F.greatest(F.lit(3.0), F.col("_n_pages") * F.lit(0.3).cast("double")))
    drop = F.col("_key").isNotNull() & (often | F.col("text").rlike(X.PAGE_NUMBER))
    return rows.filter(~drop).select(*raws.columns)


def body_sizes(raws: DataFrame) -> DataFrame:
    """doc_id, body: the font size of most text; of equals, the one that comes first."""
    per = raws.filter("NOT is_table").groupBy("doc_id", "size").agg(F.sum(F.length("text")).alias("n"), F.min("ord").alias("first"))
    return per.groupBy("doc_id").agg(F.min_by("size", F.struct(-F.col("n"), "first")).alias("body"))


def classify(raws: DataFrame, numbered: bool = True) -> DataFrame:
    """blocks: kind (title, text, table) and level. A heading is short, and big, or bold and numbered, or a chapter line; by size alone if not numbered."""
    t, plain = F.col("text"), ~F.col("is_table")
    alike, own = Window.partitionBy("doc_id", "size"), Window.partitionBy("doc_id")
    rows = raws.withColumns({"_n": F.sum(F.when(plain, F.length(t))).over(alike), "_first": F.min(F.when(plain, F.col("ord"))).over(alike)})
    rows = rows.withColumn("body", F.min_by("size", F.when(plain, F.struct(-F.col("_n"), "_first"))).over(own))  # as body_sizes() has it
    short = (F.length(t) <= 40) & (F.col("nlines") <= 2) & ~X.ends_with_any(t, X.NOT_HEADING_ENDS) & ~t.rlike(X.CONTENTS_LINE)
    rows = rows.withColumn("_pattern", X.heading_level(t) if numbered else F.lit(0)).withColumn("_big", F.col("size") >= F.coalesce("body", F.lit(DEFAULT_SIZE)) * F.lit(1.15).cast("double"))
    chapter = t.rlike(X.STRONG) if numbered else F.lit(False)
    rows = rows.withColumn("_head", ~F.col("is_table") & short & (F.col("_big") | ((F.col("_pattern") > 0) & F.col("bold")) | chapter))
    big = F.when(F.col("_head") & F.col("_big"), F.col("size"))
    rows = rows.withColumn("_rank", F.when(big.isNotNull(), F.dense_rank().over(own.orderBy(big.desc_nulls_last()))))
    level = F.least(F.lit(4), F.when(F.col("_pattern") > 0, F.col("_pattern")).otherwise(F.coalesce("_rank", F.lit(2))))
    kind = F.when(F.col("is_table"), "table").when(F.col("_head"), "title").otherwise("text")
    return rows.select("doc_id", "ord", "page", "x0", "y0", "x1", "y1", kind.alias("kind"), "text", F.when(F.col("_head"), level).otherwise(0).alias("level"))


def continuations(blocks: DataFrame) -> DataFrame:
    """Adds cont: whether a text block goes on with the paragraph of the text block just before it."""
    order = Window.partitionBy("doc_id").orderBy("ord")
    page = Window.partitionBy("doc_id", "page")
    before = {c: F.lag(c).over(order) for c in ("kind", "text", "page", "x1", "y0", "y1")}
    rows = blocks.withColumn("_right", F.greatest(F.lit(0.0), F.max(F.when(F.col("kind") == "text", F.col("x1"))).over(page)))
    rows = rows.select("*", *[v.alias(f"_p_{c}") for c, v in before.items()])
    line = F.least(F.col("_p_y1") - F.col("_p_y0"), F.col("y1") - F.col("y0"))
    gap = F.col("y0") - F.col("_p_y1")
    same = (F.col("_p_x1") >= F.col("_right") * F.lit(0.9).cast("double")) & (gap >= 0) & (gap < line * F.lit(1.2).cast("double"))
    goes_on = F.when(F.col("_p_page") == F.col("page"), same).otherwise(F.col("page") == F.col("_p_page") + 1)
    cont = (F.col("kind") == "text") & (F.col("_p_kind") == "text") & ~X.ends_with_any(F.col("_p_text"), X.PARAGRAPH_ENDS) & goes_on
    return rows.select(*blocks.columns, F.coalesce(cont, F.lit(False)).alias("cont"))


ITEM = "struct<type: string, page_idx: int, bbox: array<double>, text: string, text_level: int, table_caption: array<string>, table_rows: array<array<string>>, table_footnote: array<string>, image_caption: array<string>, image_footnote: array<string>, list_items: array<string>>"


def item_blocks(items: DataFrame) -> DataFrame:
    """items: doc_id, ord, item (a struct of ITEM), width, height, pages (the batch's page numbers). Recognised items as blocks; furniture and items beyond the batch vanish."""
    i = lambda name: F.col(f"item.{name}")
    empty = F.expr("cast(array() as array<string>)")
    kind = F.coalesce(i("type"), F.lit("text"))
    index = F.coalesce(i("page_idx"), F.lit(0))
    solid = lambda parts: F.filter(parts, lambda p: F.trim(F.coalesce(p, F.lit(""))) != "")
    rows = items.filter(~kind.isin(*SKIPPED_ITEMS) & (index < F.size("pages")))
    table = F.array_join(solid(F.concat(F.coalesce(i("table_caption"), empty), F.array(X.rows_text(F.coalesce(i("table_rows"), F.expr("cast(array() as array<array<string>>)")))), F.coalesce(i("table_footnote"), empty))), "\n")
    image = F.array_join(F.concat(F.coalesce(i("image_caption"), empty), F.coalesce(i("image_footnote"), empty)), " ")
    said = F.coalesce(i("text"), F.lit(""))
    listed = F.array_join(F.coalesce(i("list_items"), empty), "\n")
    text = F.when(kind == "table", table).when(kind == "image", F.trim(image)).when((kind == "list") & (listed != ""), F.trim(listed)).otherwise(F.trim(said))
    title = (F.coalesce(i("text_level"), F.lit(0)) > 0) & (kind != "table")
    box = F.coalesce(i("bbox"), F.array(*map(F.lit, (0.0, 0.0, 1000.0, 1000.0))))
    rows = rows.select("doc_id", "ord", F.get("pages", index).alias("page"), *[(F.get(box, F.lit(k)) * F.col(side) / 1000).alias(c) for k, (c, side) in enumerate((("x0", "width"), ("y0", "height"), ("x1", "width"), ("y1", "height")))], F.when(kind == "table", "table").when(title, "title").otherwise("text").alias("kind"), text.alias("text"), i("text_level").alias("_level"))
    pattern = X.heading_level(F.col("text"))
    level = F.when(F.col("kind") == "title", F.when(pattern > 0, pattern).otherwise(F.least(F.lit(4), "_level"))).otherwise(0)
    return rows.filter("text <> ''").withColumn("level", level).drop("_level")


def rescaled_lines(spans: DataFrame) -> DataFrame:
    """spans: text, x0..y1 in the service's page size (pw, ph) -> the page's own (width, height), to a tenth; blank texts vanish."""
    at = lambda c, own, theirs: F.bround(F.col(c) * F.col(own) / F.col(theirs), 1).alias(c)
    return spans.filter(F.trim("text") != "").select("doc_id", "page", "ord", "text", at("x0", "width", "pw"), at("y0", "height", "ph"), at("x1", "width", "pw"), at("y1", "height", "ph"))


def outside_tables(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Text blocks whose centre lies in no table of their page."""
    t = tables.select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"), F.col("x0").alias("_a"), F.col("y0").alias("_b"), F.col("x1").alias("_c"), F.col("y1").alias("_e"))
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_p")) & (x >= F.col("_a")) & (x < F.col("_c")) & (y >= F.col("_b")) & (y < F.col("_e"))
    return blocks.join(t, inside, "left_anti")
