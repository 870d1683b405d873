"""What a recognition service sends back: nested JSON, tables as HTML, batches of pages."""

from __future__ import annotations

import html
import json
import re
from bisect import bisect
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BATCH_PAGES = 10


ROW = re.compile(r"<tr\b[^>]*>", re.I)
#: From the last start of a cell before an end; what has no end is no cell.
CELL = re.compile(r"<t[dh]\b[^>]*>((?:(?!<t[dh]\b).)*?)</t[dh]\s*>", re.I | re.S)
COMMENT, TAG = re.compile(r"<!--.*?-->", re.S), re.compile(r"</?[a-z][^>]*>", re.I)


def table_rows(markup: str | None) -> list[list[str]]:
    """Rows of cell texts of a table; a cell is in the row that began last before its end, cells before all rows in one of their own."""
    markup = COMMENT.sub("", markup or "")
    starts = [m.end() for m in ROW.finditer(markup)]
    rows: list[list[str]] = [[] for _ in range(len(starts) + 1)]
    for cell in CELL.finditer(markup):
        rows[bisect(starts, cell.end())].append(html.unescape(TAG.sub("", cell[1])))
    return rows if rows[0] else rows[1:]


def spans(value) -> Iterator[dict]:
    """Text spans of blocks, however deep they nest, in order; no recursion."""
    stack = list(reversed(value or []))
    while stack:
        block = stack.pop()
        for line in block.get("lines") or []:
            yield from line.get("spans") or []
        stack += reversed(block.get("blocks") or [])


def lenient(said: str | None) -> dict:
    """A JSON object; what is none counts as empty: without lines only the places of hits are less exact."""
    try:
        value = json.loads(said or "{}")
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}


def page_spans(answers: DataFrame) -> DataFrame:
    """answers: doc_id, pages (of the batch), middle (JSON) -> doc_id, page, ord, text, x0, y0, x1, y1, pw, ph; pages beyond the batch vanish."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for doc_id, pages, middle in zip(f["doc_id"], f["pages"], f["middle"]):
                for info in lenient(middle).get("pdf_info") or []:
                    at = info.get("page_idx", 0)
                    if 0 <= at < len(pages):
                        pw, ph = info.get("page_size") or (None, None)
                        whole = [s for s in spans(info.get("para_blocks")) if s.get("type", "text") == "text" and isinstance(s.get("content"), str) and len(s.get("bbox") or ()) == 4]
                        rows += [(doc_id, int(pages[at]), i, s["content"], *map(float, s["bbox"]), pw, ph) for i, s in enumerate(whole)]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "ord", "text", "x0", "y0", "x1", "y1", "pw", "ph"])

    return answers.select("doc_id", "pages", "middle").mapInPandas(run, "doc_id long, page int, ord int, text string, x0 double, y0 double, x1 double, y1 double, pw double, ph double")


def page_batches(pages: DataFrame, size: int = BATCH_PAGES) -> DataFrame:
    """pages: doc_id, page -> doc_id, batch, pages (in order, at most `size`)."""
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("page")) - 1
    return pages.withColumn("batch", F.floor(nth / size).cast("int")).groupBy("doc_id", "batch").agg(F.array_sort(F.collect_list("page")).alias("pages"))


def recognised(batches: DataFrame, recognise: Callable[[int, list[int]], tuple[str, str]]) -> DataFrame:
    """batches: doc_id, batch, pages -> doc_id, pages, content, middle, error, by a deployment's service. recognise gives the list of items and the lines, both as JSON."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for doc_id, pages in zip(f["doc_id"], f["pages"]):
                try:
                    content, middle = recognise(int(doc_id), [int(p) for p in pages])
                    json.loads(content)
                    rows.append((doc_id, list(pages), content, middle, None))
                except Exception as e:
                    rows.append((doc_id, list(pages), None, None, str(e)[:300]))
            yield pd.DataFrame(rows, columns=["doc_id", "pages", "content", "middle", "error"])

    return batches.select("doc_id", "pages").mapInPandas(run, "doc_id long, pages array<int>, content string, middle string, error string")


WORDS, NUMBERS, LISTS = ("type", "text"), ("page_idx", "text_level"), ("table_caption", "table_footnote", "image_caption", "image_footnote", "list_items")


def item_of(said: dict) -> dict:
    """One item with the fields that blocks are made of; fields of another kind are null."""
    item = {k: said[k] if isinstance(said.get(k), str) else None for k in WORDS}
    item |= {k: said[k] if isinstance(said.get(k), int) else None for k in NUMBERS}
    item |= {k: [x for x in said[k] if isinstance(x, str)] if isinstance(said.get(k), list) else None for k in LISTS}
    box = said.get("bbox")
    return item | {"bbox": list(map(float, box)) if isinstance(box, list) and len(box) == 4 else None, "table_rows": table_rows(said.get("table_body"))}


def content_items(answers: DataFrame, kind: str) -> DataFrame:
    """answers: doc_id, pages, content -> doc_id, ord (in the order of pages), pages, item (of the type `kind`)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(doc_id, (int(pages[0]) << 32) + i, list(pages), item_of(said)) for doc_id, pages, content in zip(f["doc_id"], f["pages"], f["content"]) if content for i, said in enumerate(json.loads(content))]
            yield pd.DataFrame(rows, columns=["doc_id", "ord", "pages", "item"])

    return answers.select("doc_id", "pages", "content").mapInPandas(run, f"doc_id long, ord long, pages array<int>, item {kind}")
