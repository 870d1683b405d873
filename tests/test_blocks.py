"""Blocks: the queries against their SQL on lines that look like numbered headings, and the operators on blocks made by hand."""

import duckdb
import pytest
from pyspark.sql import functions as F

from foliant import catalog
from foliant.operators import blocks, chunking
from tests.oracle import difference

RAW = "doc_id long, ord int, page int, x0 double, y0 double, x1 double, y1 double, text string, is_table boolean, size double, bold boolean, nlines int, page_height double"


@pytest.fixture(scope="module")
def addresses(spark, tmp_path_factory):
    """Tables with a document whose lines 11 (big) and 13 (bold and short) begin with network addresses."""
    lines = [f"line {i} of a paragraph" for i in range(24)]
    lines[11], lines[13] = "53.39.124.128 Osarez", "66.84.242.185 Ed"
    path = str(tmp_path_factory.mktemp("addresses"))
    spark.createDataFrame([(0, "\n".join(lines), "en", "s"), (1, "a\nb", "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    return path, con


@pytest.mark.parametrize("name", ["classify_blocks", "continuations"])
def test_addresses_are_no_headings_in_the_sql(spark, addresses, name):
    path, con = addresses
    assert difference(spark, con, name, catalog.QUERIES[name], catalog.SQL[name], path) == ""


def test_numbered_headings(spark):
    rows = [("text " * 20, 10.0, False), ("1.2.3 Deep", 10.0, True), ("1.2.3 plain", 10.0, False), ("第一章 总则", 10.0, False), ("Big", 14.0, False), ("2.1 Big", 14.0, False)]
    raws = spark.createDataFrame([(1, i, 0, 0.0, 0.0, 9.0, 9.0, t, False, s, b, 1, 842.0) for i, (t, s, b) in enumerate(rows)], RAW)
    got = lambda **how: [(r.kind, r.level) for r in blocks.classify(raws, **how).orderBy("ord").collect()]
    assert got() == [("text", 0), ("title", 3), ("text", 0), ("title", 1), ("title", 1), ("title", 2)]
    assert got(numbered=False) == [("text", 0)] * 4 + [("title", 1)] * 2


def test_margins_and_sizes_need_no_second_look_at_the_blocks(spark):
    texts = [("Head 1", 0.0), ("Head 2", 0.0), ("Head 3", 0.0), ("once", 0.0), ("- 7 -", 0.0), ("Head 4", 400.0), ("body " * 9, 400.0), (None, 0.0)]
    raws = spark.createDataFrame([(d, i, i, 0.0, y, 9.0, y + 9, t, False, 10.0, False, 1, 842.0) for d in (1, None) for i, (t, y) in enumerate(texts)], RAW)
    counts = raws.groupBy("doc_id").agg(F.countDistinct("page").alias("n_pages"))
    kept = blocks.drop_margins(raws, counts)
    assert kept.columns == raws.columns
    assert sorted((r.doc_id is None, r.ord) for r in kept.collect()) == [(False, i) for i in (3, 5, 6, 7)] + [(True, i) for i in (0, 1, 2, 3, 5, 6, 7)]  # no page count: nothing is frequent
    assert [r.kind for r in blocks.classify(raws).collect()] == ["text"] * 16  # also without doc_id
    assert "Join" not in blocks.classify(raws)._jdf.queryExecution().executedPlan().toString()


def test_passages_stream_over_batches(spark):
    rows = [(d, i, 0, 0.0, float(i), 1.0, i + 1.04, "title" if i == 0 else "text", f"{d}:{i}", int(i == 0), i == 5) for d in (3, 1, 2, None) for i in range(9)]
    made = spark.createDataFrame(rows, "doc_id long, ord int, page int, x0 double, y0 double, x1 double, y1 double, kind string, text string, level int, cont boolean").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        passages = chunking.build_chunks(made, target=12, most=20)
        got = {}
        for r in passages.orderBy("seq").collect():
            got.setdefault(r.doc_id, []).append((r.seq, r.heading, r.text, [x.y1 for x in r.regions]))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for d in (1, 2, 3):
        assert got[d] == [(0, f"{d}:0", f"{d}:1\n{d}:2\n{d}:3\n{d}:4", [2.0, 3.0, 4.0, 5.0]), (1, f"{d}:0", f"{d}:5\n{d}:6\n{d}:7\n{d}:8", [6.0, 7.0, 8.0, 9.0])]
    assert "".join(t for _, _, t, _ in got[None]).replace("\n", "") == "".join(f"None:{i}" for i in range(1, 9))
    assert "FlatMapGroups" not in passages._jdf.queryExecution().executedPlan().toString()  # a Python call for each document took most of the time
