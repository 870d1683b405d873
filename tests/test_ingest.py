"""From files to passages, places on the page, summaries: the parts joined up."""

import json

import pytest
from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.operators import highlight, jobs, retrieval, summary
from foliant.plans import parsing, service
from foliant.sources import recognition
from foliant.sources.providers import HashEmbedder
from foliant.streaming import ingest

GEOMETRY = (600.0, 800.0, 0)


def lines_of(*texts, size=10.0):
    return [(50.0, 100.0 + 20 * i, 500.0, 112.0 + 20 * i, [t], None, size, False) for i, t in enumerate(texts)]


def text_page(*blocks):
    return *GEOMETRY, 400, 0, 0.0, 0, list(blocks)


def scanned_page():
    return *GEOMETRY, 0, 0, 0.9, 0, []


def extract(content):
    said = content.decode()
    if said == "broken":
        raise ValueError("not a file " + "x" * 600)
    if said == "empty":
        return [text_page()]
    head = (50.0, 10.0, 200.0, 20.0, ["Secret plan 7"], None, 10.0, False)  # repeated in the margin of each page
    first = text_page(head, (50.0, 90.0, 300.0, 98.0, ["1.1 Scope"], None, 16.0, True), *lines_of("The first part goes", "on here!", said), (50.0, 300.0, 500.0, 400.0, None, [["a", "b"], ["1", None]], 10.0, False), (60.0, 310.0, 100.0, 320.0, ["inside the table"], None, 10.0, False))
    return [first, text_page(head, *lines_of("second page.")), scanned_page(), text_page(head, *lines_of("last page."))]


def recognise(doc_id, pages):
    items = [{"type": "title", "text": "Read", "text_level": 1, "page_idx": 0, "bbox": [0, 0, 1000, 50]}, {"type": "text", "text": "by machine.", "page_idx": 0, "bbox": [100, 100, 900, 200]}, {"type": "header", "text": "furniture", "page_idx": 0}, {"type": "table", "table_body": "<table><tr><td>x<td>y</td></tr></table>", "table_caption": ["T 1"], "page_idx": 0, "bbox": None}]
    middle = {"pdf_info": [{"page_idx": 0, "page_size": [1200, 1600], "para_blocks": [{"lines": [{"spans": [{"type": "text", "content": "by machine.", "bbox": [120, 160, 1080, 320]}]}]}]}]}
    return json.dumps(items), json.dumps(middle)


def files(spark, **contents):
    return spark.createDataFrame([(i, n.encode()) for i, n in enumerate(contents.values())], "doc_id long, content binary")


def test_files_become_passages(spark, tmp_path):
    work = ingest.Processor(str(tmp_path), extract, recognise, HashEmbedder(8))
    got = {r.doc_id: r for r in work(files(spark, a="alpha.", b="broken", c="empty"), 3).collect()}
    assert (got[0].n_pages, got[0].n_ocr, got[0].error) == (4, 1, None) and got[0].n_chunks > 0
    assert len(got[1].error) == 500 and got[1].error.startswith("not a file") and got[1].n_chunks == 0
    assert got[2].error == parsing.NO_TEXT
    chunks = spark.read.parquet(f"{tmp_path}/chunks").filter("doc_id = 0").orderBy("seq").collect()
    assert [(c.kind, c.heading, c.text, c.page_start) for c in chunks] == [
        ("text", "1.1 Scope", "The first part goes on here!\nalpha.", 0),
        ("table", "1.1 Scope", "a | b\n1 | ", 0),
        ("text", "1.1 Scope", "second page.", 1),
        ("text", "Read", "by machine.", 2),
        ("table", "Read", "T 1\ny", 2),
        ("text", "Read", "last page.", 3),
    ]
    [line] = spark.read.parquet(f"{tmp_path}/lines").collect()
    assert (line.page, line.text, line.x0, line.y1) == (2, "by machine.", 60.0, 160.0)
    assert spark.read.parquet(f"{tmp_path}/vectors").filter("v IS NULL").count() == 0


def test_services_fail_for_their_documents_only(spark, tmp_path):
    def moody(doc_id, pages):
        if doc_id == 0:
            raise RuntimeError("no answer")
        return "[]", "not JSON"

    class Short:
        def embed(self, texts):
            if any("gamma" in t for t in texts):
                raise ValueError("too long")
            return [[1.0]] * len(texts)

    work = ingest.Processor(str(tmp_path), extract, moody)
    got = {r.doc_id: r.error for r in work(files(spark, a="alpha.", b="beta."), 0).collect()}
    assert got == {0: "no answer", 1: None}
    assert spark.read.parquet(f"{tmp_path}/chunks").select("doc_id").distinct().count() == 1
    rows = spark.createDataFrame([("1", "gamma"), ("2", "delta")], "id string, text string")
    from foliant.sources import providers

    kept = {r.id: (r.v, r.error) for r in providers.embedded(rows.repartition(2, "id"), Short(), 1, failing=True).collect()}
    assert kept == {"1": (None, "too long"), "2": ([1.0], None)}


def test_old_passages_stay_until_a_success(spark, tmp_path):
    source, library = tmp_path / "in", str(tmp_path / "library")
    source.mkdir()
    for name, body in (("a.pdf", "alpha."), ("b.pdf", "broken"), ("c.pdf", "alpha.")):
        (source / name).write_text(body)
    work = ingest.Processor(library, extract, recognise)
    ingest.ingest(ingest.file_stream(spark, str(source)), library, str(tmp_path / "state"), work).awaitTermination(120)
    events = spark.read.parquet(f"{library}/events")
    assert sorted(r.op for r in events.collect()) == ["done", "duplicate", "failed"]
    own = events.filter("op = 'done'").selectExpr("doc_id", "sha256", "filename")
    seen = lambda: ingest.published(spark.read.parquet(f"{library}/events"), spark.read.parquet(f"{library}/chunks")).groupBy("batch").count().collect()
    [(batch, n)] = seen()
    for number, body, op in ((7, "empty", "failed"), (8, "new text.", "done")):
        again = own.withColumn("content", F.lit(body.encode()))
        assert [r.op for r in ingest.requeue(spark, library, again, number, work).collect()] == [op]
        [(now, count)] = seen()
        assert now == (batch if op == "failed" else number) and count == n


def test_an_empty_batch_has_no_rows(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, content binary")
    assert ingest.Processor(str(tmp_path), extract, recognise, HashEmbedder(8))(none, 0).count() == 0


def test_reports_of_pages(spark):
    route = spark.createDataFrame([(1, p, p >= 45) for p in range(46)], "doc_id long, page int, scanned boolean")
    got = [(r.page, round(r.share, 6)) for r in parsing.page_reports(route).orderBy("page").collect()]
    assert got == [(p, round(45 / 75 * p / 45, 6)) for p in (0, 20, 40)]


def test_fields_of_items():
    item = recognition.item_of({"type": 3, "bbox": [1, 2], "page_idx": "x", "list_items": ["a", 1]})
    assert item["type"] is item["bbox"] is item["page_idx"] is None and item["list_items"] == ["a"] and item["table_rows"] == []


REGION = [{"page": 0, "x0": 0.0, "y0": 0.0, "x1": 100.0, "y1": 100.0}]
BOXES = "array<struct<page: int, x0: double, y0: double, x1: double, y1: double>>"


def test_places_from_the_text_layer_and_from_recognition(spark):
    docs = spark.createDataFrame([(1, "a.pdf", "done"), (2, "b.pdf", "done"), (3, "ab.pdf", "failed")], "id long, filename string, status string")
    chunks = spark.createDataFrame([(d * 10, d, 0, 0, "", "Ab ab", REGION) for d in (1, 2, 3)] + [(21, 2, 1, 0, "", "other", REGION)], f"id long, doc_id long, seq int, page_start int, heading string, text string, regions {BOXES}")
    letters = [("A", 10.0), ("b", 15.0), (" ", 20.0), ("a", 25.0), ("b", 30.0)]
    # document 1: a page of 100 x 100 turned by 90 degrees, so that letters stand below each other before and beside each other after
    glyphs = spark.createDataFrame([(1, 0, i, c, 50.0, 100.0 - x - 5, 60.0, 100.0 - x, 90, 100.0, 100.0) for i, (c, x) in enumerate(letters)] + [(2, 0, 0, "a", 0.0, 0.0, 1.0, 1.0, 0, 100.0, 100.0)], "doc_id long, page int, ord int, text string, x0 double, y0 double, x1 double, y1 double, rotation int, width double, height double")
    lines = spark.createDataFrame([(2, 0, 0, "Ab ab", 0.0, 0.0, 50.0, 10.0)], "doc_id long, page int, ord int, text string, x0 double, y0 double, x1 double, y1 double")
    own = service.Library(docs, chunks, lines=lines, glyphs=glyphs)
    one = own.highlights(1, "ab").orderBy("hit_no").collect()
    assert [(h.chunk_id, h.exact, h.ocr, [(b.x0, b.y0, b.x1, b.y1) for b in h.boxes]) for h in one] == [(10, True, False, [(10.0, 50.0, 20.0, 60.0)]), (10, True, False, [(25.0, 50.0, 35.0, 60.0)])]
    two = own.highlights(2, "ab").collect()
    assert len(two) == 2 and all(h.chunk_id == 20 and h.exact and h.ocr for h in two)
    assert own.highlights(3, "ab").count() == 0  # exact search doesn't see failed documents
    assert own.highlights(2, "ab zz").count() == 0
    assert [(r.exact, r.ocr) for r in service.Library(docs, chunks, lines=lines.limit(0)).highlights(1, "ab").collect()] == [(False, False)]
    with pytest.raises(service.Refused):
        own.highlights(1, "")
    with pytest.raises(service.Missing):
        own.document(9)
    assert tuple(own.health().first()) == (3, 0, 4)


def test_hits_go_round():
    assert [highlight.neighbour(2, 1, 3), highlight.neighbour(0, -1, 3), highlight.neighbour(0, 1, 0)] == [0, 2, None]


def test_summaries_from_queue_to_result(spark):
    state = spark.createDataFrame([(1, "a", "done", "queued"), (2, "b", "done", "queued"), (3, "c", "parsing", "queued"), (4, "d", "done", None)], "doc_id long, filename string, status string, summary string")
    chunks = spark.createDataFrame([(d, 0, "H", f"text {d}") for d in (1, 2, 3, 4)], "doc_id long, seq int, heading string, text string")

    def chat(system, prompt):
        if "text 2" in prompt:
            raise RuntimeError("no model")
        return "yes" if "like this" in prompt else "no"

    assert [r.doc_id for r in jobs.summary_queued(state, spark.createDataFrame([(3,), (4,), (4,)], "doc_id long")).collect()] == [4]
    got = {r.doc_id: (r.summary, r.text, r.error) for r in summary.worked(state, chunks, chat, 2000, ["like this"]).collect()}
    assert got == {1: ("done", "yes。", None), 2: ("failed", None, "no model")}
    later = state.withColumn("summary", F.when(F.col("doc_id") == 1, "queued").otherwise("running"))
    assert [r.doc_id for r in summary.accepted(summary.worked(state, chunks, chat, 2000), later).collect()] == [2]
    assert {r.summary for r in jobs.recover_summaries(later).collect()} == {"queued"}
    reports = spark.createDataFrame([(1, t, s, 0.0) for t, s in ((0.0, "a"), (0.5, "a"), (0.6, "b"), (1.2, "b"), (1.6, "b"))], "doc_id long, at double, step string, share double")
    assert [r.at for r in summary.shown_reports(reports).orderBy("at").collect()] == [0.0, 0.6, 1.6]


def test_changes_of_rows(spark):
    state = spark.createDataFrame([(1, "done", "a"), (2, "done", "b")], "doc_id long, status string, message string")
    changes = spark.createDataFrame([(2, "failed", None), (9, "done", "x")], "doc_id long, status string, message string")
    after, known = jobs.changed(state, changes, F.lit("now"))
    assert {tuple(r) for r in after.select("doc_id", "status", "message", "updated_at").collect()} == {(1, "done", "a", None), (2, "failed", "b", "now")}
    assert {tuple(r) for r in known.collect()} == {(2, True), (9, False)}


def test_markdown_and_times(spark):
    said = {
        "# T **b** <x>\n\n- one\n* two\n1. three\nplain **": "<h3>T <strong>b</strong> &lt;x&gt;</h3><ul><li>one</li><li>two</li></ul><ol><li>three</li></ol><p>plain **</p>",
        "- a\n\n- b": "<ul><li>a</li></ul><ul><li>b</li></ul>",
        "## - kept": "<h3>- kept</h3>",
        "": "",
    }
    rows = spark.createDataFrame([(t,) for t in said], "t string").select("t", X.markdown("t").alias("h")).collect()
    assert {r.t: r.h for r in rows} == said
    times = {-3.0: "0 秒", 59.4: "59 秒", 59.6: "1 分 0 秒", 3725.0: "1 小时 2 分"}
    rows = spark.createDataFrame([(s,) for s in times], "s double").select("s", X.elapsed_text(F.col("s")).alias("t")).collect()
    assert {r.s: r.t for r in rows} == times
    shown = spark.sql("SELECT timestamp'2024-05-06 07:08:09' AS t").select(X.stamp(F.col("t")), X.shown_stamp(X.stamp(F.col("t"))), X.shown_stamp(F.lit(None).cast("string"))).first()
    assert tuple(shown) == ("2024-05-06 07:08:09", "2024-05-06 07:08", "–")


def test_words_of_han_text(spark):
    said = {"付款方式 Pay_1付 一": ["付款", "款方", "方式", "pay_1", "付", "一"], "a-b": ["a", "b"], "": []}
    rows = spark.createDataFrame([(t,) for t in said], "t string").select("t", retrieval.tokens("t").alias("w")).collect()
    assert {r.t: r.w for r in rows} == said
    units = spark.createDataFrame([(1, "付款方式：转账"), (2, "质保期为三年"), (3, "x")], "id long, text string")
    words = retrieval.bm25(retrieval.index_of(units), ["款方"])
    assert [r.id for r in words.collect()] == [1]
