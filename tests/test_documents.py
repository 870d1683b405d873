"""Chunking, places on the page, summaries, files and streams."""

import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.operators import chunking, highlight, jobs, library, summary
from foliant.sources import files, providers, recognition
from foliant.streaming import ingest

ALPHABET = st.text(st.sampled_from("ab中。！\n "), max_size=120)


@given(ALPHABET)
def test_pieces_join_to_the_text(text):
    pieces = chunking.split_text(text, 10, 20)
    assert all(len(p) <= 20 for p in pieces)
    joined = "".join(pieces)
    assert text.startswith(joined) and not text[len(joined) :].strip() or joined == text


@given(st.lists(st.text(st.sampled_from("xyz|"), max_size=40), min_size=1, max_size=12), st.integers(6, 60))
def test_rows_of_tables_stay_in_order_under_the_head(lines, most):
    text = "\n".join(lines)
    pieces = chunking.split_table(text, most)
    if len(text) <= most:
        assert pieces == [text]
    elif len(lines) == 1:
        assert "".join(pieces) == text and max(map(len, pieces)) <= most
    else:
        bodies = [p.split("\n") for p in pieces]
        assert all(head == lines[0] and rows for head, *rows in bodies)
        assert "".join(r for _, *rows in bodies for r in rows) == "".join(lines[1:])
        for (_, *rows), (_, first, *_) in zip(bodies, bodies[1:]):
            assert len(rows) == 1 or len(lines[0]) + sum(map(len, rows)) <= most
            assert len(lines[0]) + sum(map(len, rows)) + len(first) > most  # no piece could have taken one more


def test_cells_of_recognised_tables():
    rows = recognition.table_rows("<table><td>lost</td><TR><th class=a>x &amp; y<!-- <td>no</td> --><th>u<b>v</b></th></tr>between<tr></tr><tr><td>1\n2</td></table>")
    assert rows == [["lost"], ["uv"], [], ["1\n2"]]
    assert recognition.table_rows(None) == recognition.table_rows("no table") == []


def test_headings_regions_and_joins(spark):
    rows = [(0, "title", "One", 1, False), (1, "text", "ab", 0, False), (2, "text", "cd", 0, True), (3, "title", "Deep", 3, False), (4, "text", "中", 0, False), (5, "text", "文", 0, True), (6, "title", "Two", 1, False), (7, "table", "x | y", 0, False)]
    blocks = spark.createDataFrame([(1, o, 0, 0.0, float(o), 1.0, o + 1.0, k, t, lv, c) for o, k, t, lv, c in rows], "doc_id long, ord int, page int, x0 double, y0 double, x1 double, y1 double, kind string, text string, level int, cont boolean")
    got = [(r.seq, r.kind, r.heading, r.text, len(r.regions)) for r in chunking.build_chunks(blocks).orderBy("seq").collect()]
    assert got == [(0, "text", "One", "ab cd", 2), (1, "text", "One > Deep", "中文", 2), (2, "table", "Two", "x | y", 1)]


def test_line_characters():
    chars = highlight.Letters([(1, "x y大", 100, 0, 124, 10), (0, "上下", 5, 10, 15, 50), (0, "", 0, 0, 1, 1)])
    assert chars.pages.tolist() == [0, 0, 1, 1, 1] and "".join(chars.letters) == "上下xy大"
    assert chars.boxes[:2].tolist() == [[5, 10, 15, 30], [5, 30, 15, 50]]  # a tall line runs downwards
    starts = 100 + 24 / 2.4 * np.array([0, 0.55 + 0.3, 1.1 + 0.3])
    assert chars.boxes[2:, 0] == pytest.approx(starts) and chars.boxes[-1, 2] == pytest.approx(124)


def test_hits_across_lines_are_shared_out():
    chars = highlight.Letters([(3, "the river ban", 10.0, 40.0, 75.0, 50.0), (3, "k river", 10.0, 56.0, 45.0, 66.0)])
    region = [(3, 0.0, 30.0, 90.0, 80.0)]
    hits = highlight.document_hits([(7, "the river bank", region), (8, "k river", region)], chars, {3}, ["river", "riverbank"])
    assert [(c, len(b), exact) for c, b, exact in hits] == [(7, 1, True), (8, 2, True), (7, 1, True)]  # in reading order; the first passage has two words to give
    assert hits[1][1] == [(3, 29.1, 40.0, 75.0, 50.0), (3, 10.0, 56.0, 15.3, 66.0)]  # over the line's end
    assert highlight.document_hits([(1, "river bank", region)], highlight.Letters([]), set(), ["bank"]) == [(1, region, False)]


def test_summary_parts_and_answers():
    text = "\n".join(f"line {i} " + "x" * random.Random(i).randrange(20) for i in range(100))
    parts = summary.split_text(text, 60)
    assert all(len(p) <= 60 for p in parts) and "\n".join(parts) == text
    assert all(a < b for a, b in summary.part_spans(text, 60)) and summary.split_text("a\n" * 3 + " \n ", 4) == ["a\na", "a\n "]
    calls = []

    def chat(system, prompt):
        calls.append(prompt)
        if len(prompt) > 3500:
            raise summary.ContextOverflow
        return "note"

    assert summary.summarise("x", "y\n" * 4000, chat, 6000) == "note"
    assert "notes" in calls[-1]
    with pytest.raises(summary.ContextOverflow):
        summary.summarise("x", "y" * 4000, lambda s, p: (_ for _ in ()).throw(summary.ContextOverflow()), 2000)


def test_answers_become_one_paragraph(spark):
    said = {"# Title\n* **first**\n3) second。\nthird，": "first；second。third。", "": "", "  \n\n": "", "done！": "done！", "a\r\n-\r\nb": "a；；b。", "服务内容：\n项目服务内容: x": "x。"}
    rows = spark.createDataFrame([(t,) for t in said], "text string").select("text", summary.paragraph(F.col("text")).alias("p")).collect()
    assert {r.text: r.p for r in rows} == said
    docs = spark.createDataFrame([(1, "n", "words"), (2, "n", "boom")], "doc_id long, filename string, text string")

    def chat(system, prompt):
        if "boom" in prompt:
            raise OSError("no answer")
        return "- one\n- two"

    assert [tuple(r) for r in summary.summaries(docs, chat, 5000).orderBy("doc_id").collect()] == [(1, "one；two。", None), (2, None, "no answer")]


def test_providers():
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return 7

    assert providers.with_retries(flaky, sleep=lambda s: None) == 7
    with pytest.raises(providers.Rejected):
        providers.with_retries(lambda: (_ for _ in ()).throw(providers.Rejected()), sleep=lambda s: None)
    now = [0.0]
    breaker = providers.Breaker(10, lambda: now[0])
    assert breaker.call(lambda: 1 / 0) is None and breaker.call(lambda: 5) is None
    now[0] = 11
    assert breaker.call(lambda: 5) == 5
    events = list(providers.stream_events(['data: {"choices":[{"delta":{"reasoning_content":"' + "t" * 30 + '"}}]}', "", 'data: {"choices":[{"delta":{"content":"好的"}}]}', "data: [DONE]", "data: x"]))
    assert [(n, t) for _, n, t in events] == [(0, 30), (2, 30)]


def test_state_rules(spark):
    events = spark.createDataFrame([(1, 1, "2024-01-01", "queued"), (2, 1, "2024-01-02", "done"), (3, 2, "2024-01-01", "parsing"), (4, 3, "2024-01-01", "done"), (5, 3, "2024-01-05", "deleted"), (6, 4, "2024-01-01", "importing")], "event_id long, doc_id long, ts string, op string")
    state = jobs.current(events)
    assert {(r.doc_id, r.status) for r in state.collect()} == {(1, "done"), (2, "parsing"), (4, "importing")}
    assert {(r.doc_id, r.queued) for r in jobs.requeue(state).collect()} == {(1, True), (2, False), (4, False)}
    assert {(r.doc_id, r.status) for r in jobs.recover(state).collect()} == {(1, "done"), (2, "queued"), (4, "failed")}


def test_listing_of_classes(spark):
    docs = spark.createDataFrame([(i, f"file{i:02}.pdf", 1, "done") for i in range(23)] + [(23, "f", 1, "failed"), (24, "q", 1, "queued"), (25, "q", 1, "queued"), (26, "p", 1, "parsing")], "id long, filename string, size long, status string")
    assert tuple(library.class_counts(docs).first()) == (27, 3, 23, 1)
    assert tuple(library.class_counts(docs, "file0").first()) == (10, 0, 10, 0)
    assert [r.queue_pos for r in library.page(docs, 1, 10).orderBy("id").collect() if r.queue_pos] == [1, 2]
    assert tuple(library.overall(docs.limit(0)).first()) == (0, 0)
    with pytest.raises(ValueError):
        library.listed(docs, "other")


def test_names_of_missing_documents_are_empty(spark):
    rows = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "id long, doc_id long")
    docs = spark.createDataFrame([(5, "a.pdf")], "id long, filename string")
    assert sorted((r.id, r.filename) for r in library.named(rows, docs).collect()) == [(1, "a.pdf"), (2, ""), (3, "")]


def test_registration(spark):
    rows = spark.createDataFrame([(1, "a.pdf", "x"), (2, "b.PDF", "x"), (3, "c.webp", "y"), (4, "d.doc", "z")], "ord long, filename string, sha256 string")
    known = spark.createDataFrame([("z",)], "sha256 string")
    assert {r.ord: (r.duplicate, r.error) for r in files.register(rows, known).collect()} == {1: (False, None), 2: (True, None), 3: (False, "unsupported"), 4: (True, None)}


def test_stream_of_files(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    (folder / "a.pdf").write_bytes(b"one")
    (folder / "~$a.pdf").write_bytes(b"lock")
    assert files.scan_folder(spark, str(folder)).count() == 1

    def work(new, batch):
        new.selectExpr("doc_id", "cast(content AS string) AS text").write.mode("overwrite").parquet(f"{out}/chunks/batch={batch}")
        return new.selectExpr("doc_id", "cast(null AS string) AS error")

    for name, body in (("b.pdf", b"two"), ("c.pdf", b"one")):
        ingest.ingest(ingest.file_stream(spark, str(folder)), str(out), str(tmp_path / "state"), work).awaitTermination(60)
        (folder / name).write_bytes(body)
    ingest.ingest(ingest.file_stream(spark, str(folder)), str(out), str(tmp_path / "state"), work).awaitTermination(60)
    events = {(r.filename, r.op) for r in spark.read.parquet(f"{out}/events").collect()}
    assert ("a.pdf", "done") in events and ("c.pdf", "duplicate") in events
    assert sorted(r.text for r in spark.read.parquet(f"{out}/chunks").collect()) == ["one", "two"]


def test_embedding_in_batches(spark):
    units = spark.range(40).selectExpr("id", "concat('word', id) AS text")
    rows = providers.embedded(units, providers.HashEmbedder(8)).collect()
    assert len(rows) == 40 and all(abs(sum(x * x for x in r.v) - 1) < 1e-5 for r in rows)
