"""Neighbours against brute force, the classifier's accuracy on held-out labels, and the pipeline's stages."""

import random

import numpy as np
import pytest

import corpus_pipeline
from foliant.llm import neighbours, quality
from foliant.llm.common import documents

DATA = "/root/testdata/sf0.01"


def brute(ids, x, query, k):
    d = np.sqrt(((x - x[ids.index(query)]) ** 2).sum(axis=1))
    order = sorted((dist, i) for dist, i in zip(d.tolist(), ids) if i != query)
    return order[:k]


def test_recall_and_exact_distances(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16)) * 3
    x = (centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 16))).astype(np.float32)
    x[500:1500] = x[500]  # one vector is a third of all
    vectors = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, leaf int").repartition(4)
    rows = neighbours.nearest_neighbours(vectors, sample=1500, chunk=200).collect()
    got: dict = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    y, hits = x.astype(np.float64), 0
    for q in range(0, 3000, 100):
        want = brute(list(range(3000)), y, q, 10)
        assert len(got[q]) == 10
        assert all(s == pytest.approx(float(np.sqrt(((y[v] - y[q]) ** 2).sum())), rel=1e-12) for s, v in got[q])
        hits += len({v for _, v in got[q]} & {v for _, v in want})
        if 500 <= q < 1500:
            assert got[q] == want  # ties go to the smaller ids
    assert hits >= 0.9 * 300


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (200, [1.0]), (300, None)]
    got = neighbours.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(0, 1, 1), (0, 2, 100), (100, 1, 1), (100, 2, 0)]
    assert neighbours.nearest_neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_distances_beyond_the_range_come_last(spark):
    rows = [(0, [1e200, 0.0]), (1, [1e200, 1.0]), (2, [-1e200, 0.0]), (3, [-1e200, 5.0])]
    got = neighbours.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1, 1.0), (2, 2, float("inf")), (3, 3, float("inf"))]


def test_pipeline_of_odd_tables(spark, tmp_path):
    rows = [(None, "a b c d e f", None, None, None), (None, "a b c d e f", "en", "s", 1), (7, None, "en", "s", 0), (7, "", "en", None, 0), (8, "x " * 5000, "en", "s", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/some/documents.parquet")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/none/documents.parquet")
    for d in ("some", "none"):
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{d}/labels.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/some").collect()} == {None, 8}  # rows without words aren't mixed in
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_classifier_on_held_out_labels(spark):
    docs = documents(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    known, asked = labels.filter("doc_id % 3 > 0"), labels.filter("doc_id % 3 = 0").selectExpr("doc_id", "quality", "toxic AS is_toxic")
    rows = quality.classify(docs, known).join(asked, "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and not r.is_toxic]
    assert np.mean([r.kept for r in good]) > 0.98
    assert np.mean([not r.quality_ok for r in rows if r.quality == 0]) > 0.95
    assert np.mean([r.toxic for r in rows if r.is_toxic]) > 0.8  # 0.85 when written


def test_classifier_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, True), (1, None, None, None, True), (2, "", "en", "s", True), (None, "x " * 50000, "en", "s", True)], "doc_id long, text string, lang string, source string, kept boolean")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.classify(docs, none).collect()
    assert len(rows) == 4 and all(r.kept for r in rows)
    one = spark.createDataFrame([(1, 1, 0), (1, None, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, one).count() == 4
    assert quality.classify(docs.limit(0), none).count() == 0
    assert quality.drop_refused(docs, none).columns == docs.columns


def test_rows_are_dropped_by_their_own_verdict(spark):
    rng = random.Random(3)
    good = lambda: " ".join(rng.choices([f"w{i}" for i in range(900)], k=60))
    bad = lambda: " ".join(f"{w}%%%" for w in good().split())
    rows = [(i, good() if i < 200 else bad(), "en", "s", "x") for i in range(240)]
    rows += [(i, t(), "en", "s", f"{i} {t is good}") for i in (None, 9000) for t in (good, bad)]  # a null id and a shared one
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, mark string").repartition(3)
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i in range(240)], "doc_id long, quality int, toxic int")
    kept = quality.drop_refused(docs, labels)
    assert kept.schema == docs.schema
    assert sorted(r.mark for r in kept.collect()) == ["9000 True", "None True", *["x"] * 200]


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(900)]
    rows = []
    for i in range(200):
        text = " ".join(rng.choices(words, k=60))
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        if i % 20 == 0:
            rows.append((1000 + i, text.replace(" ", "  "), "en", "s0", len(text)))  # longer copy
            rows.append((2000 + i, text.rsplit(" ", 3)[0] + " zz yy xx", "en", "s1", len(text)))  # near copy
        if i % 5 == 0:
            rows.append((3000 + i, " ".join(f"{w}%%%" for w in rng.choices(words, k=60)), "en", "s2", 1))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 3000), 0) for r in rows if r[0] % 2 == 0], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = documents(spark, str(tmp_path)), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name != "best-fit packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    good, exact, near, mixed, packed = seen
    assert not {i for i in good if i >= 3000} and {r[0] for r in rows if r[0] < 3000} - good == set()
    assert {i for i in good - exact} == {i for i in range(0, 200, 20)}  # the longer copies stay
    assert exact - near == {2000 + i for i in range(0, 200, 20)}  # of near copies the smallest id stays
    assert mixed <= near and packed == mixed
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
