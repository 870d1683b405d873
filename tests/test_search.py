"""Exact search over small libraries with expectations worked out by hand."""

import pytest

from foliant import catalog
from foliant.functions import text as X
from foliant.operators import retrieval, search
from foliant.sources.providers import HashEmbedder

DOCS = "id long, filename string, status string"
CHUNKS = "id long, doc_id long, seq int, page_start int, heading string, text string"


@pytest.fixture(scope="module")
def library(spark):
    docs = spark.createDataFrame([(1, "甲.pdf", "done"), (2, "乙.pdf", "done"), (3, "智慧城市项目扫描件.pdf", "done"), (4, "投标方案.pdf", "done"), (5, "处理中的扫描件.pdf", "parsing")], DOCS)
    chunks = spark.createDataFrame(
        [
            (10, 1, 0, 0, "", "付款方式：转账"),
            (11, 1, 0, 0, "", "付款方式一；付款方式二"),
            (20, 2, 0, 0, "", "付款方式：现金"),
            (21, 2, 0, 0, "", "无关内容 aaaa ÉCOLE école"),
            (30, 3, 0, 0, "", "质保期为三年"),
            (40, 4, 0, 0, "", "本方案不涉及扫描件"),
            (50, 5, 0, 0, "", "扫描件 付款方式"),
        ],
        CHUNKS,
    )
    return chunks, docs


def found(df):
    return {r.filename: (r.filename_match, r.hit_count, r.chunk_count) for r in df.collect()}


def test_groups_and_counts(library):
    rows = search.grouped(*library, "付款方式").orderBy("rank").collect()
    assert [(r.filename, r.hit_count, r.chunk_count) for r in rows] == [("甲.pdf", 3, 2), ("乙.pdf", 1, 1)]
    total = search.totals(*library, "付款方式").first()
    assert tuple(total) == (2, 4, 3)


def test_filename_only_documents_have_no_chunks(library):
    assert found(search.grouped(*library, "扫描件")) == {"智慧城市项目扫描件.pdf": (True, 0, 0), "投标方案.pdf": (False, 1, 1)}


def test_terms_may_be_split_between_name_and_text(library):
    assert found(search.grouped(*library, "扫描件 质保期")) == {"智慧城市项目扫描件.pdf": (False, 1, 1)}


def test_overlaps_and_case(library):
    one = lambda q: [r.n_hits for r in search.keyword_matches(*library, q).collect()]
    assert one("aa") == [2]
    assert one("ÉCOLE") == [1]  # the query is lowered in full, stored text in ASCII only
    assert one("école") == [1]


@pytest.mark.parametrize("blank", ["", " ", "　\t"])
def test_blank_queries_find_nothing(library, blank):
    assert search.grouped(*library, blank).count() == 0
    assert search.keyword_matches(*library, blank).count() == 0
    assert search.totals(*library, blank).first()[0] == 0


def test_document_zero_is_no_filter(library):
    assert search.keyword_matches(*library, "付款方式", 0).count() == 3
    assert search.keyword_matches(*library, "付款方式", 2).count() == 1


def test_pages_are_complete(spark):
    docs = spark.createDataFrame([(1, "big.pdf", "done"), (2, "small.pdf", "done")], DOCS)
    chunks = spark.range(2600).selectExpr("id", "1L doc_id", "0 seq", "cast(id div 10 as int) page_start", "'' heading", "concat('项目', if(id % 2 = 1, '项目', '')) text").unionByName(spark.range(3000, 3300).selectExpr("id", "2L doc_id", "0 seq", "0 page_start", "'' heading", "'项目' text"))
    assert tuple(search.totals(chunks, docs, "项目").first()) == (2, 4200, 2900)
    seen = [r for at in (0, 1000, 2000) for r in search.hits_page(chunks, docs, "项目", 1, at, 1000).orderBy("place").collect()]
    assert [r.id for r in seen] == list(range(2600)) and {r.total for r in seen} == {2600}
    assert search.previews(chunks, docs, "项目").filter("doc_id = 1").count() == 3


def test_snippets_and_marks(spark):
    df = spark.createDataFrame([("x " * 30 + "Needle <b> | \n end",)], "t string")
    assert df.select(X.snippet("t", ["needle"])).first()[0].startswith("…x x x")
    assert df.select(X.marked("t", ["needle"])).first()[0].endswith("<mark>Needle</mark> &lt;b&gt; | \n end")
    assert X.terms_of("  A b　a B ") == ["a", "b"]


def test_hybrid_service_sees_every_passage(spark, tmp_path):
    words = [f"w{i}" for i in range(200)]
    opposed = next(f"{a} {b}" for a in words for b in words if not any(HashEmbedder().embed([f"{a} {b}"])[0]))
    texts = {0: "thanedble the", 1: f"{opposed}\nthe thanedble again", 2: "nothing of it", 3: "a | thanedble | table"}
    spark.createDataFrame([(i, t, "en", "s") for i, t in texts.items()], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = catalog.queries()["hybrid_service"](spark, str(tmp_path)).orderBy("rank").collect()
    assert [r.doc_id for r in rows][0] == 1 and {r.doc_id for r in rows} == {1, 2, 3, 4}  # ids from 1 on; every passage is among the nearest hundred
    assert {r.doc_id: r.chunk_count for r in rows} == {1: 1, 2: 2, 3: 1, 4: 1}


def test_zero_vectors_come_last(spark):
    vectors = spark.createDataFrame([(1, [0.0, 0.0]), (2, [-1.0, 0.0]), (3, [1.0, 0.0])], "id long, v array<float>")
    assert [(r.id, r.distance) for r in retrieval.cosine_neighbours(vectors, [1.0, 0.0]).orderBy("rank").collect()] == [(3, 0.0), (2, 2.0), (1, None)]
