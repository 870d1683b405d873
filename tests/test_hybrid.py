"""Hybrid search that is asked once: nothing is stored for it, and its rows are those of a stored index."""

from pyspark.sql import functions as F

from foliant import catalog
from foliant.operators import retrieval
from foliant.plans import service, views
from foliant.sources.providers import HashEmbedder, embedded

DATA = "/root/testdata/sf0.001"


def test_postings_of_a_query_are_those_of_the_index(spark):
    texts = ["The the theme", "付款方式，款方", "İstanbul ISTANBUL i̇stanbul", "", None, "a_b a b", "the 付款方 THE"]
    units = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for query in (["the", "theme"], ["付款", "款方"], ["istanbul", "i"], ["a_b"], ["missing"], []):
        want = retrieval.sized_postings(units).filter(F.col("term").isin(query))
        assert sorted(retrieval.asked_postings(units, query).select(want.columns).collect()) == sorted(want.collect())


def test_one_question_stores_nothing(spark):
    before = dict(views.WRITTEN)  # what other tests have stored
    found = catalog.queries()["hybrid_service"](spark, DATA)
    assert views.WRITTEN == before  # no passages and no postings
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "foliant-" not in plan
    docs, chunks = views.library_documents(spark, DATA), views.line_chunks(views.library_documents(spark, DATA))
    units = chunks.select("id", service.retrieval_text().alias("text"))
    vectors = embedded(chunks.select("id", service.embedding_text().alias("text")), HashEmbedder())
    stored = service.Library(docs, chunks, vectors, HashEmbedder(), semantic=True, words=retrieval.index_of(units)).search("thanedble the", "hybrid")[0]
    assert sorted(found.collect()) == sorted(stored.collect())
