"""Stages keep all columns of documents, whatever they are called."""

from foliant.llm import exact_dedup, mixing, near_dedup, quality

ODD = "doc_id long, text string, lang string, source string, _id long, _ID2 string, _sha string, _of int, _points int, _nth int, _size string, taken string, target double, _rest string, _words int, _key string, kept boolean, node long"


def test_names_that_clash(spark):
    def row(i, text):
        return (i, text, "en", "s", 7, "x", "sha", 1, 2, 3, "size", "taken", 0.5, "rest", 9, "key", False, 4)

    docs = spark.createDataFrame([row(1, "a b c d e f"), row(2, "a b c d  e f"), row(3, "other words are here now"), row(None, None)], ODD)
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    for stage in (exact_dedup.drop_copies, near_dedup.drop_near, mixing.mixed_rows, lambda d: quality.drop_refused(d, labels)):
        out = stage(docs)
        assert out.schema.simpleString() == docs.schema.simpleString()
        rows = out.collect()
        assert rows and all(tuple(r)[2:] == row(0, "")[2:] for r in rows)
    assert {r.doc_id for r in exact_dedup.drop_copies(docs).collect()} == {2, 3, None}
    assert {r.doc_id for r in near_dedup.drop_near(docs).collect()} == {1, 3, None}
    for stage in (exact_dedup.drop_copies, near_dedup.drop_near, mixing.mixed_rows, lambda d: quality.drop_refused(d, labels)):
        assert stage(docs.limit(0)).count() == 0
