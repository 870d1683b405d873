"""Mixing sources to target weights, with DataFrame operations only.

Every row gets a hash-random key; rows are range-split by key within their source into
buckets of bounded size, so that a source of any share is sorted in pieces. Word counts are
summed along (source, key): within a bucket by a window, across buckets by a window over the
bucket totals. A source's budget is whole epochs plus the first words of one more epoch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD

#: Epochs that a source may be repeated at most.
MAX_EPOCHS = 3
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: Rows that one bucket of a source is meant to hold.
BUCKET_ROWS = 4096


def with_sizes(docs: DataFrame) -> DataFrame:
    """Adds _size: the number of words of the whole text; null and empty texts have none."""
    return docs.withColumn("_size", F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.regexp_count("text", F.lit(WORD))).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Each source's budget: _source, source_size, target, _rows.

    The total is shared by weight; targets stop at max_epochs times the source's size and what
    is above is shared again by weight. In order of cap / weight, the capped sources are a
    prefix: the share per weight after k capped ones is (total - their caps) / (the others'
    weights), and a source is capped iff that share, over those before it, reaches its ratio.
    """
    per = sizes.groupBy(F.col("source").alias("_source")).agg(F.sum("_size").alias("source_size"), F.count("*").alias("_rows"))
    ordered = Window.orderBy(F.col("_source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * float(max_epochs))
    everything = Window.partitionBy(F.lit(0))
    by_ratio = everything.orderBy(F.col("_cap") / F.col("_weight"), F.col("_source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    share = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
    per = per.withColumn("_share", share).withColumn("_full", F.col("_share") * F.col("_weight") >= F.col("_cap"))
    open_share = F.max(F.when(~F.col("_full"), F.col("_share"))).over(everything)  # that of the first open source, as later ones subtract caps that don't bind
    return per.select("_source", "source_size", F.when(F.col("_full"), F.col("_cap")).otherwise(open_share * F.col("_weight")).alias("target"), "_rows")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, text, source, _size, source_size, target and taken: the words that the mix takes of each row, repeats counted.

    The words taken of a source sum to its rounded target: the row at the cut is taken in part.
    Keys are md5(seed:doc_id), so that reruns agree; ties go by doc_id, size and a hash of the text, and rows alike in
    all of these are interchangeable. Other columns are not read (mixed_rows carries them). Null sources form a source of their own, which comes last.
    Rows without words are taken with 0. An empty table gives an empty result.
    """
    sized = with_sizes(docs.select("doc_id", "text", "source", *(["_rest"] if "_rest" in docs.columns else []))).withColumn("_key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    sized = sized.withColumn("_tie", F.xxhash64("text"))
    targets = source_targets(sized.select("source", "_size"), weights, max_epochs)
    rows = sized.join(targets, sized["source"].eqNullSafe(targets["_source"]))
    # 12 hex digits of the key make a fraction of [0, 1); its range decides the bucket
    part = F.conv(F.substring("_key", 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
    rows = rows.withColumn("_bucket", F.floor(part * F.ceil(F.col("_rows") / F.lit(float(bucket_rows)))))
    totals = rows.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_total"))
    earlier = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("_source").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    rows = rows.join(totals, rows["_source"].eqNullSafe(totals["_s"]) & (rows["_bucket"] == totals["_b"]))
    within = Window.partitionBy("_source", "_bucket").orderBy("_key", "doc_id", "_size", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("_offset") + F.coalesce(F.sum("_size").over(within), F.lit(0))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div greatest(source_size, 1)")).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("_size") + F.greatest(F.lit(0), F.least(F.col("_size"), rest - ahead))
    return rows.withColumn("taken", taken.cast("long")).drop("_source", "_rows", "_bucket", "_s", "_b", "_offset", "_key", "_tie")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of docs: each row as often as it is taken whole, and a row at a cut once more with just its first words.

    Null and empty texts have no words and don't come; null sources and ids, repeated rows and
    ties are as in mix. An empty table gives an empty result.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "source")]
    packed = docs.select("doc_id", "text", "source", F.struct(*[docs[c] for c in rest] or [F.lit(0)]).alias("_rest"))
    rows = mix(packed, **options).filter("taken > 0")
    rows = rows.withColumn("_words", F.explode(F.expr("transform(sequence(1, cast(ceil(taken / _size) as int)), i -> least(_size, taken - (i - 1) * _size))")))
    pieces = F.regexp_extract_all("text", F.lit(f"{SPACE}*{WORD}"), F.lit(0))
    first = F.array_join(F.slice(pieces, 1, F.col("_words").cast("int")), "")
    whole = rows.withColumn("text", F.when(F.col("_words") < F.col("_size"), first).otherwise(F.col("text")))
    return whole.select(*[F.col("_rest")[c].alias(c) if c in rest else F.col(c) for c in docs.columns])
