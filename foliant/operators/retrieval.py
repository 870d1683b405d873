"""Ranked retrieval: postings, BM25, cosine neighbours, fusion."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP, FUSION, BONUS, RERANKED = 100, 60, 0.03, 30
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Runs of letters, digits and underscores, those of Han characters by themselves; the offline segmenter.
HAN = r"\p{IsHan}"
TOKEN = rf"{HAN}+|[\p{{L}}\p{{N}}_&&[^{HAN}]]+"


def tokens(c) -> Column:
    """Lower-cased words; a run of Han characters gives its pairs, a single one itself."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))
    pairs = lambda run: F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substr(run, i, F.lit(2)))
    cut = F.flatten(F.transform(runs, lambda run: F.when(run.rlike(rf"^{HAN}{{2}}"), pairs(run)).otherwise(F.array(run))))
    return F.when(F.col(c).rlike(HAN) if isinstance(c, str) else c.rlike(HAN), cut).otherwise(runs)


@dataclass(frozen=True)
class Index:
    """postings: term, id, tf, dl (tokens of the unit); size: one row, n (units) and tokens."""

    postings: DataFrame
    size: DataFrame


def postings(units: DataFrame) -> DataFrame:
    """units: id, text -> term, id, tf."""
    return units.select("id", F.explode(tokens("text")).alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))


def sized_postings(units: DataFrame) -> DataFrame:
    """units: id, text -> term, id, tf, dl."""
    rows = units.select("id", tokens("text").alias("t")).select("id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    return rows.groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def sizes(units: DataFrame) -> DataFrame:
    return units.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(tokens("text"))), F.lit(0)).alias("tokens"))


def asked_postings(units: DataFrame, query: list[str]) -> DataFrame:
    """The rows of sized_postings for the terms of a query alone: other terms' postings are never made, dealt out or written."""
    low = F.lower("text")
    some = reduce(lambda a, b: a | b, [F.instr(low, t) > 0 for t in query], F.lit(False))  # a token is a part of the lowered text
    wanted = F.array(*map(F.lit, query)).cast("array<string>")
    rows = units.filter(some).select("id", tokens("text").alias("t")).select("id", F.size("t").alias("dl"), F.explode(F.filter("t", lambda x: F.array_contains(wanted, x))).alias("term"))
    return rows.groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def index_of(units: DataFrame, query: list[str] | None = None) -> Index:
    """An index that isn't stored: it is made anew whenever it is asked, for the terms of one query if they are given."""
    return Index(sized_postings(units) if query is None else asked_postings(units, query), sizes(units))


def bm25(index: Index, query: list[str], top: int = TOP, only: DataFrame | None = None) -> DataFrame:
    """id, score (least is best), rank of the `top` best units for any of the terms. Terms that most units have count next to nothing.

    Only the postings of the terms are read. only: ids that may be found; the terms' weights are the whole index's.
    """
    hits = index.postings.filter(F.col("term").isin(*query))
    n, total = index.size.first()  # one row
    average = float(total or 0) / n if total else 1.0
    share = (F.lit(float(n or 0)) - F.col("df") + 0.5) / (F.col("df") + 0.5)
    idf = F.when(F.log(share) > 0, F.log(share)).otherwise(LEAST_IDF)
    weights = hits.groupBy("term").agg(F.count("*").alias("df")).select("term", idf.alias("idf"))
    found = hits.join(only, "id", "left_semi") if only is not None else hits
    f = F.col("tf").cast("double")
    part = F.col("idf") * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.lit(average)))
    scored = found.join(F.broadcast(weights), "term").groupBy("id").agg(F.round(-F.sum(part), 9).alias("score"))  # a row for each term of the query
    return ranked(scored.orderBy("score", "id").limit(top), "score", "id")


def ranked(rows: DataFrame, *order) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def cosine_neighbours(vectors: DataFrame, query: list[float], top: int = TOP) -> DataFrame:
    """vectors: id, v -> id, distance (1 - cosine), rank; the query is a literal, so this is one scan and a top-k. A zero vector has no distance and comes last."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with("v", q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    own = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = vectors.select("id", (F.round(1 - F.try_divide(dot, own * F.lit(math.sqrt(sum(x * x for x in query)))), 6) + F.lit(0.0)).alias("distance"))
    order = F.col("distance").asc_nulls_last(), F.col("id")
    return ranked(rows.orderBy(*order).limit(top), *order)


def fused(first: DataFrame, second: DataFrame) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists (id, rank): id, rrf, rank; ties as in the first list, then the second."""
    one = first.select("id", F.col("rank").alias("r1"))
    two = second.select("id", F.col("rank").alias("r2"))
    both = one.join(two, "id", "full_outer")
    score = F.coalesce(1 / (FUSION + F.col("r1")), F.lit(0.0)) + F.coalesce(1 / (FUSION + F.col("r2")), F.lit(0.0))
    return ranked(both.select("id", F.round(score, 9).alias("rrf"), "r1", "r2"), F.desc("rrf"), F.col("r1").asc_nulls_last(), "r2")


def with_bonus(list_: DataFrame, units: DataFrame, terms: list[str]) -> DataFrame:
    """Fused ids that still exist, raised by the share of the literal terms in their texts. The list is short (2 * TOP), so the texts stay where they are."""
    has = reduce(lambda a, b: a + b, [(F.instr(F.lower("text"), t) > 0).cast("int") for t in terms])
    rows = units.join(F.broadcast(list_), "id").select("id", F.round(F.col("rrf") + BONUS * has / len(terms), 9).alias("score"), F.col("rank").alias("before"))
    return ranked(rows, F.desc("score"), "before")


def reranked(list_: DataFrame, scores: DataFrame, head: int = RERANKED) -> DataFrame:
    """list_: id, rank; scores: id, score of a reranker for the head. The head is sorted anew, stable; the tail stays."""
    rows = list_.join(scores, "id", "left").withColumn("in_head", F.col("rank") <= head)
    rr = F.when(F.col("in_head"), F.coalesce("score", F.lit(-1e9))).otherwise(F.lit(-1e9))
    return rows.select("id", F.col("rank").alias("before"), F.row_number().over(Window.orderBy(F.desc("in_head"), rr.desc(), "rank")).alias("rank"))
