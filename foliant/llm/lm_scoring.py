"""Language-model scores of documents: a word-unigram base and prediction by partial matching.

The counts come from all training texts and none is left out, so they grow with the corpus and
stay distributed. Documents are dealt into parts of bounded size; each part counts its own
distinct words and grams of the highest order, held-out texts' with 0, and Spark sums the
counts over the parts. Lower orders are sums of the highest one, so that the shorter form of
every gram is at hand. The probability of each gram is worked out by joins and windows of at
most 256 rows to a key, and each part is scored beside the answers for what it asked.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ppm
from .common import cut

#: Bytes of context; text bytes of a part; held-out documents: 1 in FOLDS.
ORDER, PART_BYTES, FOLDS = 5, 16 << 20, 10
#: Prior of the word model.
ALPHA = 0.1
END = b"\n"


def words_of(text: str | None) -> list[bytes]:
    """ASCII letters lowered, then the runs without white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def hash_of(word: bytes) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(word), "big", signed=True)


class Sums:
    """Counts by key, as arrays."""

    def __init__(self):
        self.held, self.size, self.most = [], 0, 1_000_000

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.held.append((keys, counts))
        self.size += len(keys)
        if self.size > self.most:
            self.held = [self.merged()]
            self.size = len(self.held[0][0])
            self.most = 1_000_000 + self.size

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate(x) for x in zip(*self.held))
        at = np.argsort(keys, kind="stable")  # runs in order are merged
        keys = keys[at]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[starts], np.add.reduceat(counts[at], starts)


def count_part(order: int):
    """part, whether a gram, gram or word hash, occurrences in training texts, for each distinct word and gram of a part, held-out texts' too."""

    def counted(part: int, words: Sums, grams: Sums) -> Iterator[pa.RecordBatch]:
        for is_gram, sums in ((False, words), (True, grams)):
            keys, counts = sums.merged()
            yield pa.record_batch([pa.array(np.full(len(keys), part, np.int64)), pa.array(np.full(len(keys), is_gram)), pa.array(keys.view(np.int64)), pa.array(counts)], names=["part", "is_gram", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of part, so that one part is held at a time."""
        part, words, grams = None, Sums(), Sums()
        for b in batches:
            for i in range(0, len(b), 1024):
                some = b.slice(i, 1024)
                for (own, held_out), rows in groupby(zip(*(c.to_pylist() for c in some.columns)), lambda r: (r[0], r[2])):
                    if own != part:
                        if part is not None:
                            yield from counted(part, words, grams)
                        part, words, grams = own, Sums(), Sums()
                    split = [words_of(t) for _, t, _ in rows]
                    seen = Counter({END: len(split)})
                    for ws in split:
                        seen.update(ws)
                    keys = np.fromiter(map(hash_of, seen), np.int64, len(seen))
                    counts = np.fromiter(seen.values(), np.int64, len(seen))
                    at = np.argsort(keys)
                    words.add(keys[at], counts[at] * (not held_out))
                    keys, counts = ppm.gram_counts([b" ".join(ws) for ws in split], order)
                    grams.add(keys, counts * (not held_out))
        if part is not None:
            yield from counted(part, words, grams)

    return run


def probabilities(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """grams: key (of order `order`), n (0 if only held-out texts have it) -> key, p, as the module ppm describes it.

    A context's symbols are all known after the shorter context too, so what a longer context
    excludes there is a sum of plain shares.
    """
    known = None
    for o in range(order + 1):
        short = lambda width: F.col("key").bitwiseAND(F.lit((1 << (8 * width)) - 1))
        own = grams if o == order else grams.groupBy(short(o + 1).alias("key")).agg(F.sum("n").alias("n"))
        own = own.withColumn("short", short(o)).join(known, "short") if o else own.withColumn("lower", F.lit(1 / 256))
        after = Window.partitionBy("context")
        own = own.withColumn("context", F.shiftrightunsigned("key", 8)).select(
            "key", "n", "lower", F.sum("n").over(after).alias("total"), F.count_if(F.col("n") > 0).over(after).alias("symbols"), F.sum(F.when(F.col("n") > 0, F.col("lower")).otherwise(0.0)).over(after).alias("excluded")
        )
        escape = 0.5 * F.col("symbols") / F.col("total") / F.greatest(1 - F.col("excluded"), F.lit(1e-12))
        p = F.when(F.col("n") > 0, (F.col("n") - 0.5) / F.col("total")).when(F.col("total") > 0, escape * F.col("lower")).otherwise(F.col("lower"))
        known = own.select(F.col("key").alias("short"), p.alias("lower"))
    return known.select(F.col("short").alias("key"), F.col("lower").alias("p"))


SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score_part(order: int, train_tokens: int, train_words: int):
    floor = math.log10(train_tokens + ALPHA * (train_words + 1))

    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        is_gram = known["is_gram"].to_numpy()
        keys, values = known["key"].to_numpy(), known["value"].to_numpy()
        grams = ppm.Table(keys[is_gram].view(np.uint64), values[is_gram])
        hashes, counts = keys[~is_gram], values[~is_gram]
        at = np.argsort(hashes, kind="stable")
        hashes, counts = hashes[at], counts[at]
        out = []
        for i in range(0, len(docs), 1024):
            some = docs.slice(i, 1024)
            split = [[*words_of(t), END] for t in some["text"].to_pylist()]
            own = list({w for ws in split for w in ws})
            c = counts[np.searchsorted(hashes, np.fromiter(map(hash_of, own), np.int64, len(own)))]
            log, known_words = dict(zip(own, np.log10(c + ALPHA).tolist())), {w for w, n in zip(own, c.tolist()) if n}
            score = ppm.sums(lambda k: grams.find(k)[1], order, [b" ".join(ws[:-1]) for ws in split])
            for doc_id, held_out, ws, s in zip(some["doc_id"].to_pylist(), some["held_out"].to_pylist(), split, score.tolist()):
                out.append((doc_id, held_out, len(ws), sum(map(known_words.__contains__, ws)), train_tokens, math.fsum(map(log.__getitem__, ws)) - len(ws) * floor, s))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), SCORES.types)], schema=SCORES) if out else SCORES.empty_table()

    return run


def score_documents(docs: DataFrame, order: int = ORDER, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from documents whose crc32(doc_id as text) mod 10 is not 0 (a null id counts as the
    empty text, so it is held out). Null and empty texts are one end. Words are told apart by
    64-bit hashes. Both models score the lowered words, with one space between, and the end;
    both know every word or gram of the training texts, whatever its count.
    If there is no training text, every count is 0. Other columns are not read; rows that
    repeat count each; an empty table gives an empty result.
    """
    rows = docs.select("doc_id", "text", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0).alias("held_out"))
    text_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-text_bytes // part_bytes))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(parts)))
    asked = dealt.select("part", "text", "held_out").repartition("part").sortWithinPartitions("part", "held_out").mapInArrow(count_part(order), "part long, is_gram boolean, key long, n long")
    everywhere = Window.partitionBy("key", "is_gram")
    known = cut(asked.select("part", "is_gram", "key", F.sum("n").over(everywhere).alias("total"), (F.row_number().over(everywhere.orderBy("part")) == 1).alias("first")))
    tokens, words = known.filter("first AND NOT is_gram").agg(F.coalesce(F.sum("total"), F.lit(0)), F.count_if(F.col("total") > 0)).first()
    grams = cut(known.filter("first AND is_gram").select("key", F.col("total").alias("n")))
    answers = known.filter("NOT is_gram").select("part", "is_gram", "key", F.col("total").cast("double").alias("value"))
    answers = answers.union(known.filter("is_gram").select("part", "is_gram", "key").join(probabilities(grams, order).hint("shuffle_hash"), "key").select("part", "is_gram", "key", F.log10("p")))
    both = dealt.groupBy("part").cogroup(answers.groupBy("part"))
    return both.applyInArrow(score_part(order, tokens, words), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
