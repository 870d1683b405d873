"""Best-fit-decreasing packing of tokenised documents into sequences.

Pieces of one length are interchangeable, and lengths are bounded by the sequence length. So
the exact best-fit-decreasing packing of any number of pieces follows from how many pieces
each length has: at most `capacity` numbers, counted by Spark. The packer takes lengths
downwards and asks a segment tree over remaining capacities for the tightest open bins, in
logarithmic time, filling as many equal bins at once as it can. Its plan (ranges of ranks
within a length -> ranges of sequences and an offset) depends on capacity and not on the
number of documents; each piece finds its place by its rank among pieces of its length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, lean, small_batches

CAPACITY = 2048
#: Words whose ids a worker remembers, twice over.
CACHE_WORDS = 200_000
#: Pieces of one length that one task ranks.
RANK_ROWS = 8192
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class CapacityTree:
    """A segment tree over remaining capacities 0..capacity: how many open bins have each, and the least one >= x that has any."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, bins: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += bins
            i >>= 1

    def tightest(self, least: int) -> int | None:
        i = least + self.leaves
        if self.count[i]:
            return least
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def best_fit_decreasing(lengths: dict[int, int], capacity: int = CAPACITY) -> dict[int, list[tuple[int, int, int, int]]]:
    """lengths: how many pieces each length has. Gives for each length (first rank, pieces, first sequence, offset) in order of ranks: the pieces go to successive sequences.

    A piece goes to the open bin with least room for it. That bin then has less room than
    before, so the next piece of this length goes there too while it fits: each bin of a range
    takes room // length pieces before the next one is touched.
    """
    tree, open_bins, plan, sequences = CapacityTree(capacity), {}, {}, 0

    def put_back(room: int, first: int, bins: int) -> None:
        if bins:
            tree.add(room, bins)
            open_bins.setdefault(room, []).append((first, bins))

    for length in sorted(lengths, reverse=True):
        left, rank, rows = lengths[length], 0, []
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first = capacity, sequences
                bins = -(-left // (room // length))
                sequences += bins
            else:
                first, bins = open_bins[room].pop()
                tree.add(room, -bins)
            each = room // length
            take = min(left, bins * each)
            full, odd = divmod(take, each)
            for layer in range(each):
                if size := full + (layer < odd):
                    rows.append((rank, size, first, capacity - room + layer * length))
                    rank += size
            put_back(room - each * length, first, full)
            put_back(room - odd * length, first + full, int(odd > 0))
            put_back(room, first + full + (odd > 0), bins - full - (odd > 0))
            left -= take
        plan[length] = rows
    return plan


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is printable in Latin-1, else the next one from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in own else next(rest)) for b in range(256)}


class Recent(dict):
    """A cache of two generations: when the young one is full it becomes the old one, and what is still used moves on."""

    def __init__(self, make, most: int):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        if len(key) <= 64:
            self[key] = value
        return value


class WordCache:
    """Token ids of a text, by words: the tokenizer never joins text across white space, so that a word's ids don't depend on its neighbours.

    Most words are Latin letters and then marks. The tokenizer lowers them and splits just
    there, so for these the letters go straight to its merges, which costs a quarter.
    """

    SIMPLE = re.compile(r"([a-zA-ZÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, path: str, words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # control strings in texts are ordinary text
        self.merges, self.letters = self.tokenizer.model, byte_letters()
        self.split = re.compile(WORD).findall
        self.words, self.runs = Recent(self.word, words), Recent(self.run, words)

    def whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def run(self, letters: str) -> bytes:
        return np.array([t.id for t in self.merges.tokenize(letters.encode().decode("latin-1").translate(self.letters))], "<u4").tobytes()

    def word(self, word: str) -> bytes:
        simple = self.SIMPLE.fullmatch(word)
        if not simple:
            return self.whole(word)
        ids = self.runs[simple[1].lower()]
        return ids + self.words[simple[2]] if simple[2] else ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ids = self.words.__getitem__
        return [b"".join(map(ids, self.split(t or ""))) for t in texts]


def tokenise(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cache = WordCache(path)
        for batch in batches:
            for i in range(0, len(batch), 256):
                b = batch.slice(i, 256)
                rows = []
                for doc_id, ids in zip(b.column(0).to_pylist(), cache.encode(b.column(1).to_pylist())):
                    ids += b"\0\0\0\0"
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
                cols = list(zip(*rows))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def place(plan: dict):
    tables = {k: tuple(np.array(c, np.int64) for c in zip(*rows)) for k, rows in plan.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            seq, offset = np.empty(len(b), np.int64), np.empty(len(b), np.int64)
            for k in np.unique(length):
                at = length == k
                first, _, start, off = tables[int(k)]
                i = np.searchsorted(first, rank[at], side="right") - 1
                seq[at], offset[at] = start[i] + rank[at] - first[i], off[i]
            yield pa.record_batch([*b.columns[:5], pa.array(seq), pa.array(offset)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and id 0; null and empty texts are that id alone. Only longer ones
    are cut, into pieces of capacity and one rest. Rows that repeat a doc_id are packed each.
    Other columns are not read. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    pieces = cut(docs.select("doc_id", "text").mapInArrow(lean(tokenise(tokenizer_path, capacity)), PIECES))
    lengths = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    plan = docs.sparkSession.sparkContext.broadcast(best_fit_decreasing(lengths, capacity))
    buckets = max(1, -(-sum(lengths.values()) // RANK_ROWS))
    salted = pieces.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = salted.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    order = Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_i", F.row_number().over(order)).join(counts, ["length", "_b"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_i") - 1).alias("rank"))
    return ranked.mapInArrow(lean(lambda batches: place(plan.value)(batches)), f"{PIECES}, sequence_id long, offset long")
