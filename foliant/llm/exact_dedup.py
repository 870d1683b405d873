"""Exact deduplication with Patricia-trie owners.

Texts are equal when identical after deleting white space. Each input task inserts its full
byte strings into one compressed radix trie, whose terminal nodes hold the owner so far and
the number of rows, so that a group of copies of any size leaves one row per task. Strings
are then dealt into partitions by (length, content hash) and folded again, into one trie for
as many hashes as fit. A map-side trie over its budget spills whole subtrees, the largest
first, as partial results that the second fold takes up. The second side gets its strings
sorted by (length, hash); where a hash ends, all strings so far are whole, and a trie over its
budget is given out and begun anew. So neither side holds more than its budget and one hash.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_BYTES, lean, small_batches, spare

#: Bytes that a task's trie may hold before subtrees are spilled.
TRIE_BYTES = 48 << 20
NODE_BYTES = 240


def common_prefix(a: bytes, i: int, b: bytes) -> int:
    """Length of the longest common prefix of a[i:] and b."""
    n = min(len(a) - i, len(b))
    if a[i : i + n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[i + lo : i + mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class Node:
    __slots__ = ("label", "children", "owner")

    def __init__(self, label: bytes):
        self.label, self.children, self.owner = label, {}, None


class Patricia:
    """A compressed radix trie over bytes. A terminal holds [-code points, no id, doc_id] of its owner (smallest first) and the number of rows."""

    def __init__(self):
        self.root, self.bytes = Node(b""), NODE_BYTES

    def insert(self, key: bytes, rank: tuple, rows: int = 1) -> None:
        node, i = self.root, 0
        while i < len(key):
            child = node.children.get(key[i])
            if child is None:
                child = node.children[key[i]] = Node(key[i:])
                self.bytes += NODE_BYTES + len(key) - i
                node, i = child, len(key)
                break
            n = common_prefix(key, i, child.label)
            if n < len(child.label):
                upper = Node(child.label[:n])
                node.children[key[i]] = upper
                child.label = child.label[n:]
                upper.children[child.label[0]] = child
                self.bytes += NODE_BYTES
                child = upper
            node, i = child, i + n
        if node.owner is None:
            node.owner = [rank, rows]
        else:
            node.owner = [min(node.owner[0], rank), node.owner[1] + rows]

    def items(self) -> Iterator[tuple[bytes, tuple, int]]:
        """Every string with its owner's rank and row count."""
        return strings_below(self.root, b"")

    def spill(self, most: int) -> Iterator[tuple[bytes, tuple, int]]:
        """Cuts off subtrees, the largest first, until the trie holds no more than `most` bytes (or its root alone), and gives their strings. A subtree far larger than the excess is opened instead."""
        size, order, stack = {}, [], [self.root]
        while stack:
            order.append(stack.pop())
            stack += order[-1].children.values()
        for node in reversed(order):
            size[node] = NODE_BYTES + len(node.label) + sum(size[c] for c in node.children.values())
        nth, heap = 0, []

        def offer(parent: Node, above: bytes) -> None:
            nonlocal nth
            for child in parent.children.values():
                nth += 1
                heapq.heappush(heap, (-size[child], nth, child, parent, above))

        offer(self.root, b"")
        while self.bytes > most and heap:
            _, _, node, parent, above = heapq.heappop(heap)
            if node.children and size[node] > 2 * (self.bytes - most):
                offer(node, above + node.label)
                continue
            del parent.children[node.label[0]]
            self.bytes -= size[node]
            yield from strings_below(node, above)


def strings_below(node: Node, above: bytes) -> Iterator[tuple[bytes, tuple, int]]:
    """An explicit stack, as tries may be deep."""
    stack = [(node, above)]
    while stack:
        node, above = stack.pop()
        key = above + node.label
        if node.owner is not None:
            yield key, *node.owner
        stack += ((c, key) for c in node.children.values())


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, SPACE_BYTES)


def rank_of(text: str | None, doc_id: int | None) -> tuple:
    """Orders rows of one text: most code points first, then the smallest id, rows without an id last."""
    return (-len(text or ""), doc_id is None, doc_id or 0)


DIGESTS = pa.schema([("doc_id", pa.int64()), ("text_sha256", pa.string()), ("n_points", pa.int64())])
PARTIALS = pa.schema([("length", pa.int64()), ("hash", pa.int64()), ("body", pa.binary()), ("n_points", pa.int64()), ("owner", pa.int64()), ("rows", pa.int64())])
OWNERS = pa.schema([("text_sha256", pa.string()), ("keep_id", pa.int64()), ("keep_points", pa.int64()), ("group_size", pa.int64())])


def content_hash(body: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little", signed=True)


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).to_pylist()
        yield pa.record_batch([b.column(0), pa.array([hashlib.sha256(normalised(t)).hexdigest() for t in texts]), pa.array([len(t or "") for t in texts], pa.int64())], schema=DIGESTS)


def batched(rows: Iterator[tuple], schema: pa.Schema, body: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of at most 4,096 rows and about 8 MB of the column `body`."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[body]) if body is not None else 0
        if len(held) == 4096 or size > 8 << 20:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def partials(strings: Iterator[tuple[bytes, tuple, int]]) -> Iterator[pa.RecordBatch]:
    return batched(((len(body), content_hash(body), body, -rank[0], None if rank[1] else rank[2], n) for body, rank, n in strings), PARTIALS, 2)


def fold_rows(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Patricia()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                trie.insert(normalised(text), rank_of(text, doc_id))
                if trie.bytes > budget:
                    yield from partials(trie.spill(budget // 2))
        yield from partials(trie.items())

    return run


def own(budget: int):
    """Folds partials sorted by (length, hash) into one row for each distinct string."""

    def given(trie: Patricia) -> Iterator[pa.RecordBatch]:
        return batched(((hashlib.sha256(body).hexdigest(), None if rank[1] else rank[2], -rank[0], n) for body, rank, n in trie.items()), OWNERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, trie = None, Patricia()
        for b in batches:
            for length, h, body, points, owner, n in zip(*(c.to_pylist() for c in b.columns)):
                if (length, h) != key and trie.bytes > budget:
                    yield from given(trie)
                    trie = Patricia()
                key = (length, h)
                trie.insert(body, (-points, owner is None, owner or 0), n)
        yield from given(trie)

    return run


def owners(docs: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row for each distinct text: text_sha256, keep_id, keep_points, group_size."""
    found = docs.select("doc_id", "text").mapInArrow(lean(fold_rows(trie_bytes)), "length long, hash long, body binary, n_points long, owner long, rows long")
    dealt = found.repartition("length", "hash").sortWithinPartitions("length", "hash")
    return dealt.mapInArrow(lean(own(trie_bytes)), "text_sha256 string, keep_id long, keep_points long, group_size long")


def exact_dedup(docs: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with most code points stays, then the smallest doc_id. Null and
    empty texts are equal to each other. Rows without an id come last; one stays only if no
    row of its text has an id (keep_id is then null). Rows that repeat the survivor's id and
    length are the survivor, once more: each is marked kept. Texts of any length are compared
    whole. Other columns are not read. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text").mapInArrow(lean(digests), "doc_id long, text_sha256 string, n_points long")
    return rows.join(owners(docs, trie_bytes), "text_sha256").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points"))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs with all its columns, without the rows that exact_dedup drops and without repeats of a survivor's row."""
    own, of, sha, points, nth = (spare(n, docs) for n in ("_id", "_of", "_sha", "_points", "_nth"))
    kept = exact_dedup(docs).filter("kept").select(F.col("doc_id").alias(own), F.col("text_sha256").alias(of))
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumns({sha: F.sha2(F.translate(text, SPACE_BYTES.decode(), ""), 256), points: F.length(text)})
    stays = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col(own)) & (F.col(sha) == F.col(of)), "left_semi")
    longest = Window.partitionBy("doc_id", sha).orderBy(F.desc(points))
    return stays.withColumn(nth, F.row_number().over(longest)).filter(F.col(nth) == 1).select(*docs.columns)
