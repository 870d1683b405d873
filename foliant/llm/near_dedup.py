"""Near-duplicate classes from bottom-k sketches of one hash function.

1. A document's set holds the 64-bit hashes of its distinct word shingles; its sketch, the K
   least. Documents with the same set form a class, of which one goes on.
2. Inverted lists. If two sets have similarity t, each of the K least hashes of their union
   lies in both sketches with probability t; fewer than c of them do in about one of 10**9
   linked pairs (binomial tail; for sets that fit the sketch, c is exact and none is lost).
   So linked sketches share at least c values, and of a sketch of k values in any fixed order
   the first k - c + 1 hold a shared one. In the order of rising frequency these are mostly
   values of one class; common passages come last and make no list.
3. Short lists give their pairs, each in the first list that both are in.
4. Members of long lists are dealt into blocks of bounded size, near members together. Each
   block is compared with itself and with the first block of each of its lists, which leaves
   a spanning forest of the links found. So N near copies are one component after about
   N / BLOCK comparisons. Members are then dealt anew, by component, and of the pairs of blocks
   that share a list only those that hold two components are compared, for links between these.
5. Candidates pass the union-sketch estimate, then exact Jaccard on full sets decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lean, mix64, small_batches, spare
from .graph import Forest, components

#: Words of a shingle, per cent of similarity, values of a sketch.
WORDS, PERCENT, K = 5, 75, 64
#: Members of a list that still gives single pairs; members of a block.
SHORT_LIST, BLOCK = 24, 512
#: Wanted ids that a Bloom filter is still made for: four to a word of 64 bits, so at most 32 MiB.
BLOOM_IDS = 1 << 24
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def least_shared(k: int = K, percent: int = PERCENT, loss: float = 1e-8) -> int:
    """The largest c so that of k independent trials at this percentage fewer than c succeed with a probability below loss."""
    from math import comb

    t, tail, c = percent / 100, 0.0, 0
    while (tail := tail + comb(k, c) * t**c * (1 - t) ** (k - c)) < loss:
        c += 1
    return c


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes (signed). A text of fewer words is one shingle; without words it has none."""
    tokens = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    ends = np.asarray(tokens.offsets).astype(np.int64)
    flat = tokens.flatten().dictionary_encode()
    names = flat.dictionary.to_pylist()
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in names), np.uint64, len(names))
    codes = np.asarray(flat.indices)
    full = np.fromiter((w != "" for w in names), bool, len(names))[codes]  # the splitter leaves empty words at the ends
    kept = np.concatenate([[0], np.cumsum(full)])
    ends = kept[ends - ends[0]]
    h = hashed[codes[full]]
    n = max(0, len(h) - words + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(words):
        rolled += h[j : j + n] * MULTIPLIERS[j]
    rolled = mix64(rolled).view(np.int64)
    for a, b in zip(ends[:-1], ends[1:]):
        if b - a >= words:
            s = np.sort(rolled[a : b - words + 1])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif b > a:
            yield np.array([xxhash.xxh3_64_intdigest(h[a:b].tobytes())], np.uint64).view(np.int64)
        else:
            yield np.zeros(0, np.int64)


def lists_of(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def sketched(words: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 1024):
                b = batch.slice(i, 1024)
                sets = list(shingle_sets(b.column(1), words))
                classes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.record_batch([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(classes, pa.binary()), lists_of([s[:k] for s in sets])], names=["doc_id", "n_shingles", "class", "sketch"])

    return run


def full_sets(words: int, filled=None):
    """node, set of the rows; the columns are id, text and, with a Bloom filter, its word and mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if filled is not None:
                mask = batch.column(3).to_numpy()
                batch = batch.filter(pa.array(filled.value[batch.column(2).to_numpy()] & mask == mask))
            for i in range(0, len(batch), 1024):
                b = batch.slice(i, 1024)
                yield pa.record_batch([b.column(0), lists_of(list(shingle_sets(b.column(1), words)))], names=["node", "set"])

    return run


def overlaps(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """The sizes of all intersections, as products of 0/1 matrices over the values that occur twice, in slices of bounded width."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[code]
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [at, at + width])
        x = np.zeros((len(sets), width), np.float32)
        x[row[a:b], column[a:b] - at] = 1
        out += x @ x.T
    return out


def block_links(k: int, percent: int, c: int):
    """Of one pair of blocks (or one block, with itself): a spanning forest of its links."""

    def run(table: pa.Table) -> pa.Table:
        node, side = table["node"].to_numpy(), table["own"].to_numpy()
        sets = [np.asarray(s.values) for s in table["set"].combine_chunks()]
        n = np.array([len(s) for s in sets])
        need = np.where(4 * n <= 3 * k, (percent * n + 99) // 100, c)
        likely = overlaps([s[:k] for s in sets]) >= np.maximum(need[:, None], need[None, :])
        likely &= 100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])
        two = table["b1"][0].as_py() != table["b2"][0].as_py()
        likely &= (side[:, None] != side[None, :]) if two else True
        part = table["part"].to_numpy()
        likely &= part[:, None] != part[None, :]
        np.fill_diagonal(likely, False)
        some = np.flatnonzero(likely.any(axis=1))
        forest, found = Forest(), []
        if len(some):
            both = overlaps([sets[i] for i in some])
            m = n[some]
            linked = likely[np.ix_(some, some)] & (100 * both >= percent * (m[:, None] + m[None, :] - both))
            for i, j in np.argwhere(np.triu(linked)):
                x, y = int(node[some[i]]), int(node[some[j]])
                if forest.join(x, y):
                    found.append((x, y))
        return pa.table([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def linked(a: Column, b: Column, percent: int) -> Column:
    both = F.size(F.array_intersect(a, b))
    return 100 * both >= percent * (F.size(a) + F.size(b) - both)


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, k: int = K, short_list: int = SHORT_LIST, block: int = BLOCK, bloom_ids: int = BLOOM_IDS) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Null texts and texts without words have no shingles and are linked with nothing. Rows that
    share a doc_id are one document that has the links of each of them. Rows without an id
    are linked with nothing and kept, with a null component_id. Texts of any length are read
    whole. Other columns are not read. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    c = least_shared(k, percent)
    sketches = cut(docs.select("doc_id", "text").mapInArrow(lean(sketched(words, k)), "doc_id long, n_shingles long, class binary, sketch array<long>"))
    classes = sketches.filter("doc_id IS NOT NULL AND n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    lists = cut(prefix_lists(classes, k, percent, c))
    short = cut(short_pairs(lists.filter(f"members <= {short_list}"), percent))
    long = cut(blocks(lists.filter(f"members > {short_list}"), block))
    wanted = cut(short.select(F.col("a").alias("node")).union(short.select("b")).union(long.select("node")).distinct())
    sets = cut(sets_of(docs, wanted, words, bloom_ids))
    alone = long.withColumn("part", F.col("node"))
    links = cut(verified(short, sets, k, percent, c).union(compared(star_pairs(long), alone, sets, k, percent, c)))
    labels = components(links)
    members = cut(dealt(long.drop("block").join(labels.withColumnRenamed("component", "part"), "node", "left").withColumn("part", F.coalesce("part", "node")), "part", block))
    pairs = cut(open_pairs(members))
    if not pairs.isEmpty():
        labels = components(links.union(compared(pairs, members, sets, k, percent, c)))
    named = classes.select("class", "node").join(labels, "node", "left").select("class", F.coalesce("component", "node").alias("_component"))
    return sketches.join(named, "class", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id")).alias("component_id"),
        (F.col("doc_id").isNull() | (F.coalesce("_component", "doc_id") == F.col("doc_id"))).alias("kept"),
    )


def sets_of(docs: DataFrame, wanted: DataFrame, words: int, most: int = BLOOM_IDS) -> DataFrame:
    """node, set of the wanted documents, and of about 1 in 100 others; the joins that follow pass over these.

    A Bloom filter in proportion to the wanted ids goes to all tasks, so that texts are read
    where they are. Of more ids than `most` a semi-join picks the texts, which shuffles them once.
    """
    rows, n = docs.filter("doc_id IS NOT NULL").select("doc_id", "text"), wanted.count()
    if n > most:
        return rows.join(wanted, rows["doc_id"] == wanted["node"], "left_semi").mapInArrow(lean(full_sets(words)), "node long, set array<long>")
    slots = max(1, n // 4)

    def place(c: str) -> list[Column]:
        h = F.xxhash64(c, F.lit(1))
        bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, k).bitwiseAND(F.lit(63)).cast("int")) for k in (0, 6, 12)]
        return [F.pmod(F.xxhash64(c), F.lit(slots)).alias("slot"), bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).alias("mask")]

    filled = np.zeros(slots, np.int64)
    got = wanted.select(*place("node")).groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()  # most / 4 rows at most
    filled[got["slot"].to_numpy()] = got["mask"].to_numpy()
    held = docs.sparkSession.sparkContext.broadcast(filled)
    return rows.select("doc_id", "text", *place("doc_id")).mapInArrow(lean(full_sets(words, held)), "node long, set array<long>")


def prefix_lists(classes: DataFrame, k: int, percent: int, c: int) -> DataFrame:
    """value, node, n, before (the node's prefix values ahead of this one), members (length of the value's list)."""
    values = classes.select("node", "n", F.explode("sketch").alias("value"))
    frequent = values.groupBy("value").agg(F.count("*").alias("f")).filter("f > 1")
    mine = values.join(frequent, "value").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("f", "value"))).alias("s"))
    kept = F.least(F.col("n"), F.lit(k))
    need = F.when(4 * F.col("n") <= 3 * k, F.ceil(F.col("n") * percent / 100)).otherwise(F.lit(c))
    alone = kept - F.size("s")
    prefix = F.expr("transform(slice(s, 1, cast(greatest(take, 0) as int)), x -> x.value)")
    rows = mine.withColumn("take", kept - need + 1 - alone).select("node", "n", prefix.alias("p"))
    rows = rows.select("node", "n", "p", F.posexplode("p").alias("at", "value")).select("value", "node", "n", F.expr("slice(p, 1, at)").alias("before"))
    sizes = rows.groupBy("value").agg(F.count("*").alias("members")).filter("members > 1")
    return rows.join(sizes, "value")


def short_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """The pairs of each list that are in no list before it in the order of the two."""
    members = lists.groupBy("value").agg(F.collect_list(F.struct("node", "n", "before")).alias("l"))
    rows = members.select("l", F.explode("l").alias("x"))
    fits = lambda x, y: (y["node"] > x["node"]) & (100 * F.least(x["n"], y["n"]) >= percent * F.greatest(x["n"], y["n"])) & ~F.arrays_overlap(x["before"], y["before"])
    partners = F.transform(F.filter("l", lambda y: fits(F.col("x"), y)), lambda y: y["node"])
    return rows.select(F.col("x.node").alias("a"), F.explode(partners).alias("b"))


def blocks(lists: DataFrame, block: int) -> DataFrame:
    """node, group, block, values: members of long lists, in blocks of about this size. A group is a connected part of the lists; in it, nodes with the same least value are neighbours."""
    nodes = lists.groupBy("node").agg(F.array_sort(F.collect_set("value")).alias("values"))
    nodes = nodes.withColumn("least", F.col("values")[0])
    groups = components(nodes.select("least", F.explode("values").alias("value")).distinct())
    nodes = nodes.join(groups.withColumnRenamed("node", "least"), "least", "left").withColumn("group", F.coalesce("component", "least"))
    return dealt(nodes, "least", block).select("node", "group", "block", "values")


def dealt(nodes: DataFrame, by: str, block: int) -> DataFrame:
    """Adds block: nodes of a group in the order of `by`, in blocks of about this size."""
    sizes = nodes.groupBy("group", by).agg(F.count("*").alias("size"))
    before = Window.partitionBy("group").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("ahead", F.coalesce(F.sum("size").over(before), F.lit(0)))
    return nodes.join(sizes, ["group", by]).withColumn("block", F.expr(f"cast((ahead + pmod(xxhash64(node), size)) div {block} as bigint)")).drop("size", "ahead")


def star_pairs(nodes: DataFrame) -> DataFrame:
    """group, b1, b2: each block with itself and with the first block of each of its lists."""
    held = nodes.select("group", "block", F.explode("values").alias("value")).distinct()
    first = held.groupBy("group", "value").agg(F.min("block").alias("b1"))
    own = held.select("group", F.col("block").alias("b1"), F.col("block").alias("b2"))
    return held.join(first, ["group", "value"]).select("group", "b1", F.col("block").alias("b2")).union(own).distinct()


def open_pairs(nodes: DataFrame) -> DataFrame:
    """group, b1, b2: the pairs of blocks that share a list and hold nodes of more than one part."""
    ends = nodes.groupBy("group", "block").agg(F.min("part").alias("lo"), F.max("part").alias("hi"))
    held = nodes.select("group", "block", F.explode("values").alias("value")).distinct().join(ends, ["group", "block"])
    other = held.select("group", "value", F.col("block").alias("b2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    differ = (F.least("lo", "lo2") != F.greatest("hi", "hi2")) & (F.col("block") <= F.col("b2"))
    one = held.groupBy("group", "value").agg(F.min("lo").alias("l"), F.max("hi").alias("h")).filter("l <> h").select("group", "value")  # lists within one part have no open pairs
    held, other = held.join(one, ["group", "value"], "left_semi"), other.join(one, ["group", "value"], "left_semi")
    return held.join(other, ["group", "value"]).filter(differ).select("group", F.col("block").alias("b1"), "b2").distinct()


def compared(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, k: int, percent: int, c: int) -> DataFrame:
    """Links between nodes of different parts in these pairs of blocks."""
    sides = pairs.select("group", "b1", "b2", F.explode(F.array_distinct(F.array("b1", "b2"))).alias("own"))
    rows = sides.join(nodes.select("node", "part", "group", F.col("block").alias("own")), ["group", "own"]).join(sets, "node")
    return rows.groupBy("group", "b1", "b2").applyInArrow(block_links(k, percent, c), "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, k: int, percent: int, c: int) -> DataFrame:
    """The pairs whose union sketch allows a link and whose full sets have one."""
    sketch = sets.select("node", F.slice("set", 1, k).alias("s"), F.size("set").alias("n"))
    both = pairs.join(sketch.select(F.col("node").alias("a"), F.col("s").alias("sa"), F.col("n").alias("na")), "a").join(sketch.select(F.col("node").alias("b"), F.col("s").alias("sb"), F.col("n").alias("nb")), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    common = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    small = (F.col("na") <= k) & (F.col("nb") <= k) & (F.size(F.array_union("sa", "sb")) <= k)
    likely = both.filter(F.when(small, 100 * common >= percent * F.size(union)).otherwise(common >= c)).select("a", "b")
    full = likely.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    return full.filter(linked(F.col("x"), F.col("y"), percent)).select("a", "b")


def drop_near(docs: DataFrame, **options) -> DataFrame:
    """docs with all its columns, one row of each class of near-duplicates: that with the smallest doc_id.

    Rows that share an id are one document: all of them stay if it does. Rows without an id are
    linked with nothing and stay.
    """
    own = spare("_id", docs)
    kept = near_duplicates(docs, **options).filter("kept").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(own)), "left_semi")
