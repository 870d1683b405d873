"""Exact and near deduplication against brute force, and their defined cases."""

import hashlib
import random
import re
from collections import defaultdict

from hypothesis import given
from hypothesis import strategies as st

from foliant.llm import exact_dedup, near_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, length string"


@given(st.lists(st.binary(max_size=6), max_size=60))
def test_trie_holds_the_least_owner(keys):
    trie, want = exact_dedup.Patricia(), {}
    for i, k in enumerate(keys):
        trie.insert(k, (0, False, -i))
        rank, n = want.get(k, ((0, False, -i), 0))
        want[k] = (min(rank, (0, False, -i)), n + 1)
    assert {k: (r, n) for k, r, n in trie.items()} == want


def nodes_of(trie):
    stack, n = [trie.root], 0
    while stack:
        n += 1
        stack += stack.pop().children.values()
    return n


def test_trie_shares_prefixes():
    trie, stem = exact_dedup.Patricia(), b"s" * 1000
    for i in range(100):
        trie.insert(stem + bytes([i // 10, i % 10]), (0, False, i))
    assert nodes_of(trie) == 1 + 1 + 10 + 100  # the root, the stem, tens, units
    assert trie.bytes == nodes_of(trie) * exact_dedup.NODE_BYTES + 1000 + 10 + 100


@given(st.lists(st.text("ab", max_size=12).map(str.encode), max_size=80), st.integers(0, 12000))
def test_spilt_subtrees_and_the_rest_are_the_whole(keys, most):
    trie = exact_dedup.Patricia()
    for i, k in enumerate(keys):
        trie.insert(k, (0, False, i))
    want = sorted(trie.items())
    spilt = list(trie.spill(most))
    assert sorted([*spilt, *trie.items()]) == want
    assert trie.bytes <= max(most, exact_dedup.NODE_BYTES)
    assert trie.bytes == nodes_of(trie) * exact_dedup.NODE_BYTES + sum_of_labels(trie)
    for k in keys:  # what is left still takes strings
        trie.insert(k, (0, False, -1))
    assert {k for k, _, _ in trie.items()} == set(keys)


def sum_of_labels(trie):
    stack, n = [trie.root], 0
    while stack:
        node = stack.pop()
        n += len(node.label)
        stack += node.children.values()
    return n


def test_spill_takes_whole_subtrees():
    trie = exact_dedup.Patricia()
    for head, rows in ((b"a", 50), (b"b", 5), (b"c", 5)):
        for i in range(rows):
            trie.insert(head + bytes([i]) * 20, (0, False, i))
    spilt = {k for k, _, _ in trie.spill(trie.bytes // 2)}
    assert spilt == {b"a" + bytes([i]) * 20 for i in range(50)}


CASES = [(5, "a b", "x"), (3, "ab", "x"), (4, "a  b", "x"), (9, None, "x"), (8, "", "x"), (7, " \n", "x"), (2, "ab ", "x"), (2, "ab ", "x"), (None, "zz", "x"), (11, "zz", "x"), (None, "q", "x"), (12, "é ß" * 40000, "x"), (13, "é ß" * 40000 + "!", "x")]


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0))
    out = []
    for i, t, _ in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best = min(groups[key])
        keep = None if best[1] else best[2]
        out.append((i, keep, len(groups[key]), i == keep and -best[0] == len(t or ""), hashlib.sha256(key.encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_dedup_equals_brute_force(spark):
    docs = spark.createDataFrame(CASES, DOCS).repartition(3)
    for budget in (exact_dedup.TRIE_BYTES, 500):  # the second one spills all the time
        rows = exact_dedup.exact_dedup(docs, budget).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows), key=str) == brute_exact(CASES)
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0
    kept = exact_dedup.drop_copies(docs).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["11", "12", "13", "4", "7", "None"]


def shingles(text):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_near(rows):
    sets = [(i, shingles(t)) for i, t, _ in rows]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, x in sets:
        for b, y in sets:
            if a < b and x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets)


def corpus(seed, groups, copies):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    passage = rng.choices(words, k=60)
    rows = []
    for g in range(groups):
        base = rng.choices(words, k=rng.choice([3, 5, 12, 80, 150, 400]))
        if g % 3 == 0:
            base = passage + base
        for _ in range(copies if g % 5 == 0 else rng.randrange(1, 4)):
            text = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 25) + 1)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows) + 1, " ".join(text), "x"))
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = [*corpus(1, 40, 30), (9001, None, "x"), (9002, "", "x"), (9003, "One two", "x"), (9004, "one TWO", "x")]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    want = brute_near(rows)
    for short, block in ((24, 512), (4, 8), (1000, 512)):  # the short lists' way, the blocks' way and both give the same
        got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, short_list=short, block=block).collect())
        assert got == want, (short, block)
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, bloom_ids=0).collect())
    assert got == want  # texts picked by a semi-join


def test_large_groups_of_copies_take_few_comparisons(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(5000)]
    one, two = rng.choices(words, k=60), rng.choices(words, k=60)
    rows = []
    for i in range(600):  # two groups that share no list, and one text between that links to neither
        text = list(one if i % 3 else two)
        text[rng.randrange(60)] = rng.choice(words)
        rows.append((i, " ".join(text), "x"))
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    taken = []
    compared = near_dedup.compared

    def counting(pairs, *rest):
        taken.append(pairs.count())
        return compared(pairs, *rest)

    near_dedup.compared = counting
    try:
        got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, block=16).collect())
    finally:
        near_dedup.compared = compared
    assert got == brute_near(rows)
    assert sum(taken) < 400  # all pairs of blocks: some 38 * 39 / 2 = 741


def test_filter_holds_all_wanted_and_few_others(spark):
    docs = spark.range(20000).selectExpr("id AS doc_id", "concat('word', id) AS text")
    wanted = spark.range(0, 20000, 10).selectExpr("id AS node")
    got = {r.node for r in near_dedup.sets_of(docs, wanted, 5).select("node").collect()}
    assert got >= set(range(0, 20000, 10)) and len(got) < 2000 + 0.03 * 18000
    assert near_dedup.sets_of(docs, wanted.limit(0), 5).count() == 0


def test_near_duplicates_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (None, "a b c d e f", "x"), (3, "A B C D E F", "x")], DOCS)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, None, True), (3, 2, 1, False)], key=str)
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0
