"""Packing against the tokenizer itself and against one-by-one best fit decreasing."""

import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import packing
from foliant.llm.queries import tokenizer_path


def one_by_one(lengths: list[int], capacity: int) -> int:
    bins: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(bins) if room >= n]
        if fits:
            best = min(fits, key=lambda i: bins[i])
            bins[best] -= n
        else:
            bins.append(capacity - n)
    return len(bins)


def laid_out(plan, capacity):
    """Sequence -> its (offset, length), from the plan."""
    held: dict[int, list] = {}
    for length, rows in plan.items():
        for _, pieces, first, offset in rows:
            for i in range(pieces):
                held.setdefault(first + i, []).append((offset, length))
    return held


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(40, 64))
def test_plan_is_best_fit_decreasing(lengths, capacity):
    held = laid_out(packing.best_fit_decreasing(Counter(lengths), capacity), capacity)
    assert sum(map(len, held.values())) == len(lengths)
    assert len(held) == one_by_one(lengths, capacity)
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity


def test_ids_equal_the_tokenizers():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    whole.encode_special_tokens = True
    texts = ["", " \t", "It's the THEY'RE 12345 émile ÉCOLE naïve ñandú!!! a%%%b $9.99 (x)", "ﬁ Å é ẞ İstanbul ΑΣ 日本語 😀👍🏽", "<|endoftext|> a<|startoftext|>b", "µ ß ÿ × ÷ x\x1cy z", "word" * 500, "don't-stop: under_score can't", "# ### *** &&& %%%."]
    cache = packing.WordCache(tokenizer_path(), words=4)
    for text, ids in zip(texts, cache.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_pieces_are_gapless_and_whole(spark):
    docs = spark.createDataFrame([(1, "a b c", 5), (2, None, 6), (3, "", 7), (3, "", 7), (None, "x", 8), (4, "ha " * 5000, 9), (5, "the and " * 700, 1)], "doc_id long, text string, length int")
    rows = packing.pack(docs, tokenizer_path()).collect()
    by_seq: dict = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(r.length for r in rows if r.doc_id in (2, 3)) == [1, 1, 1]
    assert {r.ids_crc32 for r in rows if r.doc_id in (2, 3)} == {zlib.crc32(b"\0\0\0\0")}
    four = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == 4)
    assert four == [(0, 0, 2048), (1, 2048, 2048), (2, 4096, 905)]
    assert packing.pack(docs.limit(0), tokenizer_path()).count() == 0


@pytest.fixture(scope="module")
def spark():
    from tests.session import session

    return session()
