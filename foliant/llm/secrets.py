"""Secret scanning: fixed patterns, and a token-efficiency test for random strings.

A byte-pair vocabulary learnt from natural text spends few tokens on words and many on random
strings. A run of key characters with a letter and few characters for each token is reported,
unless it is a known digest or identifier (hex digests of the usual lengths, UUIDs, versions
and dates). A run that isn't random as a whole, such as a path, is tested by stretches of
segments between its separators. What a pattern has found is cut out of its run first.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: In the order that equal starts are listed.
KINDS = ("assign", "access", "hex", "random")
PATTERNS = {
    "assign": (re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 1, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]{16,}"), 0, 16),  # runs are maximal, so shorter ones need no match
}
#: Characters for each token below which a run counts as random; the least length of a run.
RATIO, LEAST = 2.2, 20
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
LETTERS, SEPARATORS = re.compile(r"[A-Za-z]"), "+/_=-"
#: Known digests (by length in hex) and identifiers.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
HEX = re.compile(r"[0-9A-Fa-f]+")
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
VERSION = re.compile(r"[vV]?[0-9]{1,4}([-_/+=][0-9]{1,4})+([-_+](a|alpha|b|beta|dev|post|pre|rc)[-_]?[0-9]{0,4})?")
STAMP = r"[0-9]{4}[-_/]?[0-9]{2}[-_/]?[0-9]{2}([T_-][0-9]{2}([-_]?[0-9]{2}){1,2}Z?([-+][0-9]{4})?)?"
DATE = re.compile(rf"{STAMP}([-_/+]{STAMP})?")
#: A UUID is one segment.
SEGMENT = re.compile(rf"{UUID.pattern}(?![0-9A-Za-z])|[0-9A-Za-z]+")


def identifier(run: str) -> bool:
    return bool(len(run) in DIGEST_LENGTHS and HEX.fullmatch(run) or UUID.fullmatch(run) or VERSION.fullmatch(run) or DATE.fullmatch(run))


def tokeniser(path: str):
    """A tiktoken encoding of a rank file."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def stretches(scores: list[float]) -> list[tuple[int, int]]:
    """All maximal-scoring stretches (first, last) in one pass (Ruzzo and Tompa)."""
    held: list[tuple[int, int, float, float]] = []  # first, last, sum before, sum with
    total = 0.0
    for i, x in enumerate(scores):
        before, total = total, total + x
        if x <= 0:
            continue
        new = (i, i, before, total)
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= new[2]:
                j -= 1
            if j < 0 or held[j][3] >= new[3]:
                break
            new = (held[j][0], i, held[j][2], total)
            del held[j:]
        held.append(new)
    return [h[:2] for h in held]


def random_spans(text: str, start: int, end: int, tokens, ratio: float) -> list[tuple[int, int]]:
    """The span itself if it is random, else the stretches of its segments that are."""
    count = lambda a, b: len(tokens.encode_ordinary(text[a:b]))
    dense = lambda a, b: b - a >= LEAST and LETTERS.search(text, a, b) and not identifier(text[a:b]) and b - a < ratio * count(a, b)
    if end - start < LEAST or identifier(text[start:end]):
        return []
    if dense(start, end):
        return [(start, end)]
    parts = [m.span() for m in SEGMENT.finditer(text, start, end)]
    known = [len(text[a:b]) >= LEAST and identifier(text[a:b]) for a, b in parts]
    scores = [-float(end - start) * ratio if k else ratio * count(a, b) - (b - a) for (a, b), k in zip(parts, known)]
    return [(parts[i][0], parts[j][1]) for i, j in stretches(scores) if dense(parts[i][0], parts[j][1])]


def find_secrets(text: str | None, tokens, ratio: float = RATIO) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) in code points, end exclusive, in order of start, then kind as listed."""
    if not text:
        return []
    found = [(m.start(), m.end(), kind) for kind, (pattern, group, least) in PATTERNS.items() for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    covered, i, reach = sorted(f[:2] for f in found), 0, 0
    for m in RUN.finditer(text):
        at, pieces = max(m.start(), reach), []
        while i < len(covered) and covered[i][0] < m.end():
            if covered[i][0] > at:
                pieces.append((at, covered[i][0]))
            reach = max(reach, covered[i][1])
            at = max(at, reach)
            i += 1
        if at < m.end():
            pieces.append((at, m.end()))
        for a, b in pieces:
            if (a, b) != m.span():
                a, b = b - len(text[a:b].lstrip(SEPARATORS)), a + len(text[a:b].rstrip(SEPARATORS))
            found += [(*span, "random") for span in random_spans(text, a, b, tokens, ratio)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


SPANS = "doc_id long, spans array<struct<start: int, end: int, kind: string>>"


def scan(path: str, ratio: float):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokeniser(path)
        for b in batches:
            for i in range(0, len(b), 1024):
                some = b.slice(i, 1024)
                spans = [[{"start": x, "end": y, "kind": k} for x, y, k in find_secrets(t, tokens, ratio)] for t in some.column(1).to_pylist()]
                yield pa.record_batch([some.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    return run


def scan_secrets(docs: DataFrame, vocabulary: str, ratio: float = RATIO) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, spans array<struct<start, end, kind>>.

    Null and empty texts have no spans. Whole texts are scanned, of any length. Rows that
    repeat give their result each; other columns are not read; an empty table gives an empty
    result. vocabulary: path of a tiktoken rank file on the executors.
    """
    return docs.select("doc_id", "text").mapInArrow(scan(vocabulary, ratio), SPANS)
