"""Quality classifier by co-training of two views of a document.

The text view has the words (without punctuation at their ends), their stems, stems of two or
more words and the punctuation at their ends; the metadata view has language, source and figures of the page's shape. Each view's
logistic regression is trained on a bounded sample of labelled rows. Then, for some rounds, each
view scores every unlabelled document of the corpus, and those that it is most sure of are
labelled for the other view. On held-back labelled rows the views' scores are calibrated and
combined; the threshold is the one of least cost, a refused good row counting ten times a
missed bad one.
There are two verdicts, low quality and toxicity; a document is kept if neither holds.
Texts are read once to choose words, once for the features (the chosen words that a document
has, and its figures), which go to a table; rounds and scores read that table.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lean, small_batches

#: Labelled rows of the sample; words that the text view of a verdict may weigh; rounds of exchange, and rows that a view gives for each side and round.
LABELLED, FEATURES, ROUNDS, EXCHANGED = 6000, 3000, 3, 150
#: Least log-odds of a word, in units of their error; least log-odds of a row that a view is sure of.
LEAST_Z, SURE = 3.0, 4.0
#: How many missed bad rows weigh as much as one refused good row, each as a share of its class.
REFUSAL_COST = 10
HEADS = ("quality", "toxic")
VIEWS = ("text", "meta")
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
TAIL = rf"(?P<tail>[{re.escape(MARKS)}]+)$"
STEM = 5
#: The kind of feature after those of parts_of: a stem that two different words of a document have.
TWICE = 3
BUCKETS = 32  # of hashed languages and sources
SHAPE = 14
SLICE = 128
#: Byte -> 0 other, 1 blank, 2 digit, 3 upper, 4 lower, 5 beyond ASCII, 6 bar, 7 cry or question, 8 comma or stop, 9 other marks.
CLASS = np.zeros(256, np.uint8)
for first, last, kind in ((9, 14, 1), (32, 33, 1), (33, 48, 9), (48, 58, 2), (58, 65, 9), (65, 91, 3), (91, 97, 9), (97, 123, 4), (123, 127, 9), (128, 256, 5), (124, 125, 6), (33, 34, 7), (63, 64, 7), (44, 45, 8), (46, 47, 8)):
    CLASS[first:last] = kind


def parts_of(words: pa.Array) -> list[pa.Array]:
    """For each word its features: the word without the marks at its ends, the marks at its end, and its stem, a long word's first letters; null where it has none."""
    bare = pc.utf8_trim(words, MARKS)
    bare = pc.if_else(pc.equal(bare, ""), None, bare)
    marked = pc.not_equal(pc.binary_length(pc.utf8_rtrim(words, MARKS)), pc.binary_length(words))
    ends = pc.struct_field(pc.extract_regex(words.filter(marked), TAIL), 0)
    stem = pc.utf8_slice_codeunits(bare, 0, STEM)
    return [bare, pc.replace_with_mask(pa.nulls(len(words), pa.string()), marked, ends), pc.if_else(pc.equal(pc.utf8_length(stem), STEM), stem, None)]


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Document and code of each document's distinct words; the words by code; the share of distinct words of each document."""
    tokens = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = tokens.flatten().dictionary_encode()
    n, width = len(texts), max(1, len(flat.dictionary))
    doc = np.repeat(np.arange(n), np.diff(np.asarray(tokens.offsets)))
    pairs = doc * width + np.asarray(flat.indices)
    if n * width <= 1 << 22:
        seen = np.zeros(n * width, bool)
        seen[pairs] = True
        pairs = np.flatnonzero(seen)
    else:
        pairs = np.unique(pairs)
    of, code = np.divmod(pairs, width)
    return of, code, flat.dictionary, np.bincount(of, minlength=n) / np.maximum(1, np.bincount(doc, minlength=n))


def shape_of(text: str, distinct: float) -> list[float]:
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    _, blank, digit, upper, lower, high, bar, cry, stop, mark = (np.bincount(CLASS[np.frombuffer(raw, np.uint8)], minlength=10) / n).tolist()
    lines = text.split("\n")
    return [np.log1p(len(text)), np.log1p(len(lines)), np.log1p(n / len(lines)), len(set(lines)) / len(lines), distinct, blank, digit, upper, lower, high, bar + cry + stop + mark, bar, cry, stop]


def figures(texts: list, langs: list, sources: list, distinct: np.ndarray) -> np.ndarray:
    """The page's shape, and the buckets of its language and source."""
    out = np.zeros((len(texts), SHAPE + 2), np.float32)
    for i, (t, lang, source, d) in enumerate(zip(texts, langs, sources, distinct.tolist())):
        out[i, :SHAPE] = shape_of(t or "", d)
        out[i, SHAPE:] = xxhash.xxh3_64_intdigest(f"l{lang}".encode("utf-8", "surrogatepass")) % BUCKETS, xxhash.xxh3_64_intdigest(f"s{source}".encode("utf-8", "surrogatepass")) % BUCKETS
    return out


def metadata(rows: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The metadata view: scaled figures, then one column for each bucket."""
    out = np.zeros((len(rows), SHAPE + 2 * BUCKETS), np.float32)
    out[:, :SHAPE] = ((rows[:, :SHAPE] - mean) / scale).clip(-6, 6)
    at = np.arange(len(rows))
    out[at, SHAPE + rows[:, SHAPE].astype(int)] = 1
    out[at, SHAPE + BUCKETS + rows[:, SHAPE + 1].astype(int)] = 1
    return out


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Hits:
    """A sparse 0/1 matrix: the places of its ones."""

    row: np.ndarray
    column: np.ndarray
    shape: tuple[int, int]

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], self.shape[0])

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, g[self.row], self.shape[1])


@dataclass
class Dense:
    x: np.ndarray

    @property
    def shape(self):
        return self.x.shape

    def dot(self, w: np.ndarray) -> np.ndarray:
        return self.x @ w

    def back(self, g: np.ndarray) -> np.ndarray:
        return g @ self.x


def stacked(hits: list[np.ndarray], columns: np.ndarray, width: int) -> Hits:
    """columns: what column each feature has in this matrix, -1 for none."""
    row = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    column = columns[np.concatenate([*hits, np.zeros(0, np.int32)]).astype(np.int64)]
    return Hits(row[column >= 0], column[column >= 0], (len(hits), width))


def logistic(x, y: np.ndarray, decay: float = 1e-3, steps: int = 200, start: np.ndarray | None = None) -> np.ndarray:
    """Weights and a last one for the constant; balanced classes; Adam on the full sample."""
    n, width = x.shape
    w, m, v = (np.zeros(width + 1) for _ in range(3))
    if not n:
        return w
    if start is not None:
        w = start.copy()
    share = np.where(y > 0, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean())) / n
    for t in range(1, steps + 1):
        e = share * (sigmoid(log_odds(x, w)) - y)
        g = np.append(x.back(e), e.sum()) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def log_odds(x, w: np.ndarray) -> np.ndarray:
    return x.dot(w[:-1]) + w[-1]


@dataclass
class Head:
    """One verdict: weights of the text view by feature of the vocabulary, weights of the metadata view, weights of both calibrated scores, threshold on the joint log-odds."""

    text: np.ndarray
    meta: np.ndarray
    joint: np.ndarray | None = None
    threshold: float = -np.inf

    def views(self, hits: Hits, meta: np.ndarray) -> np.ndarray:
        return np.stack([log_odds(hits, self.text), log_odds(Dense(meta), self.meta)], axis=1)

    def together(self, z: np.ndarray) -> np.ndarray:
        return log_odds(Dense(z.clip(-8, 8) / 4), self.joint)


@dataclass
class Classifier:
    vocabulary: list[tuple[int, str]]  # kinds and names of features, in order
    mean: np.ndarray
    scale: np.ndarray
    heads: dict = field(default_factory=dict)


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, quality, toxic -> head, kind and name of a feature, rows of class 0, rows of class 1; each task sums its rows."""
    sums: dict = {}
    for b in batches:
        for i in range(0, len(b), SLICE):
            s = b.slice(i, SLICE)
            doc, code, words, _ = words_of(s.column(0))
            y = [np.array([-1 if c is None else c for c in s.column(1 + h).to_pylist()], np.int64) for h in range(len(HEADS))]
            parts = parts_of(words)
            for kind, names in enumerate([*parts, parts[2]]):
                coded = names.dictionary_encode()
                name, own = coded.dictionary.to_pylist(), np.asarray(pc.fill_null(coded.indices, -1))[code]
                once, often = np.unique(doc[own >= 0] * max(1, len(name)) + own[own >= 0], return_counts=True)
                of, own = np.divmod(once[often >= 1 + (kind == TWICE)], max(1, len(name)))
                for h, head in enumerate(HEADS):
                    for c in (0, 1):
                        n = np.bincount(own[y[h][of] == c], minlength=len(name))
                        for at in np.flatnonzero(n).tolist():
                            sums.setdefault((head, kind, name[at]), [0, 0])[c] += int(n[at])
    columns = [pa.array([k[i] for k in sums], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string()))]
    yield pa.record_batch([*columns, *(pa.array([n[c] for n in sums.values()], pa.int64()) for c in (0, 1))], names=["head", "kind", "name", "n0", "n1"])


def chosen_words(train: DataFrame, sizes: dict, features: int) -> dict[str, list[tuple[int, str]]]:
    """For each verdict the features (kind, name) that tell the classes apart best, by the log-odds of their document counts in units of their error."""
    counts = train.select("text", *HEADS).mapInArrow(lean(word_counts), "head string, kind int, name string, n0 long, n1 long").groupBy("head", "kind", "name").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    size = lambda c: F.element_at(F.create_map(*[F.lit(v) for h in HEADS for v in (h, float(max(1, sizes[h][c])))]), F.col("head"))
    odds = F.log((F.col("n1") + 0.5) / (size(1) + 1)) - F.log((F.col("n0") + 0.5) / (size(0) + 1))
    z = F.abs(odds) / F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    best = Window.partitionBy("head").orderBy(F.desc("z"), "kind", "name")
    rows = counts.withColumn("z", z).filter(F.col("z") > LEAST_Z).withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= features).select("head", "kind", "name").collect()
    return {h: sorted((r[1], r[2]) for r in rows if r[0] == h) for h in HEADS}


FEATURED = "doc_id long, key long, hits array<int>, figures array<float>"


def featured(vocabulary, rest: int = 0):
    """doc_id, text, lang, source and `rest` more -> doc_id, key (alike for rows that agree in text, language and source), places of its features in the vocabulary, figures, the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, width = vocabulary.value, max(1, len(vocabulary.value))
        first = [sum(k < kind for k, _ in known) for kind in range(TWICE + 1)]
        sets = [pa.array([name for k, name in known if k == kind], pa.string()) for kind in range(TWICE + 1)]
        for b in batches:
            for i in range(0, len(b), SLICE):
                s = b.slice(i, SLICE)
                n = len(s)
                doc, code, words, distinct = words_of(s.column(1))
                parts, found = parts_of(words), []
                for kind, names in enumerate([*parts, parts[2]]):
                    own = np.asarray(pc.fill_null(pc.index_in(names, sets[kind], skip_nulls=True), -1)).astype(np.int64)[code]
                    once, often = np.unique(doc[own >= 0] * width + own[own >= 0] + first[kind], return_counts=True)
                    found.append(once[often >= 1 + (kind == TWICE)])
                once = np.sort(np.concatenate(found))
                ends = np.concatenate([[0], np.cumsum(np.bincount(once // width, minlength=n))]).astype(np.int32)
                texts, langs, sources = (s.column(j).to_pylist() for j in (1, 2, 3))
                shape = figures(texts, langs, sources, distinct)
                keys = np.array([xxhash.xxh3_64_intdigest(f"{lang}\0{source}\0{t}".encode("utf-8", "surrogatepass")) for t, lang, source in zip(texts, langs, sources)], np.uint64).view(np.int64)
                shapes = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (SHAPE + 2)), pa.array(shape.ravel()))
                yield pa.record_batch([s.column(0), pa.array(keys), pa.ListArray.from_arrays(pa.array(ends), pa.array((once % width).astype(np.int32))), shapes, *(s.column(4 + j) for j in range(rest))], names=["doc_id", "key", "hits", "figures", *(f"rest{j}" for j in range(rest))])

    return run


def arrays(hits: pa.Array, shapes: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    offsets, flat = np.asarray(hits.offsets), np.asarray(hits.values)
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])], np.asarray(shapes.flatten()).reshape(len(shapes), SHAPE + 2)


def surest(model, exchanged: int):
    """Of the rows of a task, the `exchanged` different ones that each view of each verdict is most sure of on each side: side (0..7), z, key, hits, figures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, best = model.value, {}
        everything = np.arange(len(m.vocabulary))
        for b in batches:
            hits, shape = arrays(b.column(1), b.column(2))
            keys, x = b.column(0).to_numpy(), stacked(hits, everything, len(everything))
            meta = metadata(shape, m.mean, m.scale)
            for h, name in enumerate(HEADS):
                z = m.heads[name].views(x, meta)
                for view in (0, 1):
                    for sign in (0, 1):
                        sure = z[:, view] if sign else -z[:, view]
                        held = best.setdefault(4 * h + 2 * view + sign, {})
                        floor = max(SURE, min(r[0] for r in held.values()) if len(held) >= exchanged else 0)
                        at = np.flatnonzero(sure > floor)
                        for i in at[np.argsort(-sure[at], kind="stable")[:exchanged]].tolist():
                            held[int(keys[i])] = (float(sure[i]), hits[i].tolist(), shape[i].tolist())
                        if len(held) > exchanged:
                            best[4 * h + 2 * view + sign] = dict(sorted(held.items(), key=lambda r: (-r[1][0], r[0]))[:exchanged])
        rows = [(side, sure, key, list(hits), list(shape)) for side, held in best.items() for key, (sure, hits, shape) in held.items()]
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float32())))], names=["side", "sure", "key", "hits", "figures"])

    return run


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, features: int = FEATURES, rounds: int = ROUNDS, exchanged: int = EXCHANGED) -> tuple[Classifier, DataFrame]:
    """The classifier, fitted on the `labelled` rows whose hashed ids are least and on pseudo-labels from all unlabelled rows; and the table of features of all documents."""
    spark = docs.sparkSession
    small_batches(spark)
    share = spark.sparkContext.broadcast
    rows = docs.select("doc_id", "text", "lang", "source")
    known = labels.filter("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").cast("int").alias("quality"), (1 - F.max("toxic")).cast("int").alias("toxic"))
    picked = F.broadcast(known.orderBy(F.xxhash64("_id"), "_id").limit(labelled))  # `labelled` rows at most
    sample = rows.join(picked, rows["doc_id"] == picked["_id"]).drop("_id").withColumn("order", F.xxhash64("doc_id", "text")).orderBy("order", "doc_id").limit(labelled)
    sample = cut(sample.withColumn("tune", F.pmod("order", F.lit(5)) == 0).repartition(16, "order"))
    seen = sample.filter("NOT tune").agg(*(F.count_if(F.col(h) == c).alias(f"{h}{c}") for h in HEADS for c in (0, 1))).first()
    chosen = chosen_words(sample.filter("NOT tune"), {h: (seen[f"{h}0"], seen[f"{h}1"]) for h in HEADS}, features)
    vocabulary = sorted({f for h in HEADS for f in chosen[h]})
    held = share(vocabulary)
    table = cut(rows.mapInArrow(lean(featured(held)), FEATURED))
    figure = lambda f: [F.round(f(F.get("figures", F.lit(i))), 4) for i in range(SHAPE)]
    stats = np.array([v or 0 for v in table.select(*figure(F.avg), *figure(F.stddev_pop)).first()])
    model = Classifier(vocabulary, stats[:SHAPE], stats[SHAPE:] + 1e-3)
    got = sample.select("doc_id", "text", "lang", "source", *HEADS, "tune").mapInArrow(lean(featured(held, 3)), f"{FEATURED}, rest0 int, rest1 int, rest2 boolean").orderBy("key", "doc_id", "rest0", "rest1").toArrow().combine_chunks()
    hits, shape = arrays(*(got[c].combine_chunks() for c in ("hits", "figures"))) if len(got) else ([], np.zeros((0, SHAPE + 2), np.float32))
    tune = np.array(got["rest2"].to_pylist(), bool)
    y = {h: np.array([-1 if c is None else c for c in got[f"rest{i}"].to_pylist()], np.int64) for i, h in enumerate(HEADS)}
    taught = {(h, v): {i: int(y[h][i]) for i in np.flatnonzero(~tune & (y[h] >= 0)).tolist()} for h in HEADS for v in VIEWS}
    at = {f: i for i, f in enumerate(vocabulary)}
    own = {h: np.full(max(1, len(vocabulary)), -1) for h in HEADS}
    for h in HEADS:
        own[h][[at[f] for f in chosen[h]]] = np.arange(len(chosen[h]))
    fitted: dict = {}

    def fit() -> None:
        for h in HEADS:
            for v in VIEWS:
                some = list(taught[h, v])
                x = stacked([hits[i] for i in some], own[h], len(chosen[h])) if v == "text" else Dense(metadata(shape[some], model.mean, model.scale).astype(float))
                fitted[h, v] = logistic(x, np.array(list(taught[h, v].values()), float), steps=80 if (h, v) in fitted else 200, start=fitted.get((h, v)))
            spread = np.zeros(len(vocabulary) + 1)
            spread[:-1] = np.append(fitted[h, "text"][:-1], 0)[own[h][: len(vocabulary)]]
            spread[-1] = fitted[h, "text"][-1]
            model.heads[h] = Head(spread, fitted[h, "meta"])

    fit()
    pool = cut(table.join(known.select(F.col("_id").alias("doc_id")), "doc_id", "left_anti").select("key", "hits", "figures")) if rounds and any(map(len, taught.values())) else None
    places: dict[int, int] = {}
    for _ in range(rounds if pool is not None else 0):
        found = pool.mapInArrow(lean(surest(share(model), exchanged)), "side int, sure double, key long, hits array<int>, figures array<float>").dropDuplicates(["side", "key"])
        first = Window.partitionBy("side").orderBy(F.desc("sure"), "key")
        for r in sorted(found.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= exchanged).collect(), key=lambda r: (r.side, r.nth)):  # 8 * exchanged rows at most
            if r.key not in places:
                places[r.key] = len(hits)
                hits.append(np.array(r.hits, np.int32))
                shape = np.vstack([shape, np.array(r.figures, np.float32)])
            h, other = HEADS[r.side // 4], VIEWS[1 - r.side // 2 % 2]
            taught[h, other].setdefault(places[r.key], r.side % 2)
        fit()
    for h in HEADS:
        some = np.flatnonzero(tune & (y[h] >= 0))
        calibrate(model.heads[h], model.heads[h].views(stacked([hits[i] for i in some], np.arange(len(vocabulary)), len(vocabulary)), metadata(shape[some], model.mean, model.scale)), y[h][some])
    return model, table


def calibrate(head: Head, z: np.ndarray, y: np.ndarray) -> None:
    """Sets how the views' log-odds are combined, and the threshold."""
    head.joint = logistic(Dense(z.clip(-8, 8) / 4), y.astype(float), 1e-2)
    score = head.together(z)
    good, bad = np.sort(score[y == 1]), score[y == 0]
    if len(good) and len(bad):  # else there is nothing to tell apart
        at = np.unique(score)
        cuts = (at[1:] + at[:-1]) / 2
        cost = REFUSAL_COST * np.searchsorted(good, cuts) / len(good) + 1 - np.searchsorted(np.sort(bad), cuts) / len(bad)
        head.threshold = float(cuts[np.argmin(cost)]) if len(cuts) else -np.inf


COLUMNS = [f"{h}_{c}" for h in HEADS for c in ("text", "meta", "score", "ok")]


def scored(model):
    """Rows of the table of features -> doc_id and the verdicts' columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        everything = np.arange(len(m.vocabulary))
        for b in batches:
            hits, shape = arrays(b.column(2), b.column(3))
            x, meta, columns = stacked(hits, everything, len(everything)), metadata(shape, m.mean, m.scale), [b.column(0)]
            for h in HEADS:
                z = m.heads[h].views(x, meta)
                joint = m.heads[h].together(z)
                columns += [pa.array(sigmoid(z[:, 0])), pa.array(sigmoid(z[:, 1])), pa.array(sigmoid(joint)), pa.array(joint >= m.heads[h].threshold)]
            yield pa.record_batch(columns, names=["doc_id", *COLUMNS])

    return run


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row for each row of docs (doc_id, text, lang, source): doc_id, quality_score, nontoxic_score (calibrated probabilities), text_score, meta_score (the views' own, of quality), quality_ok, toxic, kept.

    labels: doc_id, quality, toxic; a null verdict is not trained on, and rows that repeat an id
    count as the worse of them. Null and empty texts have no words and are judged by their
    metadata; null languages and sources are values of their own; texts of any length are read
    whole. Without labels every document is kept. Rows that repeat an id are judged each. Other
    columns are not read. An empty table gives an empty result.
    """
    model, table = train(docs, labels, **options)
    kinds = ", ".join(f"{c} {'boolean' if c.endswith('ok') else 'double'}" for c in COLUMNS)
    return table.mapInArrow(lean(scored(docs.sparkSession.sparkContext.broadcast(model))), f"doc_id long, {kinds}").select(
        "doc_id",
        "quality_score",
        F.col("toxic_score").alias("nontoxic_score"),
        F.col("quality_text").alias("text_score"),
        F.col("quality_meta").alias("meta_score"),
        "quality_ok",
        (~F.col("toxic_ok")).alias("toxic"),
        (F.col("quality_ok") & F.col("toxic_ok")).alias("kept"),
    )


def keep(vocabulary, model, at: list[int]):
    """Rows that both verdicts keep, with all their columns; at: places of doc_id, text, lang and source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def asked() -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(0, len(b), SLICE):
                    held.append(b.slice(i, SLICE))
                    yield pa.record_batch([held[-1].column(j) for j in at], names=["doc_id", "text", "lang", "source"])

        for verdict in scored(model)(featured(vocabulary)(asked())):  # one for each slice
            yield held.pop().filter(pc.and_(*(verdict.column(f"{h}_ok") for h in HEADS)))

    return run


def drop_refused(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs with all its columns, without the rows that the classifier refuses (see classify for odd rows); each row by its own verdict, whatever its id."""
    model, _ = train(docs, labels, **options)
    share = docs.sparkSession.sparkContext.broadcast
    names = [c.lower() for c in docs.columns]
    return docs.mapInArrow(lean(keep(share(model.vocabulary), share(model), [names.index(c) for c in ("doc_id", "text", "lang", "source")])), docs.schema)
