"""A quality classifier: a generalised additive model with pairwise interactions.

One pass over the texts gives each document's features, which are written. Labelled training rows, at most SAMPLE of
them (those of the smallest hashes of doc_id, a documented bound), are fitted by cyclic boosting: in turn each feature
gets a shallow tree on its bins, whose leaves are added to the feature's lookup table. Then pairs of the features that
matter most get tables of their own in the same way. A score is a sum of table entries, looked up for whole batches.

Defined cases: a null text counts as empty; empty texts are scored; a null or missing label isn't learnt, and of
several labels of one document the mean decides (0.5 and more is 1); without any label to learn, or with labels of one
kind only, the score is their mean, 0.5 if none; repeated rows and null doc_ids are kept (a null doc_id is held out);
an empty table gives an empty result; further columns are ignored; texts of any length count whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, slices, training_row, whole

#: Most labelled rows that the model is fitted on.
SAMPLE = 20_000
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, RATE, PAIRS, LEAVES = 120, 60, 0.1, 5, 4

FEATURES = ("words", "characters", "word_length", "symbols", "exclamations", "capitals", "digits", "stops", "not_ascii", "white", "distinct_words", "repeated_lines", "line_words", "entropy", "short_words", "longest_word", "repeated_pairs")
SYMBOLS = np.frombuffer(b"#*$%&|<>~^=@{}[]\\_/+", dtype=np.uint8)
STOPS = np.frombuffer(b".,;:?", dtype=np.uint8)


def features(text: bytes | None) -> list[float]:
    """Of the whole text."""
    text = text or b""
    n = len(text)
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    count = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256).astype(float)
    upper, lower = count[65:91].sum(), count[97:123].sum()
    lines = [x for x in text.split(b"\n") if x.strip()]
    part = count[count > 0] / n
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    m = len(words)
    return [
        float(np.log1p(m)), float(np.log1p(n)), float(sizes.mean()), float(count[SYMBOLS].sum() / m), float(count[33] / m), float(upper / max(1.0, upper + lower)), float(count[48:58].sum() / n),
        float(count[STOPS].sum() / m), float(count[128:].sum() / n), float((count[9:14].sum() + count[32]) / n), len(set(words)) / m, 1 - len(set(lines)) / len(lines), float(np.log1p(m / len(lines))),
        float(-(part * np.log2(part)).sum()), float((sizes <= 3).mean()), float(np.log1p(sizes.max())), 1 - len(set(zip(words, words[1:], strict=False))) / max(1, m - 1),
    ]


def feature_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            rows = np.array([features(t) for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, i]) for i in range(len(FEATURES)))], ["doc_id", *FEATURES])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, " + ", ".join(f"{x} double" for x in FEATURES))


@dataclass
class Model:
    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities: table entries of every feature's and pair's bins, added."""
        total = np.full(len(x), self.base)
        for i, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cuts, x[:, i], side="right")]
        if self.pairs:
            bins = [np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(self.pair_cuts)]
            for i, j, table in self.pairs:
                total += table[bins[i], bins[j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def quantile_cuts(x: np.ndarray, bins: int) -> np.ndarray:
    """Bounds of bins of about equal counts; a bin holds its lower bound."""
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def tree(gradient: np.ndarray, weight: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """A shallow tree over ordered bins, as each bin's value: the best split of all leaves, again and again."""
    edges = [0, len(gradient)]
    g, w = (np.concatenate([[0.0], np.cumsum(x)]) for x in (gradient, weight))
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (w[b] - w[a] + 1.0)
    while len(edges) <= leaves:
        best, at = 1e-9, None
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            inner = np.arange(a + 1, b)
            if len(inner):
                gains = gain(a, inner) + gain(inner, b) - gain(a, b)
                k = int(gains.argmax())
                if gains[k] > best:
                    best, at = gains[k], int(inner[k])
        if at is None:
            break
        edges = sorted([*edges, at])
    out = np.zeros(len(gradient))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        out[a:b] = (g[b] - g[a]) / (w[b] - w[a] + 1.0)
    return out


def pair_tree(gradient: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Four leaves over two features' bins: one cut of the first, and one of the second in each part. With its gain."""
    best, out = 0.0, np.zeros_like(gradient)
    whole = gradient.sum() ** 2 / (weight.sum() + 1.0)
    for cut in range(1, len(gradient)):
        parts, total = np.zeros_like(gradient), -whole
        for rows in (slice(0, cut), slice(cut, None)):
            values = tree(gradient[rows].sum(axis=0), weight[rows].sum(axis=0), 2)
            parts[rows] = values
            total += float((values**2 * (weight[rows].sum(axis=0))).sum())
        if total > best:
            best, out = total, parts
    return out, best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """x: a row of features for each label in y (0 or 1)."""
    if not len(y) or y.min() == y.max():
        mean = float(y.mean()) if len(y) else 0.5
        return Model(base=float(np.clip(np.log(max(mean, 1e-6) / max(1 - mean, 1e-6)), -12, 12)))
    mean = float(y.mean())
    model = Model(base=float(np.log(mean / (1 - mean))))
    k = x.shape[1]
    model.cuts = [quantile_cuts(x[:, i], BINS) for i in range(k)]
    bins = [np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(model.cuts)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    total = np.full(len(y), model.base)
    for _ in range(ROUNDS):
        for i in range(k):
            p = 1 / (1 + np.exp(-total))
            n = len(model.tables[i])
            step = RATE * tree(np.bincount(bins[i], y - p, n), np.bincount(bins[i], p * (1 - p), n))
            model.tables[i] += step
            total += step[bins[i]]
    model.pair_cuts = [quantile_cuts(x[:, i], PAIR_BINS) for i in range(k)]
    coarse = [np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(model.pair_cuts)]

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = len(model.pair_cuts[i]) + 1, len(model.pair_cuts[j]) + 1
        p, cell = 1 / (1 + np.exp(-total)), coarse[i] * b + coarse[j]
        return np.bincount(cell, y - p, a * b).reshape(a, b), np.bincount(cell, p * (1 - p), a * b).reshape(a, b), cell

    gains = {(i, j): pair_tree(*sums(i, j)[:2])[1] for i, j in combinations(range(k), 2)}
    chosen = sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS]
    tables = {p: np.zeros((len(model.pair_cuts[p[0]]) + 1, len(model.pair_cuts[p[1]]) + 1)) for p in chosen}
    for _ in range(PAIR_ROUNDS):
        for i, j in chosen:
            gradient, weight, cell = sums(i, j)
            step = RATE * pair_tree(gradient, weight)[0]
            tables[i, j] += step
            total += step.reshape(-1)[cell]
    model.pairs = [(i, j, tables[i, j]) for i, j in chosen]
    return model


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """For each row of docs: doc_id, held_out, score, predicted."""
    rows = settle(feature_rows(docs), "features")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("quality"))
    train = rows.where(training_row()).join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES).limit(sample).toArrow()
    x = np.stack([train.column(f).to_numpy() for f in FEATURES], axis=1) if len(train) else np.zeros((0, len(FEATURES)))
    model = fit(x, train.column("quality").to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.score(np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "score"])

    out = rows.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (~training_row()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the classifier rejects. Rows are matched by doc_id; rows of one doc_id stay if any of
    them is accepted."""
    good = classify(docs, labels).where("predicted = 1").select(F.col("doc_id").alias("good")).distinct()
    kept = whole(docs, docs["doc_id"].cast("long")).join(good, F.col("key").eqNullSafe(F.col("good")), "left_semi")
    return kept.select("row.*")
