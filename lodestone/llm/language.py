"""Language identification as inference of a mixture.

Training counts hashed byte trigrams of every training row by language, in one Spark aggregation; the table's size is
fixed by CELLS and the number of languages. A document is a mixture of languages: expectation-maximisation finds the
proportions that make its trigrams likeliest. The set of languages starts with the likeliest one, and takes the next
one, by proportion, as long as the likelihood gains more than a penalty. The prediction is the set's language of the
largest proportion; the score is that language's proportion among all.

Defined cases: a null text, or one without a letter, is `und` with score 0, as is every text when no row could be
learnt from; a null lang isn't learnt; repeated rows and null doc_ids are kept (a null doc_id is held out); an empty
table gives an empty result; further columns are ignored; texts of any length count whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, training_row

CELLS = 1 << 14
#: Numbers that an array of the inference holds at most, besides one document's.
WIDTH = 1 << 22
ROUNDS = 12
#: A further language must gain so many times half the logarithm of the number of trigrams, which overlap.
PENALTY = 12.0
LETTER = re.compile(rb"[A-Za-z]")
#: Lower case, and one mark for all ASCII that isn't a letter.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def cells_of(text: bytes) -> np.ndarray:
    """Hashed trigrams of the text, with a mark at both ends."""
    a = np.frombuffer(b" " + text.translate(PLAIN) + b" ", dtype=np.uint8).astype(np.uint32)
    code = a[:-2] << np.uint32(16) | a[1:-1] << np.uint32(8) | a[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)


def has_letter(text: bytes | None) -> bool:
    return bool(text) and (bool(LETTER.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "replace")))


def learn(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log-probability of each cell in each) from rows (text, lang)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch, texts in slices(batches, "text"):
            for text, lang in zip(texts, batch.column(1).to_pylist(), strict=True):
                if has_letter(text):
                    if lang not in seen:
                        seen[lang] = np.zeros(CELLS, dtype=np.int64)
                    seen[lang] += np.bincount(cells_of(text), minlength=CELLS)
        for lang, n in seen.items():
            full = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(full), pa.string()), pa.array(full, pa.int64()), pa.array(n[full], pa.int64())], ["lang", "cell", "n"])

    found = rows.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").mapInArrow(count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(found.column(0).to_pylist()))
    table, place = np.full((CELLS, len(langs)), 0.5), {x: i for i, x in enumerate(langs)}
    at = np.array([place[x] for x in found.column(0).to_pylist()], dtype=np.int64)
    table[found.column(1).to_numpy(), at] += found.column(2).to_numpy()
    return langs, np.log(table / table.sum(axis=0))


def mixtures(part: np.ndarray, weight: np.ndarray, starts: np.ndarray, total: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log-likelihood) of each document, from the likelihoods `part` of its trigrams, whose counts are
    weight. allowed: the languages that may take part in each document."""
    doc = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(weight))))
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(ROUNDS):
        r = part * share[doc]
        r *= (weight / r.sum(axis=1))[:, None]
        share = np.add.reduceat(r, starts, axis=0) / total[:, None]
    return share, np.add.reduceat(weight * np.log((part * share[doc]).sum(axis=1)), starts)


def infer(texts: list[bytes], logs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text (with a letter): the language's index, its proportion among all, and the size of the set."""
    found = [np.bincount(cells_of(t), minlength=CELLS) for t in texts]
    cells = [np.flatnonzero(x) for x in found]
    sizes = np.array([len(c) for c in cells])
    starts = np.cumsum(sizes) - sizes
    weight = np.concatenate([x[c] for x, c in zip(found, cells, strict=True)]).astype(float)
    entry = logs[np.concatenate(cells)]
    top = entry.max(axis=1)
    part = np.exp(entry - top[:, None])
    total = np.add.reduceat(weight, starts)
    n, k = len(texts), logs.shape[1]
    single = np.add.reduceat((entry - top[:, None]) * weight[:, None], starts, axis=0)
    everything, _ = mixtures(part, weight, starts, total, np.ones((n, k)))
    chosen = np.zeros((n, k))
    chosen[np.arange(n), single.argmax(axis=1)] = 1
    share, likelihood = chosen.copy(), single.max(axis=1)
    growing = np.arange(n) if k > 1 else np.zeros(0, dtype=np.int64)
    need = PENALTY * 0.5 * np.log(total + 1)
    while len(growing):
        more = chosen[growing].copy()
        rest = np.where(more > 0, -1.0, everything[growing])
        more[np.arange(len(growing)), rest.argmax(axis=1)] = 1
        rows = np.concatenate([np.arange(starts[i], starts[i] + sizes[i]) for i in growing])
        own = np.cumsum(sizes[growing]) - sizes[growing]
        new, gain = mixtures(part[rows], weight[rows], own, total[growing], more)
        better = gain - likelihood[growing] > need[growing]
        took = growing[better]
        chosen[took], share[took], likelihood[took] = more[better], new[better], gain[better]
        growing = took[chosen[took].sum(axis=1) < k]
    best = share.argmax(axis=1)
    return best, np.clip(everything[np.arange(n), best], 0.0, 1.0), chosen.sum(axis=1).astype(int)


def held_together(texts: list[bytes], languages: int) -> Iterator[range]:
    """Places of texts whose different trigrams, for all languages, are WIDTH numbers at most, or of one text."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        size = min(len(text), CELLS) * languages
        if held and held + size > WIDTH:
            yield range(start, i)
            start, held = i, 0
        held += size
    if start < len(texts):
        yield range(start, len(texts))


def identify(docs: DataFrame) -> DataFrame:
    """For each row of docs: doc_id, held_out, lang_pred, score, n_languages."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    langs, logs = learn(rows.where(training_row()))
    shared = docs.sparkSession.sparkContext.broadcast(logs)  # CELLS numbers for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text", 4 << 20):
            n = len(texts)
            names, scores, many = ["und"] * n, np.zeros(n), np.zeros(n, dtype=np.int64)
            known = [i for i, t in enumerate(texts) if langs and has_letter(t)]
            for some in held_together([texts[i] for i in known], len(langs)):
                at = [known[j] for j in some]
                best, score, count = infer([texts[i] for i in at], shared.value)
                for i, b in zip(at, best, strict=True):
                    names[i] = langs[b]
                scores[at], many[at] = score, count
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores), pa.array(many)], ["doc_id", "lang_pred", "score", "n_languages"])

    found = rows.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, n_languages long")
    return found.select("doc_id", (~training_row()).alias("held_out"), "lang_pred", "score", "n_languages")
