"""Quality rules with suffix arrays of words.

All documents of a batch share one suffix array: doubling ranks the suffixes by their first 1, 2, 4, ... words, and
only suffixes that still tie are ranked again. Documents never tie with each other. The common prefix of neighbours
is read off the kept ranks from the longest down. A place whose suffix shares L words with a neighbour starts a
repeated substring of L words; the spans' union gives the covered words.

A document fails the base rules with fewer than 10 words, or if over 20 % of its words lie in 5-word windows found
twice or more. It fails the method's rules if repeats of MIN_REPEAT words or more cover over MOST_COVERED % of its words
(less than the base rule's share, so that it decides where that doesn't), or if one repeat is longer than LONGEST words
or, from LONG words on, than LONGEST_PART % of its words.

Defined cases: a null, empty or white text has no words and fails; repeated rows and null doc_ids are kept as they
are; an empty table gives an empty result; further columns are ignored; texts of any length count whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

WINDOW = 5
MIN_REPEAT, MOST_COVERED, LONGEST = 8, 12, 200
LONG, LONGEST_PART = 20, 5
SYMBOLS = np.frombuffer(b"#*$%&|<>", dtype=np.uint8)
WHITE = np.frombuffer(b"\t\n\x0b\x0c\r ", dtype=np.uint8)
#: Bytes of text for which one suffix array is built, besides one document.
ARRAY_BYTES = 4 << 20


def suffix_array(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): places in the order of their suffixes, and how many symbols each shares with the one before.

    symbols: numbers of words, so that equal words of one document have equal numbers and words of different
    documents have different ones. ends: for each place, the end of its document.
    """
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    ranks, step = [rank], 1
    counts = np.bincount(rank, minlength=n)
    tied = np.flatnonzero(counts[rank] > 1)
    # ranks leave room: a group's rank is its first place in the order
    rank = (np.cumsum(counts) - counts)[rank]
    ranks[0] = rank
    while len(tied):
        after = tied + step
        following = np.where(after < ends[tied], rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.lexsort((following, rank[tied]))
        places, group, follow = tied[order], rank[tied][order], following[order]
        new_group = np.concatenate([[True], group[1:] != group[:-1]])
        new_pair = new_group | np.concatenate([[True], follow[1:] != follow[:-1]])
        index = np.arange(len(places))
        group_start = np.maximum.accumulate(np.where(new_group, index, 0))
        pair_start = np.maximum.accumulate(np.where(new_pair, index, 0))
        new_rank = rank.copy()
        new_rank[places] = group + pair_start - group_start
        size = np.diff(np.append(np.flatnonzero(new_pair), len(places)))
        tied = places[np.repeat(size, size) > 1]
        rank = new_rank
        ranks.append(rank)
        step *= 2
    order = np.empty(n, dtype=np.int64)
    order[rank] = np.arange(n)
    common = np.zeros(n, dtype=np.int64)
    if n > 1:
        pairs = np.flatnonzero(ranks[0][order[1:]] == ranks[0][order[:-1]]) + 1
        a, b = order[pairs - 1].copy(), order[pairs].copy()
        shared = np.zeros(len(pairs), dtype=np.int64)
        for level in range(len(ranks) - 1, -1, -1):
            # suffixes with one rank at this level agree in 2**level words, unless a document ended, which splits them
            inside = (a < ends[order[pairs - 1]]) & (b < ends[order[pairs]])
            same = inside & (ranks[level][np.minimum(a, n - 1)] == ranks[level][np.minimum(b, n - 1)])
            a, b, shared = a + same * (1 << level), b + same * (1 << level), shared + same * (1 << level)
        common[pairs] = shared
    return order, common


def repeats(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(starts, reach): where each document's words start in the row of all, and for each word the length of the
    longest substring from there that occurs elsewhere in its document."""
    counts = np.array([len(w) for w in words], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(counts)])
    n = int(starts[-1])
    if not n:
        return starts, np.zeros(0, dtype=np.int64)
    names = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(words)))}
    numbers = np.fromiter(map(names.__getitem__, chain.from_iterable(words)), dtype=np.int64, count=n)
    doc = np.repeat(np.arange(len(words), dtype=np.int64), counts)
    order, common = suffix_array(doc * len(names) + numbers, np.repeat(starts[1:], counts))
    reach = np.zeros(n, dtype=np.int64)
    reach[order] = np.maximum(common, np.append(common[1:], 0))
    return starts, reach


def covered(starts: np.ndarray, reach: np.ndarray, least: int) -> np.ndarray:
    """For each document, the words in the union of repeated substrings of `least` words or more."""
    index = np.arange(len(reach))
    far = np.maximum.accumulate(np.where(reach >= least, index + reach, 0)) if len(reach) else reach
    inside = np.concatenate([[0], np.cumsum(far > index)])  # a span ends within its document
    return inside[starts[1:]] - inside[starts[:-1]]


def repetition(docs: DataFrame) -> DataFrame:
    """For each row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_covered (words in long repeats) and longest_repeat."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text", ARRAY_BYTES):
            bodies = [t or b"" for t in texts]
            words = [t.split() for t in bodies]
            starts, reach = repeats(words)
            plain = []
            for text in bodies:
                bytes_ = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
                lines = [x for x in text.split(b"\n") if x.strip()]
                points = len(text) - int(bytes_[0x80:0xC0].sum())
                plain.append((points - int(bytes_[WHITE].sum()), int(bytes_[SYMBOLS].sum()), len(lines) - len(set(lines))))
            n_words = np.diff(starts)
            longest = np.array([int(reach[a:b].max()) if b > a else 0 for a, b in zip(starts[:-1], starts[1:], strict=True)], dtype=np.int64)
            chars, symbols, lines = (np.array(x, dtype=np.int64) for x in zip(*plain, strict=True))
            rows = [n_words, chars, symbols, lines, covered(starts, reach, WINDOW), covered(starts, reach, MIN_REPEAT), longest]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in rows)], ["doc_id", *names])

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, " + ", ".join(f"{x} long" for x in names))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    part = (F.col("longest_repeat") < LONG) | (100 * F.col("longest_repeat") <= LONGEST_PART * F.col("n_words"))
    verdict = (100 * F.col("n_covered") <= MOST_COVERED * F.col("n_words")) & (F.col("longest_repeat") <= LONGEST) & part
    return found.select("doc_id", *names[:5], failed.alias("base_failed"), (~failed & verdict).alias("kept"), *names[5:])
