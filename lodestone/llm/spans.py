"""Substring dedup over sliding spans of sentences.

From each sentence on, a run goes on over RUN sentences at least, and to the first at which it holds LEAST_WORDS words.
Each is hashed (128 bits, of its lower-cased words), and the runs are written once. Equal runs meet in one global
aggregation that keeps their first place, by doc_id, text and position; joining it back gives the runs that aren't
first, and every sentence that one of them covers is removed. The rest of a text stays byte for byte.

Sentences end after . ! or ? before white space and at line ends. Those of more than MOST_WORDS words are cut after
each word whose hash, with the word before, is less than those of the NEAR words to either side; where that leaves more
than MOST_WORDS words, after the least of the next ones. So cuts fall alike in all copies of a passage from a few words
after its start on, whatever stands before it. Only its first and last words, up to a sentence's, may be cut otherwise.
RUN, LEAST_WORDS and MOST_WORDS are `Shape`'s defaults: what counts as a run is the caller's choice.

Defined cases: a null or empty text has no sentence; a place belongs to a doc_id and a text, so rows that repeat both
share their places and keep the same text, and other texts of that doc_id, or without one, have places of their own; a
null doc_id comes first, and equal doc_ids by the text's key; an empty table gives an empty result; further columns are
ignored; texts of any length count whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, settle, slices

RUN, LEAST_WORDS, MOST_WORDS = 3, 15, 12
#: Words to either side that decide whether a long sentence is cut after a word.
NEAR = 3
#: After a mark, blanks; else blanks up to a line end and the white space after it. A run of blanks is looked at once,
#: from its first one, whether a line ends after it or not.
BORDER = re.compile(rb"[ \t\r\x0b\x0c](?:(?<=[.!?].)[ \t\r\x0b\x0c]*+|(?<![ \t\r].)(?<![\x0b\x0c])[ \t\r]*+\n\s*+)|\n\s*+")
SPACES = re.compile(rb"[ \t-\r]+")


@dataclass(frozen=True)
class Shape:
    """Sentences and words that a run holds at least; words of a sentence at most (None: sentences are never cut)."""

    run: int = RUN
    least_words: int = LEAST_WORDS
    most_words: int | None = MOST_WORDS


SHAPE = Shape()


def cuts(words: list[bytes], most: int = MOST_WORDS) -> list[int]:
    """How many words stand before each cut of a long sentence."""
    hashes = [xxhash.xxh3_64_intdigest(a + b" " + b) for a, b in zip([b"", *words], words, strict=False)]
    least = [i + 1 for i in range(NEAR, len(words) - NEAR) if (h := hashes[i]) < min(hashes[i - NEAR : i]) and h <= min(hashes[i + 1 : i + 1 + NEAR])]
    out, last = [], 0
    for cut in [*least, len(words)]:
        while cut - last > most:
            near = hashes[last + NEAR : last + most][::-1]
            last += most - near.index(min(near))
            out.append(last)
        if cut < len(words):
            out.append(cut)
        last = cut
    return out


def sentences(text: bytes, most: int | None = MOST_WORDS) -> list[tuple[int, int, list[bytes]]]:
    """(start, end, words) of each sentence; they tile the text. White space after a sentence belongs to it."""
    out, start = [], 0
    for end in [*(m.end() for m in BORDER.finditer(text)), len(text)]:
        words = text[start:end].split()
        if not words:
            if out and end > start:
                out[-1] = out[-1][0], end, out[-1][2]
                start = end
            continue
        if most and len(words) > most:
            gaps = [m.end() for m in SPACES.finditer(text, start, end) if m.start() > start]
            at = 0
            for n in cuts([w.lower() for w in words], most):
                out.append((start, gaps[n - 1], words[at:n]))
                start, at = gaps[n - 1], n
            words = words[at:]
        out.append((start, end, words))
        start = end
    return out


def run_ends(sizes: list[int], shape: Shape = SHAPE) -> list[int]:
    """Where the run from each sentence on ends; the last sentences, from which no run holds words enough, have none.
    Equal runs have sentences of equal sizes, so a run's place gives its length again."""
    out, end, held = [], 0, 0
    for i, size in enumerate(sizes):
        while end < len(sizes) and (end < i + shape.run or held < shape.least_words):
            held += sizes[end]
            end += 1
        if end < i + shape.run or held < shape.least_words:
            break
        out.append(end)
        held -= size
    return out


def runs(text: bytes, shape: Shape = SHAPE) -> tuple[list[bytes], list[int]]:
    """Hashes of the runs, and the sentence each starts at."""
    tiles = sentences(text, shape.most_words)
    names = b"".join(xxhash.xxh3_128_digest(b" ".join(w).lower()) for _, _, w in tiles)
    ends = run_ends([len(w) for _, _, w in tiles], shape)
    return [xxhash.xxh3_128_digest(names[16 * i : 16 * end]) for i, end in enumerate(ends)], list(range(len(ends)))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text): key stands for doc_id and text; only rows that repeat share it."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(doc_id.alias("doc_id"), row_key(doc_id, text).alias("key"), text.alias("text"))


def all_runs(docs: DataFrame, shape: Shape = SHAPE) -> DataFrame:
    """(doc_id, key, run, place): a row for each run of each text. What is written is a row for each document, its runs'
    hashes one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text", 2 << 20):
            found = [b"".join(runs(t, shape)[0]) if t else b"" for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.select(["doc_id", "key"]).columns, pa.array(found, pa.binary())], ["doc_id", "key", "runs"])

    packed = settle(keyed(docs).mapInArrow(run, "doc_id long, key binary, runs binary").where("length(runs) > 0"), "runs")
    listed = packed.select("*", F.explode(F.sequence(F.lit(0), (F.length("runs") / 16).cast("int") - 1)).alias("place"))
    return listed.select("doc_id", "key", F.substring("runs", F.col("place") * 16 + 1, F.lit(16)).alias("run"), "place")


def remove_repeats(docs: DataFrame, shape: Shape = SHAPE) -> DataFrame:
    """For each row of docs that loses sentences: doc_id, n_sentences, n_removed, words_removed, removed (start and end
    bytes of each removed stretch) and text, what is left."""
    found = all_runs(docs, shape)
    at = F.struct("doc_id", "key", "place")
    first = settle(found.groupBy("run").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1").select("run", "first.key", "first.place"), "first-runs")
    here = (found["key"] == first["key"]) & (found["place"] == first["place"])  # the key stands for the doc_id too
    later = found.join(first, "run").where(~here).select(found["key"], found["place"])
    covered = settle(later.groupBy("key").agg(F.collect_set("place").alias("places")), "later-runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            rows = []
            for text, places in zip(texts, batch.column(2).to_pylist(), strict=True):
                tiles = sentences(text or b"", shape.most_words)
                gone = np.zeros(len(tiles), dtype=bool)
                ends = run_ends([len(w) for _, _, w in tiles], shape)
                for p in places:
                    gone[p : ends[p]] = True
                stretches: list[list[int]] = []
                for (start, end, _), out in zip(tiles, gone, strict=True):
                    if out and stretches and stretches[-1][1] == start:
                        stretches[-1][1] = end
                    elif out:
                        stretches.append([start, end])
                left = b"".join((text or b"")[s:e] for (s, e, _), out in zip(tiles, gone, strict=True) if not out)
                rows.append((len(tiles), int(gone.sum()), sum(len(w) for (_, _, w), out in zip(tiles, gone, strict=True) if out), stretches, left.decode("utf-8", "replace")))
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_sentences", "n_removed", "words_removed", "removed", "text"])

    wide = keyed(docs).join(covered, "key").select("doc_id", "text", "places")
    return wide.mapInArrow(cut, "doc_id long, n_sentences long, n_removed long, words_removed long, removed array<array<long>>, text string")
