"""Which documents hold which word windows: an equi-join on each window's rarest shingle.

Windows' shingles (runs of a few words) set bits of a table of fixed size. Documents go by once, and only shingles whose
bit is set leave a task, so what is shuffled is in proportion to what windows and documents share. Counted by key, they
tell each window's rarest shingle, and only that one is joined; the windows themselves are compared where they meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import settle
from . import lists

#: Words of a shingle; bits of the table, whatever the input.
WIDTH, CELLS = 8, 1 << 20
PRIME = np.uint64(0x9E3779B97F4A7C15)


#: White space as blanks.
BLANKED = bytes(32 if c in b" \t\n\r\x0b\x0c" else c for c in range(256))


def shingle_keys(lines: pa.Array, width: int, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): hashes of the different runs of `width` words of each text, as signed integers; those in the table if
    there is one. No text is null."""
    held, at = lists.held_bytes(lines)
    held = np.frombuffer(held.tobytes().translate(BLANKED), np.uint8)
    word = held != 32
    border = np.zeros(len(held) + 1, bool)
    border[at] = True
    first = np.flatnonzero(word & (border[:-1] | np.concatenate([[True], ~word[:-1]])[: len(word)]))
    # the words' bytes without what is between them
    begin = np.concatenate([np.cumsum(word)[first] - 1, [word.sum()]]).astype(np.int64)
    h = lists.hashes(held[word], begin)
    row = np.searchsorted(at, first, "right") - 1
    n = max(0, len(h) - width + 1)
    keys = np.zeros(n, np.uint64)
    for i in range(width):
        keys = keys * PRIME + h[i : i + n]
    keys = (keys ^ (keys >> np.uint64(29))).view(np.int64)
    stays = row[:n] == row[len(row) - n :]
    if table is not None:
        stays &= table[keys & (CELLS - 1)]
    row, keys = row[:n][stays], keys[stays]
    order = np.lexsort((keys, row))
    row, keys = row[order], keys[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (keys[1:] != keys[:-1])])[: len(row)]
    return row[new], keys[new]


def _keys(rows: DataFrame, name: str, width: int, table: np.ndarray | None = None) -> DataFrame:
    """(name, key) of rows (name, text): the different shingles of each text, those in the table if there is one."""
    kind = dict(rows.dtypes)[name]
    shared = rows.sparkSession.sparkContext.broadcast(table) if table is not None else None  # CELLS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, lines = batch.column(0), pc.fill_null(batch.column(1), "")
            ends = np.cumsum(pc.binary_length(lines).to_numpy(zero_copy_only=False))
            first = 0
            while first < len(lines):
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + lists.BYTES)))
                at, keys = shingle_keys(lines[first:last], width, shared and shared.value)
                yield pa.RecordBatch.from_arrays([names[first:last].take(pa.array(at)), pa.array(keys)], [name, "key"])
                first = last

    return rows.select(name, F.col("text").cast("string")).mapInArrow(run, f"{name} {kind}, key long")


def candidates(docs: DataFrame, windows: DataFrame, width: int = WIDTH) -> DataFrame:
    """(query_id, id): pairs of windows (query_id, text: at least `width` words) and documents (id, text) that share the
    window's rarest shingle. A window whose shingles no document has has no row."""
    asked = settle(_keys(windows, "query_id", width), "asked")
    table = np.zeros(CELLS, bool)
    table[asked.select(F.col("key").bitwiseAND(CELLS - 1).alias("cell")).distinct().toArrow().column(0).to_numpy()] = True
    held = settle(_keys(docs, "id", width, table), "held")
    often = held.groupBy("key").agg(F.count("*").alias("n"))
    known = asked.join(often, "key", "left").groupBy("query_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("least"))
    rarest = known.where("least.n > 0").select("query_id", F.col("least.key").alias("key"))
    return held.join(rarest, "key").select("query_id", "id").distinct()


def words_line(text: Column) -> Column:
    """The words of a text, one space before, between and after them."""
    return F.concat(F.lit(" "), F.array_join(T.words(text), " "), F.lit(" "))


def containing(docs: DataFrame, windows: DataFrame, width: int = WIDTH) -> DataFrame:
    """(query_id, id, text) of the documents (id, text) that hold all words of a window (query_id, text), in a row."""
    pairs = settle(candidates(docs, windows, width), "pairs")  # small, and sent to the texts where Spark finds it so
    wide = docs.join(pairs.join(windows.select("query_id", words_line(F.col("text")).alias("line")), "query_id"), "id")
    return wide.where(F.contains(words_line(F.col("text")), F.col("line"))).select("query_id", "id", "text")
