"""BM25 over an index of document blocks, which leaves out postings that can't bring a document among a query's first k.

Documents are numbered by length (copies and texts of one kind come together so), and a block holds a fixed number of
them. The index has a row for each term of a block: its postings as arrays, and the peak, the most that the term can add
to a document of the block before its weight. A search reads the peaks of the queries' terms only. Their weighted sum
bounds every score in a block, and the most promising blocks are scored first: they give each query a score that its
k-th is not below. A query's least weighty terms, as many as can't reach that score together, are its common ones: only
documents with one of its other terms can be among the first k. Of the other blocks, only postings of those other terms
are read, in blocks whose bound reaches the score; and the common terms' postings only in blocks where some document
may reach it with all that the block's common terms can add. The result is that of the plain search.

For many documents the index is packed: a row for the documents that were counted together, whose blocks are cut by
length among them, with the peaks and the postings of each word in arrays. A search goes over it twice, with blocks of
queries: first each query's most promising block of a row is scored, which gives the score that its k-th is not below;
then all blocks whose bound reaches that. Nothing but each task's k best rows a query is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import numbered, settle
from . import lists
from .bm25 import CANDIDATES, K1, B, Tokens, contribution, counted, counted_statistics, idf, query_terms, ranked, search_counted

#: Documents of a block; blocks that are scored first; room for rounding in sums.
BLOCK, FIRST, SLACK = 8, 32, 1e-8
#: Terms whose peaks are multiplied at once.
TERMS = 2048


def build(posted: DataFrame, stats: DataFrame, block: int = BLOCK, k1: float = K1, b: float = B) -> DataFrame:
    """(block, term, n, peak, ids, lens, tfs) of postings (id, len, term, tf) and the one row of statistics. Peaks hold
    for these k1 and b."""
    places = numbered(posted.select("id", "len").distinct(), F.col("len"), F.col("id"))
    of = places.select("id", F.floor(F.col("place") / block).alias("block"))
    wide = posted.join(of, "id").crossJoin(F.broadcast(stats.select("avgdl")))  # one row
    part = contribution(F.lit(k1), F.lit(b))
    parts = wide.withColumn("idf", F.lit(1.0)).select("block", "term", "id", "len", "tf", part.alias("part"))
    listed = F.sort_array(F.collect_list(F.struct("id", "len", "tf")))  # of one block: at most its documents
    rows = parts.groupBy("block", "term").agg(F.count("*").alias("n"), F.max("part").alias("peak"), listed.alias("p"))
    return rows.select("block", "term", "n", "peak", F.col("p.id").alias("ids"), F.col("p.len").alias("lens"), F.col("p.tf").alias("tfs"))


def weights(heads: DataFrame, stats: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, pos, term, idf, avgdl) of queries' terms that the index has, from its rows (term, n)."""
    df = heads.groupBy("term").agg(F.sum("n").alias("df"))
    return terms.join(df, "term").crossJoin(F.broadcast(stats.select(F.col("n").alias("docs"), "avgdl"))).select("query_id", "pos", "term", idf(F.col("docs"), F.col("df")).alias("idf"), "avgdl")  # one row


def _parts(index: DataFrame, rows: DataFrame, k1: float, b: float) -> DataFrame:
    """(query_id, block, id, pos, part): what the terms of rows (query_id, block, term, pos, idf, avgdl) add to documents."""
    held = index.join(rows, ["block", "term"]).select("query_id", "block", "pos", "idf", "avgdl", F.explode(F.arrays_zip("ids", "lens", "tfs")).alias("p"))
    parts = held.select("query_id", "block", "pos", "idf", "avgdl", F.col("p.ids").alias("id"), F.col("p.lens").alias("len"), F.col("p.tfs").alias("tf"))
    return parts.select("query_id", "block", "id", "pos", contribution(F.lit(k1), F.lit(b)).alias("part"))


def _sums(parts: DataFrame) -> DataFrame:
    return parts.groupBy("query_id", "block", "id").agg(F.sum("part").alias("score"), F.min("pos").alias("first"))


def _run(index: DataFrame, stats: DataFrame, queries: DataFrame, k: int, tokens: Tokens, k1: float, b: float, first: int) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """(scores (query_id, id, score, first), the rows of the index that were read for them, all rows that are asked for)."""
    terms = query_terms(queries, tokens)
    heads = settle(index.select("block", "term", "n", "peak").join(terms.select("term").distinct(), "term", "left_semi"), "heads")
    known = settle(weights(heads, stats, terms), "weights")
    asked = heads.join(known, "term").withColumn("most", F.col("idf") * F.col("peak"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "block"))
    bounds = settle(asked.groupBy("query_id", "block").agg(F.sum("most").alias("bound")).withColumn("nth", nth), "bounds")
    begun = asked.join(bounds.where(F.col("nth") <= first).select("query_id", "block"), ["query_id", "block"])
    seeds = settle(_sums(_parts(index, begun, k1, b)), "seeds")
    least = ranked(seeds, k).where(F.col("rank") == k).select("query_id", (F.col("score") - SLACK).alias("least"))
    least = settle(queries.select("query_id").distinct().join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0))), "least")
    # the least weighty terms, as many as don't reach the score together
    tops = asked.groupBy("query_id", "term", "pos").agg(F.max("most").alias("top"))
    so_far = F.sum("top").over(Window.partitionBy("query_id").orderBy("top", "pos"))
    common = settle(tops.withColumn("sum", so_far).join(least, "query_id").select("query_id", "term", (F.col("sum") < F.col("least")).alias("common")), "common")
    open_ = bounds.where(F.col("nth") > first).join(least, "query_id").where(F.col("bound") >= F.col("least")).select("query_id", "block", "least")
    due = settle(asked.join(common, ["query_id", "term"]).join(open_, ["query_id", "block"]), "due")
    rare, often = due.where(~F.col("common")), due.where("common")
    room = often.groupBy("query_id", "block").agg(F.sum("most").alias("room"))
    some = _sums(_parts(index, rare, k1, b)).join(room, ["query_id", "block"], "left").join(least, "query_id")
    # what stays open after the other terms: documents that the common terms of their block may still bring there
    some = settle(some.where(F.col("score") + F.coalesce("room", F.lit(0.0)) >= F.col("least")).select("query_id", "block", "id", "score", "first"), "some")
    late = often.join(some.select("query_id", "block").distinct(), ["query_id", "block"])
    more = _sums(_parts(index, late, k1, b).join(some.select("query_id", "block", "id"), ["query_id", "block", "id"], "left_semi"))
    whole = some.unionByName(more).groupBy("query_id", "block", "id").agg(F.sum("score").alias("score"), F.min("first").alias("first"))
    return seeds.unionByName(whole).select("query_id", "id", "score", "first"), [begun, rare, late], asked


def search(index: DataFrame, stats: DataFrame, queries: DataFrame, k: int = CANDIDATES, tokens: Tokens = T.tokens, k1: float = K1, b: float = B, first: int = FIRST) -> DataFrame:
    """(query_id, id, score, rank): bm25.search's rows, from an index that `build` has made."""
    return ranked(_run(index, stats, queries, k, tokens, k1, b, first)[0], k).select("query_id", "id", "score", "rank")


def postings_read(index: DataFrame, stats: DataFrame, queries: DataFrame, k: int = CANDIDATES, tokens: Tokens = T.tokens, k1: float = K1, b: float = B, first: int = FIRST) -> DataFrame:
    """(query_id, held, read): postings of each query's terms in the index, and those that a search reads."""
    _, read, asked = _run(index, stats, queries, k, tokens, k1, b, first)
    rows = asked.select("query_id", F.col("n").alias("held"), F.lit(0).alias("read"))
    for part in read:
        rows = rows.unionByName(part.select("query_id", F.lit(0).alias("held"), F.col("n").alias("read")))
    return rows.groupBy("query_id").agg(F.sum("held").alias("held"), F.sum("read").alias("read"))


def pack(counts: DataFrame, stats: DataFrame, block: int = BLOCK, k1: float = K1, b: float = B) -> DataFrame:
    """(ids, lens, words, heads, blocks, peaks, held, docs, tfs) of `lists.counted`'s rows, in which no id repeats: the
    documents by length; for each word, in how many blocks it is, and these with its peaks; and how many postings it
    has, and these, by places in ids. Peaks hold for these k1 and b. Written."""
    kind = dict(counts.dtypes)["ids"][6:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, lens, words, sizes, term, tf, avgdl = (c[r] for c in batch.columns)
                sizes, term, tf = (np.frombuffer(x.as_buffer(), np.int32) for x in (sizes, term, tf))
                size = lens.values.to_numpy(zero_copy_only=False)
                order = np.argsort(size, kind="stable")
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                doc = place[np.repeat(np.arange(len(sizes)), sizes)]
                by = np.lexsort((doc, term))
                doc, term, tf, size = doc[by], term[by], tf[by], size[order]
                part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[doc] / avgdl.as_py())) if len(doc) else np.zeros(0)
                at = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (doc[1:] // block != doc[:-1] // block)])) if len(doc) else np.zeros(0, np.int64)
                peaks = np.maximum.reduceat(part, at) if len(at) else part
                n = len(words.values)
                arrays = [np.bincount(term[at], minlength=n), doc[at] // block, peaks, np.bincount(term, minlength=n), doc, tf]
                binary = [pa.array([x.astype(np.float64 if x is peaks else np.int32).tobytes()], pa.binary()) for x in arrays]
                listed = [pa.ListArray.from_arrays([0, len(x)], x) for x in (ids.values.take(pa.array(order)), words.values)]
                yield pa.RecordBatch.from_arrays([listed[0], pa.array([size.astype(np.int32).tobytes()], pa.binary()), listed[1], *binary], ["ids", "lens", "words", "heads", "blocks", "peaks", "held", "docs", "tfs"])

    rows = counts.select("ids", "lens", "words", "sizes", "term", "tf").crossJoin(F.broadcast(stats.select("avgdl")))  # one row
    return settle(rows.mapInArrow(run, f"ids array<{kind}>, lens binary, words array<string>, heads binary, blocks binary, peaks binary, held binary, docs binary, tfs binary"), "packed", heavy=True)


def _numbers(words: pa.Scalar, vocabulary: pa.Scalar) -> np.ndarray:
    """Each word's number in the vocabulary, -1 if it isn't there."""
    return pc.fill_null(pc.index_in(words.values, value_set=vocabulary.values), -1).to_numpy(zero_copy_only=False)


def _known(index: DataFrame, blocks: DataFrame) -> DataFrame:
    """(block, term, df): how many documents hold the terms of blocks of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, vocabulary, words, held in zip(*batch.columns, strict=True):
                known = _numbers(words, vocabulary)
                at = np.flatnonzero(known >= 0)
                df = np.frombuffer(held.as_buffer(), np.int32)[at]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block.as_py()), pa.int64()), pa.array(known[at], pa.int32()), pa.array(df, pa.int64())], ["block", "term", "df"])

    wide = index.select("words", "held").crossJoin(blocks.select("block", "vocabulary")).select("block", "vocabulary", "words", "held")  # of blocks
    return wide.mapInArrow(run, "block long, term int, df long").groupBy("block", "term").agg(F.sum("df").alias("df"))


def _bounds(block: lists.Block, n: int, known: np.ndarray, at: np.ndarray, where: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """For each query and each of n blocks of documents the most that a score can be there. known: the numbers of the words
    that are asked for; at: which of them, where and peaks: their heads."""
    out = np.zeros((block.n, n))
    ends = np.searchsorted(at, np.arange(0, len(known) + TERMS, TERMS))
    for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
        part = known[i * TERMS : (i + 1) * TERMS]
        count = block.count[part]
        row = np.repeat(np.arange(len(part)), count)
        entry = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(block.start[part], count)
        weight, most = np.zeros((block.n, len(part))), np.zeros((len(part), n))
        weight[block.query[entry], row] = block.idf[part][row]
        most[at[a:b] - i * TERMS, where[a:b]] = peaks[a:b]
        out += weight @ most
    return out


def _scored(index: DataFrame, weights: DataFrame, k: int, k1: float, b: float, width: int) -> DataFrame:
    """(k1, b, query_id, id, score, first), as `lists.hits` has it: with a
    column floors in weights, of blocks that reach them; without, of each query's most promising block of a row."""
    own = ["ids", "lens", "words", "heads", "blocks", "peaks", "held", "docs", "tfs"]
    columns = [*own, *weights.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, lists.Block] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: x[r] for c, x in zip(columns, batch.columns, strict=True)}
                name = row["block"].as_py()
                if name not in met:
                    met[name] = lists.Block(row, [(k1, b)], k)
                    if "floors" in row:
                        met[name].best[0].least = row["floors"].values.to_numpy(zero_copy_only=False).copy()
                block, best = met[name], met[name].best[0]
                lens, heads, where, held, docs, tfs = (np.frombuffer(row[c].as_buffer(), np.int32) for c in ("lens", "heads", "blocks", "held", "docs", "tfs"))
                number = _numbers(row["words"], row["vocabulary"])
                asked = number >= 0
                if not asked.any():
                    continue
                some = np.repeat(asked, heads)
                at = np.repeat(np.arange(asked.sum()), heads[asked])
                bounds = _bounds(block, -(-len(lens) // width), number[asked], at, where[some], np.frombuffer(row["peaks"].as_buffer())[some])
                if "floors" in row:
                    open_in = bounds >= best.least[:, None] - SLACK
                else:
                    open_in = np.zeros(bounds.shape, bool)
                    open_in[np.arange(block.n), bounds.argmax(1)] = True
                open_in &= bounds > 0
                some = np.flatnonzero(np.repeat(asked, held) & open_in.any(0)[docs // width])
                some = some[np.argsort(docs[some], kind="stable")]
                term = np.repeat(number, held)[some]
                block.score(row["ids"].values, docs[some], lens[docs[some]], term, tfs[some], [(k1, b)], open_in, width)
        for block in met.values():
            yield from block.rows([(k1, b)])

    kinds = dict(index.dtypes)["ids"][6:-1], dict(weights.dtypes)["queries"][6:-1]
    return index.crossJoin(weights).select(*columns).mapInArrow(run, f"k1 double, b double, query_id {kinds[1]}, id {kinds[0]}, score double, first int")  # of blocks


def search_packed(index: DataFrame, stats: DataFrame, queries: DataFrame, k: int = CANDIDATES, tokens: Tokens = T.tokens, block: int = BLOCK, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, id, score, rank): bm25.search's rows, from an index that `pack` has made with these parameters."""
    blocks = lists.query_blocks(query_terms(queries, tokens))
    weights = lists.weights(blocks, _known(index, blocks), stats, idf(F.col("n"), F.col("df"))).join(blocks.select("block", "vocabulary"), "block")
    seeds = settle(_scored(index, weights, k, k1, b, block), "seeds")
    least = ranked(seeds, k).where(F.col("rank") == k).select("query_id", (F.col("score") - SLACK).alias("least"))
    floors = weights.select("block", F.posexplode("queries").alias("pos", "query_id")).join(least, "query_id", "left").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("least", F.lit(0.0)).alias("least")))).alias("f"))  # of a block's queries
    bounded = settle(weights.join(floors.select("block", F.col("f.least").alias("floors")), "block"), "floors")
    return ranked(_scored(index, bounded, k, k1, b, block), k).select("query_id", "id", "score", "rank")


def search_documents(docs: DataFrame, queries: DataFrame, k: int = CANDIDATES, tokens: Tokens = T.tokens) -> DataFrame:
    """The same over documents (id, text), whose packed index is written on the way. Where ids repeat, documents lie in
    several places, and the plain search is taken, which brings them together."""
    counts = counted(docs, tokens)
    if lists.ids_repeat(counts):
        return search_counted(counts, queries, k, tokens)
    stats = settle(counted_statistics(counts), "stats")
    return search_packed(pack(counts, stats), stats, queries, k, tokens)
