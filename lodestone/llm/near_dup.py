"""Near-duplicate documents by b-bit MinHash.

Words are lower-cased (A-Z) runs without ASCII white space; a document's set holds its distinct 5-word shingles, or
the whole sequence if it has fewer words. Documents whose sets' Jaccard similarity reaches the threshold are linked,
and a component's smallest doc_id names it.

1. One pass signs each text: minima of HASHES hash functions; BANDS hashes of ROWS minima each; and the low BITS bits
   of each minimum, packed. At 0.85 the chance that no band agrees is below 1e-7, at any number of documents.
2. In each bucket (a band's hash) every document is paired with the smallest one: as many pairs as rows. The packed
   signatures' bit counts, corrected for chance agreement, drop pairs far below the threshold; the rest are confirmed
   on the full sets of words, never on hashes.
3. Buckets whose documents then belong to several components may hide links between two documents neither of which
   is the smallest. Their documents go through an exact join: two sets can only reach the threshold if they share one
   of their rarest shingles, at places that leave room for enough others. Only pairs of different components that
   pass are made, and they are confirmed as before.

Texts of the same words are one class, which has a number and is signed, paired and linked once, whatever its rows'
doc_ids; doc_ids only come back when components are named. Components are found by alternating large-star and
small-star rounds, written to the shared folder in between.

Defined cases: a null, empty or white text has an empty set and no link, and is named by its own doc_id; different texts
of one doc_id are texts of one document, so what resembles any of them is linked with it; a null doc_id links nothing by
itself, and such a row is named by the smallest doc_id that it is linked with, null if none; rows that repeat each get
the same answer; an empty table gives an empty result; further columns are ignored; texts of any length count whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, settle, slices, whole

SHINGLE = 5
BANDS, ROWS, BITS = 24, 4, 4
HASHES = BANDS * ROWS
#: Documents are linked from so many percent on.
PERCENT = 85

U64 = np.uint64
_rng = np.random.default_rng(20240607)
MULTIPLIERS = _rng.integers(0, 1 << 63, HASHES, dtype=U64) * U64(2) + U64(1)
OFFSETS = _rng.integers(0, 1 << 63, HASHES, dtype=U64)
BAND_MIX = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=U64) * U64(2) + U64(1)
PLACE = _rng.integers(0, 1 << 63, SHINGLE, dtype=U64) * U64(2) + U64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over 64."""
    x = (x ^ (x >> U64(31))) * U64(0x9E3779B97F4A7C15)
    return x ^ (x >> U64(29))


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    """The full set, of words themselves."""
    if len(words) < SHINGLE:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(SHINGLE)), strict=False))


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """Distinct 64-bit hashes of the set, ascending."""
    if not words:
        return np.empty(0, dtype=U64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=U64, count=len(words))
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b"\n".join(words))], dtype=U64)
    n = len(w) - SHINGLE + 1
    h = w[:n] * PLACE[0]
    for i in range(1, SHINGLE):
        h = mixed(h) + w[i : i + n] * PLACE[i]
    return np.unique(mixed(h))


def minima(hashes: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, ~U64(0))
    for i in range(0, len(hashes), 512):
        np.minimum(out, (MULTIPLIERS[:, None] * hashes[None, i : i + 512] + OFFSETS[:, None]).min(axis=1), out=out)
    return out


def signature(hashes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Hashes of the bands, and the packed low bits of the minima's upper halves."""
    m = minima(hashes) >> U64(24)
    bands = mixed((mixed(m).reshape(BANDS, ROWS) * BAND_MIX).sum(axis=1, dtype=U64))
    low = (m & U64((1 << BITS) - 1)).astype(np.uint8).reshape(-1, 2)
    return bands.view(np.int64), (low[:, 0] | low[:, 1] << 4).astype(np.uint8).tobytes()


def estimate(a: bytes, b: bytes) -> float:
    """Similarity from packed signatures: the part of equal lanes by bit counts, corrected for lanes equal by chance."""
    x = int.from_bytes(a, "little") ^ int.from_bytes(b, "little")
    ones = int.from_bytes(b"\x11" * len(a), "little")
    differ = ((x | x >> 1 | x >> 2 | x >> 3) & ones).bit_count()
    chance = 1 / (1 << BITS)
    return max(0.0, (1 - differ / HASHES - chance) / (1 - chance))


def sign(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, row_key (of doc_id and text), text_key (128 bits of its words), n_shingles,
    bands, bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            keys, counts, bands, bits = [], [], [], []
            for text in texts:
                words = words_of(text)
                hashes = shingle_hashes(words)
                keys.append(hashlib.blake2b(b"\n".join(words), digest_size=16).digest())
                counts.append(len(hashes))
                b, s = signature(hashes) if len(hashes) else ([], b"")
                bands.append(b)
                bits.append(s)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.binary())], ["doc_id", "row_key", "text_key", "n_shingles", "bands", "bits"])

    return keyed(docs).mapInArrow(run, "doc_id long, row_key binary, text_key binary, n_shingles long, bands array<long>, bits binary")


def keyed(docs: DataFrame) -> DataFrame:
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(doc_id.alias("doc_id"), row_key(doc_id, text).alias("row_key"), text.alias("text"))


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets reach the threshold."""

    #: Under the true similarity's estimate by six standard deviations: less than 1e-8 of true pairs fall below.
    floor = percent / 100 - 6 * (percent / 100 * (1 - percent / 100) / HASHES) ** 0.5 - 0.02

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # texts become Python objects a few at a time
                part, keep = batch.slice(at, 256), []
                for a, x, y, s, t in zip(*(part.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True):
                    if estimate(s, t) < floor:
                        keep.append(False)
                        continue
                    if a != last:
                        last, held = a, shingles(words_of(x))
                    other = shingles(words_of(y))
                    keep.append(100 * (i := len(held & other)) >= percent * (len(held) + len(other) - i))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("node").alias("a"), F.col("text").cast("binary").alias("text_a"), F.col("bits").alias("bits_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").cast("binary").alias("text_b"), F.col("bits").alias("bits_b"))
    wide = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b", "bits_a", "bits_b")
    return wide.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (a, b): the smallest node reachable. Alternating large and small stars."""
    edges = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that both sides of the join are plain exchanges and Spark can split a hub's rows
        least = settle(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = settle(large, "large")
        least = settle(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new = settle(small, "edges")
        sums = [x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (edges, new)]
        edges = new
        if sums[0] == sums[1]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def rare_first(texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may reach the threshold: an exact join on rare shingles. Sizes that
    cannot match never meet: the key holds a class of sizes, and the smaller set joins its own and the next one."""
    cells = 1 << 19  # of the table of counts: its size is fixed, whatever the input

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(cells, dtype=np.int64)
        for _, bodies in slices(batches, "text"):
            for text in bodies:
                np.add.at(seen, (shingle_hashes(words_of(text)) >> U64(45)).astype(np.int64), 1)
        full = np.flatnonzero(seen)
        for i in range(0, len(full), 1 << 16):
            part = full[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(seen[part])], ["cell", "n"])

    counted = texts.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    table = np.zeros(cells, dtype=np.int64)
    found = counted.toArrow()
    table[found.column(0).to_numpy()] = found.column(1).to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast(table)

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bodies in slices(batches, "text"):
            for node, component, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), bodies, strict=True):
                h = shingle_hashes(words_of(text))
                n = len(h)
                often = shared.value[(h >> U64(45)).astype(np.int64)]
                order = np.lexsort((h, often))[: n - -(-percent * n // 100) + 1]
                place = np.arange(len(order), dtype=np.int32)
                first = place < n - -(-2 * percent * n // (100 + percent)) + 1
                several = often[order] > 1  # else no other document has it
                k = int(several.sum())
                yield pa.RecordBatch.from_arrays([pa.array(h[order][several].view(np.int64)), pa.array([node] * k, pa.int64()), pa.array([component] * k, pa.int64()), pa.array([n] * k, pa.int64()), pa.array(place[several]), pa.array(first[several])], ["h", "id", "comp", "n", "place", "first"])

    rows = texts.select("node", "component", "text").mapInArrow(prefix, "h long, id long, comp long, n long, place int, first boolean")
    # sets that match lie in the same or in the next class, with a little room for rounding
    rows = settle(rows.withColumn("size", F.floor(F.log(F.col("n").cast("double")) / math.log(1.001 * 100 / percent)).cast("int")), "rare")
    a = rows.where("first").withColumn("size", F.explode(F.array(F.col("size"), F.col("size") + 1))).alias("a")
    b = rows.alias("b")
    fits = (F.col("a.h") == F.col("b.h")) & (F.col("a.size") == F.col("b.size")) & (F.col("a.comp") != F.col("b.comp")) & ((F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.id") < F.col("b.id")))) & (100 * F.col("a.n") >= percent * F.col("b.n"))
    room = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place"))
    fits = fits & ((100 + percent) * room >= percent * (F.col("a.n") + F.col("b.n")))
    return a.join(b, fits).select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct()


def grouped(docs: DataFrame, percent: int, by_id: bool) -> tuple[DataFrame, DataFrame]:
    """(signed rows, classes): classes (text_key, component, component_id) of all texts with words, component_id being
    the smallest doc_id of the component. by_id: texts of one doc_id are linked too."""
    signed = settle(sign(docs), "signed")
    some = signed.where("n_shingles > 0")
    # numbered in the order of their smallest doc_ids, which are the likeliest originals and so the stars' centres; once
    # they are written, a class's number never changes
    one = some.groupBy("text_key").agg(F.min("doc_id").alias("rep"), F.first(F.struct("row_key", "bands", "bits")).alias("s"))
    order = (F.coalesce("rep", F.lit((1 << 63) - 1)), F.col("text_key"))
    classes = settle(one.select("text_key", "rep", "s.*").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id()), "classes")
    rows = classes.select("node", F.explode("bands").alias("bucket"))
    least = settle(rows.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("bucket", "least"), "least")
    members = settle(rows.join(least, "bucket").select("bucket", "node", "least"), "members")
    stars = members.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    # the texts of classes that share a bucket with another, once
    wanted = members.select("node").distinct()
    chosen = classes.join(wanted, "node").select("node", "row_key", "bits")
    texts = settle(keyed(docs).join(chosen, "row_key").select("node", "text", "bits").dropDuplicates(["node"]), "texts")
    links = settle(confirm(stars, texts, percent), "links")
    joined = components(links)
    # buckets that several components still share
    of = members.join(joined, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    of = settle(of, "of")
    split = settle(of.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("bucket"), "split")
    open_ = of.join(split, "bucket").select("node", "component").distinct()
    more = rare_first(settle(texts.join(open_, "node").select("node", "component", "text"), "open"), percent)
    late = settle(confirm(more, texts, percent), "links")
    edges = links.unionByName(late)
    if by_id:
        several = some.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
        own = settle(some.join(several, "doc_id").select("doc_id", "text_key").join(classes.select("text_key", "node"), "text_key").select("doc_id", "node").distinct(), "own")
        edges = edges.unionByName(own.join(own.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").where("node <> a").select("a", F.col("node").alias("b")))
    joined = components(edges)
    linked = joined.join(classes.select("node", "rep"), "node")
    names = linked.groupBy("component").agg(F.min("rep").alias("name"))
    named = linked.join(names, "component").select("node", "component", "name")
    wide = classes.select("text_key", "rep", "node").join(named, "node", "left")
    return signed, wide.select("text_key", F.coalesce("component", "node").alias("component"), F.when(F.col("component").isNull(), F.col("rep")).otherwise(F.col("name")).alias("component_id"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id, kept."""
    signed, classes = grouped(docs, percent, True)
    out = signed.select("doc_id", "text_key", "n_shingles").join(classes, "text_key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs, one row of each group of near-duplicate texts: that of the smallest doc_id, of several the one of the least
    key; a group without any doc_id keeps a row too. Different texts of one doc_id are no group here. Texts without
    words all stay, but of rows equal in doc_id and text, in either case, one does."""
    signed, classes = grouped(docs, percent, False)
    rows = signed.select("doc_id", "row_key", "text_key").join(classes, "text_key", "left")
    first = rows.where(F.col("component").isNotNull() & F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min("row_key").alias("key"))
    kept = first.select("key").unionByName(rows.where("component IS NULL").select(F.col("row_key").alias("key"))).distinct()
    own = whole(docs, row_key(docs["doc_id"].cast("long"), docs["text"].cast("string")))
    return own.join(kept, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
