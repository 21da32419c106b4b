"""Mixing sources to target weights by balanced sampling with the cube method.

Each source has a weight and shares a budget of words. A document's expected number of copies is its source's target
divided by the source's size; the whole part is taken outright, and the fraction is an inclusion probability. The
cube method moves those probabilities along directions that keep the sums of words and of documents until they are 0
or 1: first within blocks of a source (a block is one group of a Spark shuffle, so a hot source has many), then over
the few fractional rows that blocks leave, then the two that a source leaves are decided by their number of words.

Sources may be many (hosts, say): their order, their targets and their blocks are found in Spark, and only single sums
come to the driver.

Defined cases: a null text has size 0; a null source is a source of its own, the last; a source without words has
target 0 and takes nothing; rows with the same doc_id are kept apart, and only rows equal in all columns, nulls
included, share what they take (they are counted first, and fly as one); an empty table gives an empty result; further
columns only tell rows apart. The same input and seed give the same result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import numbered
from .common import repeated, row_key, settle, whole

#: The sources' weights, by order, again and again.
WEIGHTS = (3.0, 1.0, 2.0)
#: Words of the mix, of all words; most that a source may take, of its own.
SHARE, MOST = 1.5, 2.0
#: Rows in a block of the flight phase, about.
BLOCK_ROWS = 1024


def size_of(text: Column) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+`: starts of words, counted without making them."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))).cast("long")


def placed(sources: DataFrame) -> DataFrame:
    """sources with place: 0, 1, 2, ... in the order of `source`, null last."""
    return numbered(sources, F.col("source").isNull(), F.col("source"))


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources (source, source_size, ...) with target: the budget by weight; a source stops at `most` times its size,
    and what it leaves is shared again by weight. Each round is one sum over the sources."""
    listed = placed(sources).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
    listed = settle(listed.withColumn("limit", most * F.col("source_size")), "mix-weights")
    level, full = 0.0, -1
    while True:  # at a level, sources take level * weight, but for those that reach their limit
        stops = F.col("limit") < level * F.col("weight")
        r = listed.agg(F.sum("source_size").alias("size"), F.count_if(stops).alias("full"), F.sum(F.when(stops, F.col("limit")).otherwise(0.0)).alias("taken"), F.sum(F.when(stops, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if r["full"] == full or not r["open"]:
            break
        full, level = r["full"], (share * r["size"] - r["taken"]) / r["open"]
    return listed.withColumn("target", F.least("limit", level * F.col("weight"))).drop("place", "weight", "limit")


def flight(p: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """Moves probabilities until at most two are fractional, keeping the sums of p and of p * sizes.

    Three fractional rows and two sums leave one direction, the cross product of the constraints' rows. A step either
    way along it ends where one row reaches 0 or 1, and the draw between both keeps every probability's mean. The next
    row then takes that one's place.
    """
    p, draws = p.astype(float).copy(), np.random.default_rng(seed).random(len(p))
    live: list[int] = []
    for k in range(len(p)):
        if p[k] < 1e-9 or p[k] > 1 - 1e-9:
            p[k] = round(p[k])
            continue
        live.append(k)
        if len(live) < 3:
            continue
        a, b, c = (int(sizes[i]) for i in live)
        u = (c - b, a - c, b - a) if not a == b == c else (1, -1, 0)  # sums to 0, and so does u . sizes
        up = min((1 - p[i]) / d if d > 0 else -p[i] / d for i, d in zip(live, u, strict=True) if d)
        down = min(p[i] / d if d > 0 else (p[i] - 1) / d for i, d in zip(live, u, strict=True) if d)
        step = up if draws[k] < down / (up + down) else -down
        for i, d in zip(live, u, strict=True):
            p[i] += step * d
            if p[i] < 1e-9 or p[i] > 1 - 1e-9:
                p[i] = round(p[i])
        live = [i for i in live if 0 < p[i] < 1]
    return p


def _fly(rows: pa.Table) -> pa.Table:
    """Only what the flight needs leaves Arrow: ids never pass through floats."""
    keys = rows.select(["spin", "row_key", "size"]).to_pandas()
    order = keys.sort_values(["spin", "row_key", "size"], kind="stable").index.to_numpy()
    rows = rows.take(pa.array(order))
    seed = rows.column("spin")[0].as_py() & (1 << 62) - 1
    return _with_p(rows, flight(rows.column("p").to_numpy(), rows.column("size").to_numpy(), seed))


def _with_p(rows: pa.Table, p: np.ndarray) -> pa.Table:
    return rows.set_column(rows.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))


def _land(rows: pa.Table) -> pa.Table:
    """After a last flight, the rows still fractional are set to 0 or 1, whichever sums bring the source nearest."""
    rows = _fly(rows)
    p, s = rows.column("p").to_numpy().copy(), rows.column("size").to_numpy()
    left = [i for i in range(len(p)) if 0 < p[i] < 1]
    due = float(sum(p[i] * s[i] for i in left))
    best = min(range(1 << len(left)), key=lambda m: (abs(due - sum(s[i] for j, i in enumerate(left) if m >> j & 1)), m))
    for j, i in enumerate(left):
        p[i] = best >> j & 1
    return _with_p(rows, p)


FLOWN = "row_key binary, doc_id long, source string, size long, n long, source_size long, target double, base long, p double, spin long"


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 42) -> DataFrame:
    """For each different row of docs: row_key, doc_id, size, n (rows that are equal to it), source_size, target, total
    (times that they are taken, together).

    Equal rows fly as one: of n rows with a fraction p, the whole part of n * p is taken outright and the rest is one
    probability, so a row that repeats by the million is one row of a block.
    """
    doc_id, source = F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source")
    rows = docs.select(doc_id, source, size_of(F.col("text").cast("string")).alias("size"), key_of(docs).alias("row_key"))
    rows = rows.groupBy("row_key").agg(F.first(F.struct("doc_id", "source", "size")).alias("r"), F.count("*").alias("n")).select("row_key", "r.*", "n")
    rows = settle(rows, "mix-sizes")
    sums = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.greatest(F.floor(F.count("*") / BLOCK_ROWS), F.lit(1)).alias("blocks"))
    table = settle(targets(sums, weights, share, most).withColumnRenamed("source", "key"), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # a row for each source; Spark knows the table's size and broadcasts it only where that is small
    dealt = rows.join(table.withColumn("rate", rate), F.col("source").eqNullSafe(F.col("key")), "left")
    due = (F.col("rate") - F.floor("rate")) * F.col("n")
    dealt = dealt.withColumn("base", F.col("n") * F.floor("rate").cast("long") + F.floor(due).cast("long")).withColumn("p", due - F.floor(due))
    dealt = dealt.withColumn("spin", F.xxhash64(F.lit(seed), "row_key"))
    kept = ["row_key", "doc_id", "source", "size", "n", "source_size", "target", "base", "p", "spin"]
    dealt = dealt.select(*kept, F.pmod("spin", F.col("blocks")).alias("block"))
    flown = settle(dealt.groupBy("source", "block").applyInArrow(lambda x: _fly(x.drop_columns("block")), FLOWN), "mix-flown")
    done = (F.col("p") <= 0) | (F.col("p") >= 1)
    left = flown.where(~done)
    step = table.agg(F.max("blocks")).first()[0] or 1
    while step > BLOCK_ROWS:  # blocks leave two rows each: as long as they are many, they fly in blocks again
        step = max(1, step // BLOCK_ROWS)
        again = settle(left.withColumn("block", F.pmod(F.xxhash64("spin"), F.lit(step))).groupBy("source", "block").applyInArrow(lambda x: _fly(x.drop_columns("block")), FLOWN), "mix-left")
        flown = flown.where(done).unionByName(again)
        left = again.where(~done)
    landed = left.groupBy("source").applyInArrow(_land, FLOWN)
    total = (F.col("base") + F.col("p").cast("long")).alias("total")
    return flown.where(done).unionByName(landed).select("row_key", "doc_id", "size", "n", "source_size", "target", total)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 42) -> DataFrame:
    """For each row of docs: doc_id, size, source_size, target, copies (times it is taken), taken (copies * size),
    and row_key, which stands for all of the row's columns, and with which docs can be joined."""
    found = mixed(docs, weights, share, most, seed)
    # of n equal rows, some are taken once more than the others
    more = F.col("total") % F.col("n")
    parts = F.array(F.struct(more.alias("times"), F.lit(1).alias("extra")), F.struct((F.col("n") - more).alias("times"), F.lit(0).alias("extra")))
    listed = found.withColumn("part", F.explode(parts)).withColumn("copies", F.floor(F.col("total") / F.col("n")) + F.col("part.extra")).withColumn("times", F.col("part.times"))
    listed = listed.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "row_key", "times")
    return repeated(listed, "times")


def key_of(docs: DataFrame) -> Column:
    """Of all columns, so that only equal rows share it."""
    return row_key(*[docs[f"`{c}`"] for c in docs.columns])


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """docs, each row as many times as the mix takes it; equal rows together."""
    totals = mixed(docs, **options).where("total > 0").select("row_key", "total")
    once = whole(docs, key_of(docs)).dropDuplicates(["key"])  # equal rows are counted in the total
    return repeated(once.join(totals, F.col("key") == F.col("row_key")).select("row", "total"), "total").select("row.*")
