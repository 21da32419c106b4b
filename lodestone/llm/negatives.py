"""Hard negatives for anchors, with bounds along a spanning tree of anchors.

Vectors are quantised to integers and packed into blocks of rows where they lie; anchors are put into groups of near
ones, each with a minimum spanning tree. A pair of a group and a block is one row: every row's score with the tree's
root is computed, and going down the tree, a row's score with a child lies within edge length x the row's norm of its
score (or its bounds) with the parent. Only rows whose bounds overlap what the child looks for are scored again: first
the best rows of its label (bounds below the fifth best lower bound drop out), then, with the positives' scores known,
rows of other labels within the positives' windows. Bounds hold for any vectors; how many rows they save depends on how
near anchors are (README has figures). No pair of single vectors is ever a row, and each pair of group and block leaves
at most `k` rows for each anchor and positive.

Defined cases: rows with a null label, a null vector, or any null or non-finite component take no part; a null vec_id
is no anchor, and follows all others in ties; rows of the same vec_id are rows of their own, and each such anchor mines
for itself; a row meets only anchors of its own width (a vector may be empty: its scores are 0); an anchor without
positives, or without rows in a window, has no rows there; a negative positive score has no window; an empty table gives
an empty result; further columns are ignored. Scores beyond 64 bits aren't defined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, spread

#: Rows of a block; anchors of a group, about; pivots by which groups are near.
BLOCK, GROUP, PIVOTS = 4096, 512, 64


@dataclass(frozen=True)
class Rule:
    """Which rows are anchors, how many positives and negatives each has, and the window in hundredths."""

    anchors: int = 100
    k: int = 5
    low: int = 80
    high: int = 100


def taking_part(rows: DataFrame) -> DataFrame:
    """(vec_id, label, v): quantised vectors of the rows that take part, with their labels as mined."""
    x = F.col("embedding")
    sound = F.col("label").isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    vec_id, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return rows.where(sound).select(vec_id.alias("vec_id"), moved.alias("label"), F.transform(x, lambda c: F.floor(256 * c.cast("double")).cast("long")).alias("v"))


PACKED = pa.schema([("block", pa.int64()), ("width", pa.int32()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("flat", pa.list_(pa.int64()))])
PACKED_DDL = "block long, width int, ids array<long>, labels array<long>, flat array<long>"


def packed(rows: DataFrame) -> DataFrame:
    """Blocks of at most BLOCK rows of one width, made where the rows lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 24
        held: dict[int, list[pa.RecordBatch]] = {}

        def out(width: int) -> pa.RecordBatch:
            nonlocal made
            t = pa.Table.from_batches(held.pop(width)).combine_chunks()
            made += 1
            lists = [pa.ListArray.from_arrays([0, t.num_rows], _one(t.column(i))) for i in (0, 1)]
            flat = _one(t.column(2)).flatten()
            return pa.RecordBatch.from_arrays([pa.array([made - 1], pa.int64()), pa.array([width], pa.int32()), *lists, pa.ListArray.from_arrays([0, len(flat)], flat)], schema=PACKED)

        for batch in batches:
            widths = np.asarray(pa.compute.list_value_length(batch.column(2)))
            for width in np.unique(widths).tolist():
                own = batch.filter(pa.array(widths == width))
                for at in range(0, own.num_rows, BLOCK):
                    piece = own.slice(at, BLOCK)
                    if sum(b.num_rows for b in held.get(width, [])) + piece.num_rows > BLOCK:
                        yield out(width)
                    held.setdefault(width, []).append(piece)
        for width in list(held):
            yield out(width)

    return rows.select("vec_id", "label", "v").mapInArrow(run, PACKED_DDL)


def _one(column: pa.ChunkedArray) -> pa.Array:
    whole = column.combine_chunks()
    return whole if isinstance(whole, pa.Array) else pa.concat_arrays(whole.chunks)


def _matrix(flat: pa.ListScalar, n: int, width: int) -> np.ndarray:
    return flat.values.to_numpy(zero_copy_only=False).reshape(n, width) if width else np.zeros((n, 0), np.int64)


def _ids(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids with nulls as 0, which are null)."""
    return np.asarray(values.fill_null(0)), np.asarray(values.is_null())


def anchors_of(blocks: DataFrame, rule: Rule) -> DataFrame:
    """(block, place, vec_id, label, v) of the anchors in the blocks."""
    schema = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("vec_id", pa.int64()), ("label", pa.int64()), ("v", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                block, width, ids, labels, flat = (c[r] for c in batch.columns)
                number, null = _ids(ids.values)
                at = np.flatnonzero(~null & (number % rule.anchors == 0))
                v = _matrix(flat, len(number), width.as_py())[at]
                yield pa.RecordBatch.from_arrays([pa.array([block.as_py()] * len(at), pa.int64()), pa.array(at, pa.int32()), pa.array(number[at]), labels.values.take(pa.array(at)), pa.array(list(v), pa.list_(pa.int64()))], schema=schema)

    return blocks.mapInArrow(run, "block long, place int, vec_id long, label long, v array<long>")


def tree(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A minimum spanning tree: order (a parent before its children), each one's parent in that order (-1: the root,
    the row nearest to the mean), and the length of the edge, rounded up."""
    v = v.astype(np.float64)
    n = len(v)
    root = int(np.argmin(((v - v.mean(axis=0)) ** 2).sum(axis=1)))
    near, parent, order, edges, parents = np.full(n, np.inf), np.full(n, -1), [root], [0.0], [-1]
    place = {root: 0}
    near[root] = -1.0
    while len(order) < n:
        d = ((v - v[order[-1]]) ** 2).sum(axis=1)
        closer = d < near
        near[closer], parent[closer] = d[closer], order[-1]
        left = np.where(near < 0, np.inf, near)
        k = int(np.argmin(left))
        place[k] = len(order)
        order.append(k)
        parents.append(place[int(parent[k])])
        edges.append(float(np.sqrt(left[k])) * (1 + 1e-9) + 1e-6)
        near[k] = -1.0
    return np.array(order), np.array(parents), np.array(edges)


GROUPED = pa.schema([("group", pa.int64()), ("width", pa.int32()), ("blocks", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("flat", pa.list_(pa.int64())), ("parents", pa.list_(pa.int32())), ("edges", pa.list_(pa.float64()))])
GROUPED_DDL = "group long, width int, blocks array<long>, places array<int>, ids array<long>, labels array<long>, flat array<long>, parents array<int>, edges array<double>"


def groups_of(anchors: DataFrame) -> DataFrame:
    """Anchors in groups of about GROUP that are near the same pivot, each with its tree. A pivot with more has more
    groups, told apart by hashes, so equal anchors by the million are dealt out."""
    pivots = [np.array(r["v"], float) for r in anchors.select("v", F.xxhash64("v", "vec_id", "block", "place").alias("h")).orderBy("h", "v").limit(PIVOTS).collect()]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for v in batch.column(4).to_pylist():
                near.append(min(((float(((p - v) ** 2).sum()), i) for i, p in enumerate(pivots) if len(p) == len(v)), default=(0, -1))[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32())], schema=batch.schema.append(pa.field("pivot", pa.int32())))

    def planted(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        v = np.array(t.column("v").to_pylist(), np.int64).reshape(t.num_rows, -1)
        order, parents, edges = tree(v)
        t = t.take(pa.array(order))
        one = lambda name, kind: pa.ListArray.from_arrays([0, t.num_rows], _one(t.column(name)).cast(kind))
        flat = pa.array(v[order].ravel(), pa.int64())
        # a group is named by the first anchor in it, which no other group has
        name = (t.column("block")[0].as_py() << 12) + t.column("place")[0].as_py()
        columns = [pa.array([name], pa.int64()), pa.array([v.shape[1]], pa.int32()), one("block", pa.int64()), one("place", pa.int32()), one("vec_id", pa.int64()), one("label", pa.int64()), pa.ListArray.from_arrays([0, len(flat)], flat)]
        return pa.Table.from_arrays([*columns, pa.array([parents.tolist()], pa.list_(pa.int32())), pa.array([edges.tolist()], pa.list_(pa.float64()))], schema=GROUPED)

    near = settle(anchors.mapInArrow(nearest, "block long, place int, vec_id long, label long, v array<long>, pivot int").withColumn("width", F.size("v")), "anchors")
    parts = near.groupBy("width", "pivot").agg(F.ceil(F.count("*") / GROUP).alias("parts"))  # a row for each pivot and width
    dealt = near.join(parts, ["width", "pivot"]).withColumn("part", F.pmod(F.xxhash64("block", "place"), F.col("parts")))
    return dealt.groupBy("width", "pivot", "part").applyInArrow(planted, GROUPED_DDL)


def descend(x: np.ndarray, v: np.ndarray, parents: np.ndarray, edges: np.ndarray, wanted: Callable) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each anchor of a tree, in its order: (anchor, rows, their exact scores) of the rows that `wanted` asks for,
    given the anchor and bounds below and above on every row's score."""
    peak = float(np.abs(x).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, x.shape[1])
    kind = np.float64 if peak < 2**52 else np.int64  # either way exact
    xs, vs = x.astype(kind), v.astype(kind)
    # long vectors' norms are rounded up a little, and bounds widened, so that rounding never loses a row
    norms = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)
    slack = 1e-9 * peak + 1e-6
    known: list[tuple[np.ndarray, np.ndarray] | None] = []
    waiting = np.bincount(parents[1:], minlength=len(parents)) if len(parents) > 1 else np.zeros(len(parents), int)
    for i, p in enumerate(parents):
        if p < 0:
            score, radius = (xs @ vs[i]).astype(np.float64), np.zeros(len(x))
            rows = np.flatnonzero(wanted(i, score - slack, score + slack))
        else:
            score, radius = known[p][0], known[p][1] + edges[i] * norms
            waiting[p] -= 1
            if not waiting[p]:
                known[p] = None
            rows = np.flatnonzero(wanted(i, score - radius - slack, score + radius + slack))
        exact = xs[rows] @ vs[i] if 2 * len(rows) < len(x) else (xs @ vs[i])[rows]
        if waiting[i]:
            score, radius = score.copy(), radius.copy()
            score[rows], radius[rows] = exact, 0.0
            known.append((score, radius))
        else:
            known.append(None)
        yield i, rows, exact.astype(np.int64)


def _first(scores: np.ndarray, ids: np.ndarray, null: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: higher scores, then smaller ids, nulls last."""
    at = np.arange(len(scores))
    if len(scores) > 4 * k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], null[at], -scores[at]))][:k]


HITS = pa.schema([("group", pa.int64()), ("anchor", pa.int32()), ("nth", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
HITS_DDL = "group long, anchor int, nth int, vec_id long, score long"


def _hits(group: int, found: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """found: (anchor, nth, ids, which are null, scores)."""
    sizes = [len(f[2]) for f in found]
    ids, null, scores = (np.concatenate([f[i] for f in found]) for i in (2, 3, 4))
    anchor, nth = (np.repeat([f[i] for f in found], sizes).astype(np.int32) for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), group), pa.int64()), pa.array(anchor), pa.array(nth), pa.array(ids, pa.int64(), mask=null), pa.array(scores, pa.int64())], schema=HITS)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """For each pair of block and group of one width: the block's number, ids, nulls, labels, matrix, then the group's
    columns, the last of which are what was joined to it."""
    for batch in batches:
        names = batch.schema.names
        for r in range(batch.num_rows):
            row = {n: c[r] for n, c in zip(names, batch.columns, strict=True)}
            width = row["width"].as_py()
            if width != row["g_width"].as_py():
                continue
            ids, null = _ids(row["ids"].values)
            group = {n: row[f"g_{n}"].values.to_numpy(zero_copy_only=False) for n in ("blocks", "places", "labels", "parents", "edges")}
            yield row, ids, null, row["labels"].values.to_numpy(), _matrix(row["flat"], len(ids), width), group, _matrix(row["g_flat"], len(group["labels"]), width)


def _positives(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, ids, null, labels, x, g, v in _pairs(batches):
            block, found = row["block"].as_py(), []
            own = {int(label): labels == label for label in np.unique(g["labels"])}

            def wanted(i, low, high, own=own, g=g, block=block):
                same = own[int(g["labels"][i])]
                if g["blocks"][i] == block:
                    same = same.copy()
                    same[g["places"][i]] = False
                lows = low[same]
                return same & (high >= np.partition(lows, len(lows) - k)[len(lows) - k]) if len(lows) > k else same

            for i, rows, scores in descend(x, v, g["parents"], g["edges"], wanted):
                best = _first(scores, ids[rows], null[rows], k)
                if len(best):
                    at = rows[best]
                    found.append((i, 0, ids[at], null[at], scores[best]))
            if found:
                yield _hits(row["g_group"].as_py(), found)

    return run


def _negatives(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, ids, null, labels, x, g, v in _pairs(batches):
            due: dict[int, list[tuple[int, int]]] = {}
            for p in row["g_positives"].as_py():
                due.setdefault(p["anchor"], []).append((p["nth"], p["score"]))
            windows = {i: [(n, -(-rule.low * s // 100), rule.high * s // 100) for n, s in p if rule.low * s <= rule.high * s] for i, p in due.items()}
            found = []

            def wanted(i, low, high, windows=windows, labels=labels, g=g):
                own = windows.get(i)
                if not own:
                    return np.zeros(len(labels), bool)
                return (labels != g["labels"][i]) & (high >= min(w[1] for w in own)) & (low <= max(w[2] for w in own))

            for i, rows, scores in descend(x, v, g["parents"], g["edges"], wanted):
                for n, least, most in windows.get(i, ()):
                    inside = np.flatnonzero((scores >= least) & (scores <= most))
                    best = inside[_first(scores[inside], ids[rows[inside]], null[rows[inside]], rule.k)] if len(inside) else inside
                    if len(best):
                        at = rows[best]
                        found.append((i, n, ids[at], null[at], scores[best]))
            if found:
                yield _hits(row["g_group"].as_py(), found)

    return run


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("group", "anchor", "nth").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, embedding, label)."""
    blocks = spread(settle(packed(taking_part(rows)), "vectors"))
    groups = settle(groups_of(anchors_of(blocks, rule)), "groups")

    def named(g: DataFrame) -> DataFrame:
        return g.select(*[F.col(c).alias(f"g_{c}") for c in g.columns])

    # a stated set of queries against all rows: a row for each pair of a block and a group, never of vectors
    met = blocks.crossJoin(named(groups)).mapInArrow(_positives(rule.k), HITS_DDL)
    positives = settle(_ranked(met, rule.k).select("group", "anchor", F.col("rank").alias("nth"), "vec_id", "score"), "positives")
    lists: Column = F.collect_list(F.struct("anchor", "nth", "score")).alias("positives")  # k for each anchor of a group
    due = groups.join(positives.groupBy("group").agg(lists), "group")
    found = _ranked(blocks.crossJoin(named(due)).mapInArrow(_negatives(rule), HITS_DDL), rule.k)
    ids = groups.select("group", F.posexplode("ids").alias("anchor", "anchor_id"))
    out = positives.select("group", "anchor", "nth", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).join(ids, ["group", "anchor"]).join(found, ["group", "anchor", "nth"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
