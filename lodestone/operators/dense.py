"""Exact dense search: a set of query vectors against all vectors, in blocks that are skipped where they can't matter.

Vectors that lie near each other are brought together: they are dealt out in ranges of the signs of a few fixed
projections (and of ids, so equal vectors by the million are many tasks), and a task cuts what it holds into blocks around
pivots, halving the widest until blocks are small. A block knows its centre and its radius, so no vector in it can score
more with a query than the centre does, plus radius times the query's length. Blocks that lie together are a group, which
is written as one row, and queries go in blocks, too. A task goes through pairs of a group and a block of queries, the
most promising first, keeps each query's best k scores, and scores a block only for queries whose k-th score it may reach;
where most are open, the group is scored as one product. A first pass over centres alone gives every query a floor under
its k-th score, so that tasks without good blocks skip all of theirs. No pair of single vectors is ever a row.

How much is skipped depends on the vectors: where they cluster, most pairs of queries and blocks (`pairs_scored` counts
them); where they lie evenly on a sphere of many dimensions, no bound of this kind helps, and all are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.scratch import settle, small_batches
from .bm25 import CANDIDATES, ranked

#: Rows of a block at most, numbers that a task cuts into blocks at once (of vectors of any width, as it holds several
#: copies of them in 64 bits), signs that name a cell, and tasks that vectors are dealt to (or as many as there are cores, if
#: these are more): k rows a query leave each of them.
BLOCK, HELD, SIGNS, TASKS = 256, 1 << 21, 12, 24
#: Numbers of a group of blocks, about; numbers and rows of a block of queries at most; rows found before they are cut to
#: each query's best; part of pairs of a query and a block from which a group is scored as one.
GROUP, ASKED, QUERIES, KEPT, MOST = 1 << 18, 1 << 16, 1024, 1 << 16, 0.5
#: Blocks of twice LEAST rows and more are split on if all parts then have at most GAIN of the radius.
LEAST, GAIN = 16, 0.8
#: Room for rounding in bounds on scores.
SLACK = 1e-8


def radius_of(x: np.ndarray) -> float:
    return float(np.sqrt(((x - x.mean(axis=0)) ** 2).sum(axis=1).max(initial=0)))


def split(x: np.ndarray) -> np.ndarray:
    """Which rows are nearer to the row farthest from the mean than to the row farthest from that one; the half that
    leans to it where that would leave one part nearly empty (equal rows, say)."""
    a = x[np.argmax(((x - x.mean(axis=0)) ** 2).sum(axis=1))]
    b = x[np.argmax(((x - a) ** 2).sum(axis=1))]
    lean = x @ (a - b)
    nearer = lean > (a @ a - b @ b) / 2
    if not 0.05 < nearer.mean() < 0.95:
        nearer = np.zeros(len(x), bool)
        nearer[np.argsort(lean, kind="stable")[len(x) // 2 :]] = True
    return nearer


def narrowed(v: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
    """Parts of a block, if all of them are narrower than the whole by GAIN; else the block."""
    if len(own) < 2 * LEAST:
        return [own]
    nearer = split(v[own])
    parts = narrowed(v, own[nearer]) + narrowed(v, own[~nearer])
    return parts if max(radius_of(v[p]) for p in parts) <= GAIN * radius_of(v[own]) else [own]


def halves(v: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Places of the rows of v, in blocks of at most `most` rows that lie near each other."""
    stack = [np.arange(len(v))]
    while stack:
        own = stack.pop()
        if len(own) > most:
            nearer = split(v[own])
            stack += [own[nearer], own[~nearer]]
        else:
            yield from narrowed(v, own)


def _numbers(rows: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, v as they are, scales, floors) of rows (id, scale, v, floor)."""
    t = pa.Table.from_batches(rows).combine_chunks()
    ids, scales, floors = (t.column(i).to_numpy() for i in (0, 1, 3))
    lists = t.column(2).combine_chunks()
    widths = np.unique(lists.value_lengths().to_numpy(zero_copy_only=False))
    if len(widths) > 1:
        raise ValueError(f"vectors have widths {', '.join(map(str, widths))}")
    return ids, lists.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1), scales, floors


def _scaled(v: np.ndarray, scales: np.ndarray) -> np.ndarray:
    """In 64 bits."""
    return np.multiply(v, scales.astype(np.float64)[:, None], dtype=np.float64)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of batches, cut to HELD numbers at most where a vector has no more."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        most, at = max(1, HELD * batch.num_rows // max(1, len(batch.column(2).flatten()))), 0
        while at < batch.num_rows:
            held.append(batch.slice(at, max(1, most - rows)))
            at, rows = at + held[-1].num_rows, rows + held[-1].num_rows
            if rows >= most:
                yield held
                held, rows = [], 0
    if rows:
        yield held


def _bytes(x: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes()], pa.binary())


def _list(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays([0, len(x)], pa.array(x, kind))


def _groups(rows: DataFrame) -> DataFrame:
    """Rows (id, scale, v) in blocks of near ones, and these in groups: ids, sizes of the blocks, all v as they are, their
    scales, and centres and radii as 64-bit numbers. Written."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            found = []
            for v in batch.column(2):
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) if v.is_valid else np.zeros(0)
                plane = planes.setdefault(len(x), np.random.default_rng(len(x)).normal(size=(SIGNS, len(x))))
                found.append(int(((plane @ x > 0) << np.arange(SIGNS)).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], names=[*batch.schema.names, "cell"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(blocks: list[np.ndarray]) -> pa.RecordBatch:
            rows = np.concatenate(blocks)
            lists = [_list(ids[rows], pa.int64()), _list(np.array([len(own) for own in blocks]), pa.int32())]
            centres, radii = np.array([v[own].mean(axis=0) for own in blocks]), np.array([radius_of(v[own]) for own in blocks])
            return pa.RecordBatch.from_arrays([*lists, *map(_bytes, (raw[rows], scales[rows], centres, radii))], ["ids", "sizes", "flat", "scales", "centres", "radii"])

        for held in _held(batches):
            ids, raw, scales, _ = _numbers(held)
            v = _scaled(raw, scales)
            group: list[np.ndarray] = []
            for own in halves(v, BLOCK):
                group.append(own)
                if sum(map(len, group)) * v.shape[1] >= GROUP:
                    yield out(group)
                    group = []
            if group:
                yield out(group)

    n = max(rows.sparkSession.sparkContext.defaultParallelism, TASKS)
    wide = rows.select("id", "scale", "v", F.lit(-np.inf).alias("floor"))
    dealt = wide.mapInArrow(cells, f"id long, scale float, v {dict(rows.dtypes)['v']}, floor double, cell int")
    # ranges, so that cells which share their first signs lie together, and a large cell has several
    near = dealt.repartitionByRange(n, "cell", "id").sortWithinPartitions("cell", "id").select("id", "scale", "v", "floor")
    return settle(near.mapInArrow(pack, "ids array<long>, sizes array<int>, flat binary, scales binary, centres binary, radii binary"), "vector-groups", heavy=True)


def _asked(rows: DataFrame) -> DataFrame:
    """Queries (id, scale, v, floor) in blocks where they lie: q_ids, q_floors, q_flat. Written."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(batches):
            ids, raw, scales, floors = _numbers(held)
            step = max(1, min(QUERIES, ASKED // max(1, raw.shape[1])))
            for at in range(0, len(ids), step):
                own = slice(at, at + step)
                yield pa.RecordBatch.from_arrays([_list(ids[own], pa.int64()), _list(floors[own], pa.float64()), _bytes(_scaled(raw[own], scales[own]))], ["q_ids", "q_floors", "q_flat"])

    return settle(rows.select("id", "scale", "v", "floor").mapInArrow(pack, "q_ids array<long>, q_floors array<double>, q_flat binary"), "query-vectors", heavy=True)


def _matrix(cell: pa.Scalar, rows: int) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), np.float64).reshape(rows, -1)


def _vectors(flat: pa.Scalar, scales: pa.Scalar, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(v as they are, scales) of a group."""
    flat, scales = flat.as_buffer(), np.frombuffer(scales.as_buffer(), np.float32)
    kind = {1: np.int8, 4: np.float32}.get(len(flat) // max(1, len(scales) * width), np.float64)
    return np.frombuffer(flat, kind).reshape(len(scales), width), scales


def _checked(q: np.ndarray, centres: np.ndarray) -> None:
    if centres.shape[1] != q.shape[1]:
        raise ValueError(f"queries have width {q.shape[1]}, vectors {centres.shape[1]}")


class Best:
    """The best k of each query of a block, as far as a task has come."""

    def __init__(self, ids: np.ndarray, floors: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.lengths = np.sqrt((q**2).sum(axis=1))
        self.held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]  # places of queries, ids, scores
        self.size = 0
        self.least = floors - SLACK  # what the k-th score can't be below

    def open(self, centres: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the most that a query can reach in a block, whether that may be enough)."""
        bounds = self.q @ centres.T + self.lengths[:, None] * radii + SLACK * (1 + self.lengths)[:, None]
        return bounds, bounds >= self.least[:, None]

    def add(self, queries: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        score = (self.q if len(queries) == len(self.q) else self.q[queries]) @ x.T
        # a score that rounds to least is in
        reached = score >= self.least[queries, None] - SLACK
        full = np.flatnonzero(reached.sum(axis=1) > 4 * self.k)
        if len(full):  # only what reaches the k-th of these is kept
            kth = np.partition(score[full], len(ids) - self.k, axis=1)[:, len(ids) - self.k]
            self.least[queries[full]] = np.maximum(self.least[queries[full]], np.round(kth, 9))
            reached[full] = score[full] >= self.least[queries[full], None] - SLACK
            for i in full[reached[full].sum(axis=1) > 4 * self.k]:  # many equal scores
                equal = np.flatnonzero(reached[i])
                reached[i] = False
                reached[i, equal[np.lexsort((ids[equal], -np.round(score[i, equal], 9)))[: self.k]]] = True
        at = np.flatnonzero(reached)
        self.held.append((queries[at // len(ids)], ids[at % len(ids)], score.ravel()[at]))
        self.size += len(at)
        if self.size >= max(KEPT, 2 * self.k * len(self.ids)):
            self.cut()

    def cut(self) -> None:
        query, ids, score = (np.concatenate(x) for x in zip(*self.held, strict=True))
        near = np.round(score, 9)
        order = np.lexsort((ids, -near, query))
        place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        last = order[place == self.k - 1]
        self.least[query[last]] = np.maximum(self.least[query[last]], near[last])
        order = order[place < self.k]
        self.held, self.size = [(query[order], ids[order], score[order])], len(order)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query ids, ids, scores)"""
        self.cut()
        query, ids, score = self.held[0]
        return self.ids[query], ids, score


def _task(k: int, batches: Iterator[pa.RecordBatch]) -> tuple[list[Best], int, int]:
    """(the best of each block of queries, pairs of a query and a block met, and of these scored)."""
    known: dict[tuple, Best] = {}
    met = scored = 0
    for batch in batches:
        due = []
        for r in range(batch.num_rows):
            ids, sizes, flat, scales, centres, radii, q_ids, floors, q_flat = (c[r] for c in batch.columns)
            q_ids = q_ids.values.to_numpy(zero_copy_only=False)
            name = (int(q_ids[0]), int(q_ids[-1]), len(q_ids), hash(q_ids.tobytes()))
            if name not in known:
                known[name] = Best(q_ids.copy(), floors.values.to_numpy(zero_copy_only=False), _matrix(q_flat, len(q_ids)).copy(), k)
            best, sizes = known[name], sizes.values.to_numpy(zero_copy_only=False)
            centres = _matrix(centres, len(sizes))
            _checked(best.q, centres)
            radii = np.frombuffer(radii.as_buffer(), np.float64)
            bounds, _ = best.open(centres, radii)
            due.append((float(bounds.max()), best, bounds, ids.values.to_numpy(zero_copy_only=False), sizes, *_vectors(flat, scales, centres.shape[1])))
        for _, best, bounds, ids, sizes, raw, scales in sorted(due, key=lambda d: -d[0]):
            met += bounds.size
            open_ = bounds >= best.least[:, None]
            if open_.mean() > MOST:
                queries, blocks = np.flatnonzero(open_.any(axis=1)), open_.any(axis=0)
                scored += len(queries) * int(blocks.sum())
                if blocks.all():
                    best.add(queries, ids, _scaled(raw, scales))
                else:
                    rows = np.repeat(blocks, sizes)
                    best.add(queries, ids[rows], _scaled(raw[rows], scales[rows]))
                continue
            ends = np.cumsum(sizes)
            for j in np.argsort(-bounds.max(axis=0), kind="stable"):
                queries = np.flatnonzero(bounds[:, j] >= best.least)
                scored += len(queries)
                if len(queries):
                    own = slice(ends[j] - sizes[j], ends[j])
                    best.add(queries, ids[own], _scaled(raw[own], scales[own]))
        # else they stay while the next rows are read
        batch = due = ids = raw = scales = None
    return list(known.values()), met, scored


def _floors(groups: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(id, floor): a score that a query's k-th is not below. All vectors of a block score at least what its centre
    does, less radius times the query's length; the best blocks with k vectors give the floor. Only centres are read."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same: dict[bytes, list[int]] = {}
            for r in range(batch.num_rows):
                same.setdefault(batch.column(4)[r].as_py(), []).append(r)
            for rows in same.values():
                q_ids = batch.column(3)[rows[0]].values.to_numpy(zero_copy_only=False)
                q = _matrix(batch.column(4)[rows[0]], len(q_ids))
                sizes = [batch.column(0)[r].values.to_numpy(zero_copy_only=False) for r in rows]
                centres = np.concatenate([_matrix(batch.column(1)[r], len(n)) for r, n in zip(rows, sizes, strict=True)])
                _checked(q, centres)
                radii = np.concatenate([np.frombuffer(batch.column(2)[r].as_buffer(), np.float64) for r in rows])
                low = q @ centres.T - np.sqrt((q**2).sum(axis=1))[:, None] * radii
                order = np.argsort(-low, axis=1, kind="stable")
                n = np.concatenate(sizes)[order]
                # as many as hold k
                query, place = np.nonzero(np.cumsum(n, axis=1) - n < k)
                at = order[query, place]
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[query], pa.int64()), pa.array(low[query, at]), pa.array(n[query, place], pa.int64())], ["id", "low", "n"])

    met = groups.select("sizes", "centres", "radii").crossJoin(queries.select("q_ids", "q_flat"))  # of groups
    low = met.mapInArrow(least, "id long, low double, n long")
    upto = F.sum("n").over(Window.partitionBy("id").orderBy(F.col("low").desc()).rowsBetween(Window.unboundedPreceding, 0))
    return low.withColumn("upto", upto).groupBy("id").agg(F.coalesce(F.max(F.when(F.col("upto") >= k, F.col("low"))), F.lit(-np.inf)).alias("floor"))


def _pairs(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    return _met(_groups(vectors), queries, k)


def _met(groups: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    none = F.lit(-np.inf)
    floors = _floors(groups, _asked(queries.withColumn("floor", none)), k)
    # queries of one id share the lower floor
    with small_batches(groups.sparkSession):
        own = _asked(queries.join(floors, "id", "left").withColumn("floor", F.coalesce("floor", none)))
    return groups.crossJoin(own)  # of groups


def _search(groups: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for best in _task(k, batches)[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(best.rows(), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "id", "score"])

    found = _met(groups, queries, k).mapInArrow(score, "query_id long, id long, score double")
    # written here, as a pair of a group and a block of queries is a row of up to some megabytes
    with small_batches(groups.sparkSession):
        return settle(ranked(found, k, ties=("id",)).select("query_id", "id", "score", "rank"), "ranks")


def pairs_scored(vectors: DataFrame, queries: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """(met, scored): pairs of a query and a block of vectors that search_float meets, and those it scores."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, met, scored = _task(k, batches)
        yield pa.RecordBatch.from_arrays([pa.array([met], pa.int64()), pa.array([scored], pa.int64())], ["met", "scored"])

    counted = _pairs(*_units(vectors, queries), k).mapInArrow(count, "met long, scored long")
    return counted.agg(F.coalesce(F.sum("met"), F.lit(0)).alias("met"), F.coalesce(F.sum("scored"), F.lit(0)).alias("scored"))


def _unit(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(F.col(name).alias("id"), F.lit(1.0).cast("float").alias("scale"), V.l2_normalize(F.col("embedding")).alias("v"))


def _units(vectors: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _unit(vectors, "id"), _unit(queries, "query_id")


def index_int8(vectors: DataFrame) -> DataFrame:
    """The codes of vectors (id, embedding) in groups, which any number of searches may read. What makes the vectors runs
    once, as codes are written before they are dealt out, which takes reading them twice."""
    coded = vectors.select("id", V.quantize(F.col("embedding")).alias("c")).select("id", "c.scale", F.col("c.codes").alias("v"))
    return _groups(settle(coded, "codes"))


def search_index(index: DataFrame, queries: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """search_int8 over index_int8's groups."""
    return _search(index, _unit(queries, "query_id"), k)


def search_int8(vectors: DataFrame, queries: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """(query_id, id, score, rank): unit queries against codes, times the scale. vectors (id, embedding), queries
    (query_id, embedding)."""
    return search_index(index_int8(vectors), queries, k)


def search_float(vectors: DataFrame, queries: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """The same without codes: the exact baseline."""
    vectors, queries = _units(vectors, queries)
    return _search(_groups(vectors), queries, k)


def agreement(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, shared): the part of two rankings' first k that both have."""
    pairs = a.where(F.col("rank") <= k).select("query_id", "id", F.lit(1).alias("in_a")).join(b.where(F.col("rank") <= k).select("query_id", "id", F.lit(1).alias("in_b")), ["query_id", "id"], "full")
    return pairs.groupBy("query_id").agg((F.count(F.when(F.col("in_a").isNotNull() & F.col("in_b").isNotNull(), 1)) / F.lit(float(k))).alias("shared"))
