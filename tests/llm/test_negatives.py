"""Hard negatives against all scores, on odd rows too; trees and bounds by themselves."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import negatives, queries

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType())])
COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def plain(rows):
    """All scores of all anchors with Python's integers."""
    own = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    last, out = 1 << 70, []
    for a, (i, v, label) in enumerate(own):
        if i is None or i % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w)), last if j is None else j, same == label) for b, (j, w, same) in enumerate(own) if b != a and len(w) == len(v))
        for score, positive, _ in [x for x in scored if x[2]][:5]:
            found = [x for x in scored if not x[2] and 80 * -score <= 100 * -x[0] <= 100 * -score][:5]
            out += [(i, positive, n + 1, x[1], -score, -x[0]) for n, x in enumerate(found)]
    return sorted(out)


def found(spark, rows, parts=4):
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in ("v", "block", "width", "rank", "score", "group", "nth", "pivot", "id"):
        frame = frame.withColumn(name, F.lit("x"))
    last = 1 << 70
    return sorted(tuple(last if x is None else x for x in (r[c] for c in COLUMNS)) for r in negatives.mine(frame.repartition(parts)).collect())


def vectors(seed, n, width, centres=12, noise=0.05):
    r = np.random.default_rng(seed)
    c = r.normal(size=(centres, width))
    return [(i, (c[r.integers(centres)] + noise * r.normal(size=width)).tolist(), int(r.integers(4))) for i in range(n)]


@pytest.mark.parametrize(("block", "group"), [(4096, 512), (70, 3)])
def test_random_vectors_equal_the_plain_version(spark, monkeypatch, block, group):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "GROUP", group)
    rows = vectors(1, 1500, 8)
    assert found(spark, rows) == plain(rows)


def test_odd_rows(spark):
    r = random.Random(2)
    rows = [(i * 10, [float(r.randrange(-2, 3)) for _ in range(3)], r.randrange(3)) for i in range(90)]
    rows += [(100 * i, [0.5, 0.25, 0.125], i % 2) for i in range(20, 60)]  # equal anchors, ties everywhere
    rows += [(3001, None, 1), (3002, [1.0, None, 1.0], 1), (3003, [1.0, float("nan"), 1.0], 1), (3004, [1.0, float("inf"), 1.0], 1), (3005, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1)]
    rows += [(4000, [1.0, 2.0], 1), (4001, [1.0, 2.5], 1), (4002, [1.0, 2.0], 2), (4100, [], 0), (4101, [], 0), (4102, [], 3)]
    rows += [(5000, [0.0, 0.0, 0.0], 1), (5100, [-1.0, -1.0, -1.0], 2), (-100, [1.0, 0.5, 0.0], 1), (-7, [1.0, 0.5, 0.1], 2)]
    rows += [(6000, [1.0, 1.5, 0.5], 1)] * 3 + [(6001, [1.0, 1.25, 0.5], 2)] * 3
    assert found(spark, rows) == plain(rows)


def test_large_components_stay_exact(spark):
    r = random.Random(3)
    rows = [(i, [r.randrange(-(10**6), 10**6) * 1.0 for _ in range(4)], r.randrange(3)) for i in range(400)]
    assert found(spark, rows) == plain(rows)


def test_nothing_and_no_anchor(spark):
    assert found(spark, []) == [] and found(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []


def test_trees_span_at_least_cost_and_bounds_save_rows():
    v = np.array([x[1] for x in vectors(4, 60, 6)]) * 256 // 1
    order, parents, edges = negatives.tree(v)
    assert sorted(order.tolist()) == list(range(60)) and parents[0] == -1 and all(p < i for i, p in enumerate(parents))
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
    joined, cost = {0}, 0.0
    while len(joined) < 60:
        w, k = min((d[i, j], j) for i in joined for j in range(60) if j not in joined)
        joined.add(k)
        cost += w
    assert edges.sum() == pytest.approx(cost, rel=1e-6)
    x = (np.array([y[1] for y in vectors(4, 3000, 6)]) * 256 // 1).astype(np.int64)
    a = v[order].astype(np.int64)
    scores, asked = a @ x.T, 0
    least = np.sort(scores, axis=1)[:, -50]

    def wanted(i, low, high):
        assert (low <= scores[i]).all() and (scores[i] <= high).all()
        return high >= least[i]

    for i, rows, exact in negatives.descend(x, a, parents, edges, wanted):
        asked += len(rows)
        assert (exact == scores[i, rows]).all() and set(np.flatnonzero(scores[i] >= least[i])) <= set(rows.tolist())
    assert asked < 0.5 * scores.size


def test_sql_gives_the_same(spark):
    where = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{where}/embeddings.parquet'")
    want = con.sql(queries.OP11_SQL)
    got = queries.op11_anchor_tree_negatives(spark, where).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
