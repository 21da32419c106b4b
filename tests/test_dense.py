"""Pruned dense search: exact on clustered, even and equal vectors, and blocks are skipped where vectors cluster."""

import numpy as np
import pytest

from lodestone.operators import dense


def frames(spark, v, every):
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<float>").repartition(5)
    return rows, rows.where(f"id % {every} = 0").withColumnRenamed("id", "query_id")


def plain(v, every, k):
    u = v.astype(np.float32)
    u = (u / np.sqrt((u.astype(float) ** 2).sum(axis=1))[:, None]).astype(np.float32).astype(float)
    out = {}
    for q in range(0, len(v), every):
        s = np.round(u @ u[q], 9)
        out[q] = np.lexsort((np.arange(len(v)), -s))[:k].tolist()
    return out


def clustered(n, centres, noise):
    r = np.random.default_rng(1)
    c = r.normal(size=(centres, 32))
    return c[r.integers(centres, size=n)] + noise * r.normal(size=(n, 32))


@pytest.mark.parametrize(("n", "centres", "noise"), [(6000, 12, 0.2), (1500, 1500, 0.0), (900, 3, 0.0)])
def test_ranks_equal_numpy(spark, n, centres, noise):
    v = clustered(n, centres, noise)
    vectors, queries = frames(spark, v, 50)
    got = {}
    for r in dense.search_float(vectors, queries, 10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got == plain(v, 50, 10)


def test_most_blocks_are_skipped_where_vectors_cluster(spark):
    met, scored = dense.pairs_scored(*frames(spark, clustered(6000, 12, 0.2), 50), 10).first()
    assert 0 < 3 * scored < met


def test_blocks_are_small_and_hold_every_row():
    r = np.random.default_rng(2)
    for v in (r.normal(size=(5000, 8)), np.zeros((3000, 4)), clustered(4000, 9, 0.1), r.normal(size=(1, 3))):
        blocks = list(dense.halves(v, 256))
        assert sorted(np.concatenate(blocks).tolist()) == list(range(len(v))) and max(map(len, blocks)) <= 256


def test_fewer_vectors_than_asked_for_and_none(spark):
    vectors, queries = frames(spark, clustered(7, 2, 0.1), 3)
    assert dense.search_int8(vectors, queries, 30).count() == 21
    assert dense.search_int8(vectors.limit(0), queries, 30).count() == 0 == dense.search_int8(vectors, queries.limit(0), 30).count()


def test_blocks_meet_in_groups(spark):
    """What goes to the tasks is a row for a group of blocks and a block of queries, not one for every block."""
    vectors, queries = frames(spark, np.random.default_rng(3).normal(size=(40000, 8)), 20)
    groups = max(dense.TASKS, spark.sparkContext.defaultParallelism)
    pairs = dense._pairs(*dense._units(vectors, queries), 10)
    assert pairs.count() <= groups * queries.rdd.getNumPartitions() < 40000 / dense.BLOCK
    met, scored = dense.pairs_scored(vectors, queries, 10).first()
    assert 0 < scored <= met


def test_equal_scores_go_by_id_in_groups(spark):
    v = np.concatenate([np.tile([[1.0, 2.0, 2.0]], (9000, 1)), clustered(1000, 5, 0.1)[:, :3]])
    vectors, queries = frames(spark, v, 1000)
    got = {}
    for r in dense.search_float(vectors, queries, 10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got == plain(v, 1000, 10)
