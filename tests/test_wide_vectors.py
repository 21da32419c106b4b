"""Wide vectors: texts are embedded once, and tasks hold as many numbers of them as of narrow ones."""

import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lodestone.operators import dense, providers
from lodestone.plans import retrieval
from lodestone.sources.scratch import BATCH, BATCH_BYTES, small_batches

from .conftest import DATA

PLAIN = providers.HashEncoder


class Counting(PLAIN):
    """Notes how many texts each request has."""

    folder = ""

    def encode(self, texts):
        (Path(self.folder) / uuid.uuid4().hex).write_text(str(len(texts)))
        return super().encode(texts)


def first_ten(texts, ids, asked):
    unit = np.array(PLAIN().encode(texts)).astype(float)
    unit = (unit / np.maximum(np.sqrt((unit**2).sum(axis=1)), 1e-300)[:, None]).astype(np.float32).astype(float)
    peak = np.abs(unit).max(axis=1)[:, None]
    codes = np.floor(unit / peak * 127 + 0.5) * (peak / 127).astype(np.float32).astype(float)
    q = np.array(PLAIN().encode(asked)).astype(float)
    q = (q / np.sqrt((q**2).sum(axis=1))[:, None]).astype(np.float32).astype(float)
    score = np.round(q @ codes.T, 9)
    return [set(ids[np.lexsort((ids, -s))[:10]].tolist()) for s in score]


def test_query_prefix_ablation_embeds_every_text_once(spark, tmp_path, monkeypatch):
    encoder = Counting()
    encoder.folder = str(tmp_path)
    monkeypatch.setattr(providers, "HashEncoder", lambda: encoder)
    got = {r["query_id"]: r["shared"] for r in retrieval.query_prefix_ablation(spark, DATA).collect()}
    docs, asked = (pq.read_table(f"{DATA}/{t}.parquet").to_pydict() for t in ("documents", "benchmark"))
    texts, ids = [t or "" for t in docs["text"]], np.array(docs["doc_id"])
    plain = first_ten(texts, ids, asked["text"])
    asked_so = first_ten(texts, ids, [providers.QUERY_PREFIX + t[:512] for t in asked["text"]])
    assert got == {i: len(a & b) / 10 for i, a, b in zip(asked["item_id"], plain, asked_so, strict=True)}
    assert sum(int(f.read_text()) for f in tmp_path.iterdir()) == len(texts) + 2 * len(asked["text"])


def test_tasks_hold_as_many_numbers_of_wide_vectors():
    for width in (4, 64, 384, 4096):
        rows = pa.RecordBatch.from_arrays([pa.array(range(1500)), pa.ListArray.from_arrays(np.arange(1501) * width, pa.array(np.zeros(1500 * width, np.int8)))], ["id", "v"])
        batches = [pa.RecordBatch.from_arrays([rows.column(0), rows.column(0), rows.column(1)], ["id", "scale", "v"])] * 30
        pieces = list(dense._held(iter(batches)))
        assert max(sum(len(b.column(2).flatten()) for b in p) for p in pieces) <= 1 << 21
        assert [i for p in pieces for b in p for i in b.column(0).to_pylist()] == [*range(1500)] * 30
        assert len(pieces) == -(-1500 * 30 // ((1 << 21) // width))


@pytest.mark.parametrize(("kind", "size"), [("tinyint", 1), ("float", 4), ("double", 8)])
def test_groups_hold_vectors_as_they_are(spark, kind, size):
    rows = spark.createDataFrame([(i, 0.5, [i % 100 - 50, i // 10, 3]) for i in range(700)], "id long, scale double, v array<int>").selectExpr("id", "cast(scale as float) as scale", f"cast(v as array<{kind}>) as v")
    seen = {}
    for r in dense._groups(rows).collect():
        assert len(r["flat"]) == len(r["ids"]) * 3 * size
        v, scales = dense._vectors(pa.scalar(r["flat"], pa.binary()), pa.scalar(r["scales"], pa.binary()), 3)
        seen |= dict(zip(r["ids"], map(tuple, dense._scaled(v, scales).tolist()), strict=True))
    assert seen == {i: ((i % 100 - 50) / 2, (i // 10) / 2, 1.5) for i in range(700)}


def test_workers_get_little_at_once(spark):
    def large(batches):
        for batch in batches:
            for _ in range(batch.num_rows):
                yield pa.RecordBatch.from_pydict({"x": [b"x" * (1 << 20)]})

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    before = spark.conf.get(BATCH)
    with small_batches(spark):
        found = spark.range(0, 50, 1, 1).mapInArrow(large, "x binary").mapInArrow(sizes, "n long").collect()
        assert max(r["n"] for r in found) < BATCH_BYTES + (2 << 20)
    assert spark.conf.get(BATCH) == before
    for own, then in (("1m", str(1 << 20)), ("1g", str(BATCH_BYTES))):
        spark.conf.set(BATCH, own)
        try:
            with small_batches(spark):
                assert spark.conf.get(BATCH) == then
            assert spark.conf.get(BATCH) == own
        finally:
            spark.conf.set(BATCH, before)


def test_heavy_tables_and_ranks_are_written_in_small_batches(spark, monkeypatch):
    """What a pair of a group and a block of queries goes through."""
    seen, plain = {}, dense.settle

    def settle(df, name, heavy=False):
        seen[name] = (heavy, int(spark.conf.get(BATCH).rstrip("b")) <= BATCH_BYTES)
        return plain(df, name, heavy)

    monkeypatch.setattr(dense, "settle", settle)
    rows = spark.range(60).selectExpr("id", "cast(array(id, 1, 2) as array<float>) as embedding")
    assert dense.search_int8(rows, rows.where("id < 3").withColumnRenamed("id", "query_id"), 5).count() == 15
    assert {n: x[0] for n, x in seen.items() if n in ("vector-groups", "query-vectors")} == {"vector-groups": True, "query-vectors": True}
    assert seen["query-vectors"][1] and seen["ranks"][1]
