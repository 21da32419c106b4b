"""The packed index gives the plain search's rows, and its bounds hold and close blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import blockmax, bm25, lists


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(14)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [(i, " ".join(r.choices(words, weights, k=r.choice([3, 10, 30, 80])))) for i in range(700)] + [(1000, ""), (1001, None), (1002, "w0 w0 w0"), (1003, "w0 w0 w0")]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    queries = spark.createDataFrame([(q, " ".join(r.choices(words, weights, k=r.randrange(1, 9)))) for q in range(270)] + [(900, "absent"), (901, ""), (902, "w0"), (903, "w299 w0 w1")], "query_id long, text string")
    return docs, queries


def rows(found):
    return {(r["query_id"], r["id"]): (round(r["score"], 8), r["rank"]) for r in found.collect()}


@pytest.mark.parametrize("k", [3, 30])
def test_rows_equal_the_plain_search(texts, k):
    docs, queries = texts
    want = rows(bm25.scored(bm25.matches(docs, queries), k))
    assert want and rows(blockmax.search_documents(docs, queries, k)) == want


def test_ids_that_repeat_are_one_document(texts):
    docs, queries = (x.withColumn(c, F.col(c) % 100) if c == "id" else x.where("query_id < 20") for x, c in zip(texts, ("id", ""), strict=True))
    assert rows(blockmax.search_documents(docs, queries, 10)) == rows(bm25.scored(bm25.matches(docs, queries), 10))


def test_bounds_hold_and_close_blocks(texts):
    docs, queries = texts
    queries = queries.where("query_id >= 900 OR query_id < 5")
    counts = bm25.counted(docs.coalesce(1))
    stats = bm25.counted_statistics(counts)
    index = blockmax.pack(counts, stats, 4)
    blocks = lists.query_blocks(bm25.query_terms(queries))
    weights = lists.weights(blocks, blockmax._known(index, blocks), stats, bm25.idf(F.col("n"), F.col("df"))).join(blocks.select("block", "vocabulary"), "block").toArrow()
    block = lists.Block({c: weights[c][0] for c in weights.column_names}, [(bm25.K1, bm25.B)], 5)
    row = index.toArrow()
    heads, where, lens = (np.frombuffer(row[c][0].as_buffer(), np.int32) for c in ("heads", "blocks", "lens"))
    number = blockmax._numbers(row["words"][0], weights["vocabulary"][0])
    asked = number >= 0
    some, at = np.repeat(asked, heads), np.repeat(np.arange(asked.sum()), heads[asked])
    bounds = blockmax._bounds(block, -(-len(lens) // 4), number[asked], at, where[some], np.frombuffer(row["peaks"][0].as_buffer())[some])
    assert (np.diff(lens) >= 0).all()
    place = {i: n // 4 for n, i in enumerate(row["ids"][0].as_py())}
    names = weights["queries"][0].as_py()
    scored = bm25.scored(bm25.matches(docs, queries), 10**6).collect()
    assert all(bounds[names.index(r["query_id"]), place[r["id"]]] >= r["score"] - 1e-9 for r in scored)
    tenth = {r["query_id"]: r["score"] for r in scored if r["rank"] == 10}
    open_ = sum((bounds[names.index(q)] >= s).sum() for q, s in tenth.items())
    assert 2 * open_ < len(tenth) * bounds.shape[1]
