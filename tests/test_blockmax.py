"""The search over blocks gives the plain search's rows, whatever is left out, and leaves postings out where it can."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import blockmax, bm25


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    rows = [(i, " ".join(r.choices(words, weights, k=r.choice([3, 10, 30, 80])))) for i in range(600)] + [(1000, ""), (1001, "w0 w0 w0"), (1002, "w0 w0 w0")]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(4)
    queries = spark.createDataFrame([(q, " ".join(r.choices(words, weights, k=r.randrange(1, 9)))) for q in range(40)] + [(90, "absent"), (91, ""), (92, "w0"), (93, "w399 w0 w1")], "query_id long, text string")
    stats = bm25.statistics(docs)
    return docs, queries, stats, {n: blockmax.build(bm25.postings(docs), stats, n).cache() for n in (4, 50)}


def rows(found):
    return {(r["query_id"], r["id"]): (round(r["score"], 8), r["rank"]) for r in found.collect()}


@pytest.mark.parametrize(("block", "k", "first"), [(4, 3, 2), (50, 30, 1), (4, 10, 1000)])
def test_rows_equal_the_plain_search(texts, block, k, first):
    docs, queries, stats, index = texts
    assert rows(blockmax.search(index[block], stats, queries, k, first=first)) == rows(bm25.search(docs, queries, k))


def test_an_index_holds_every_posting_and_its_peak(texts):
    docs, _, stats, index = texts
    listed = index[4].select("block", "term", "n", F.explode(F.arrays_zip("ids", "lens", "tfs")).alias("p")).select("term", F.col("p.ids").alias("id"), F.col("p.lens").alias("len"), F.col("p.tfs").alias("tf"))
    assert {tuple(r) for r in listed.collect()} == {(r["term"], r["id"], r["len"], r["tf"]) for r in bm25.postings(docs).collect()}
    assert index[4].where("n <> size(ids) OR n > 4").count() == 0


def test_postings_are_left_out(texts):
    _, queries, stats, index = texts
    held, read = blockmax.postings_read(index[4], stats, queries.where("query_id = 93"), 3, first=4).agg(F.sum("held"), F.sum("read")).first()
    assert 0 < 2 * read < held
