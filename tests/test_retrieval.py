"""BM25, dense search, fusion and metrics against hand-made cases and plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import vectors as V
from lodestone.operators import bm25, dense, fuse, metrics

DOCS = [
    ("a", "A lantern on the north pier burns until the harbour pilot returns at dawn."),
    ("b", "Store the spare rope-ladder beside the oldest crate of nails."),
    ("c", "Rule 7.3.12 Lantern Not Doused (Brief) belongs to the second order of watch."),
    ("d", "Every tide table keeps a margin of 2.5 to 1 for the late boats."),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id string, text string")


def ask(spark, docs, text, **options):
    found = bm25.search(docs, spark.createDataFrame([(1, text)], "query_id long, text string"), **options)
    return [(r["id"], r["score"]) for r in found.orderBy("rank").collect()]


@pytest.mark.parametrize(("text", "first"), [("tide margin", "d"), ("pilot", "a")])
def test_best(spark, docs, text, first):
    assert ask(spark, docs, text)[0][0] == first


@pytest.mark.parametrize(("text", "ids"), [("rope-ladder", ["b"]), ("ladder", ["b"]), ("7.3.12", ["c"]), ("submarine", []), ("", [])])
def test_exact_matches(spark, docs, text, ids):
    assert [i for i, _ in ask(spark, docs, text)] == ids


def test_composed_and_decomposed_match(spark):
    docs = spark.createDataFrame([("x", "Cafe\u0301 am Ufer"), ("y", "Tee")], "id string, text string")
    assert [i for i, _ in ask(spark, docs, "caf\u00e9")] == ["x"]


def test_repeated_terms_count_once(spark, docs):
    assert ask(spark, docs, "pilot pilot pilot") == ask(spark, docs, "pilot")


def test_score_formula(spark, docs):
    lengths = {r["id"]: r["len"] for r in bm25.postings(docs).select("id", "len").distinct().collect()}
    avgdl = sum(lengths.values()) / 4
    idf = math.log(1 + (4 - 1 + 0.5) / 1.5)
    assert ask(spark, docs, "pilot")[0][1] == pytest.approx(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * lengths["a"] / avgdl)), abs=1e-10)


def test_explanation_adds_up(spark, docs):
    queries = spark.createDataFrame([(1, "lantern burns submarine")], "query_id long, text string")
    found = bm25.search(docs, queries)
    parts = bm25.explain(docs, queries, found.select("query_id", "id"))
    sums = {r["id"]: r["s"] for r in parts.groupBy("id").agg(F.sum("score").alias("s")).collect()}
    assert {r["id"]: r["score"] for r in found.collect()} == pytest.approx(sums, abs=1e-10)
    assert parts.where("term = 'submarine' and df = 0 and score = 0").count() == found.count()


def test_empty_corpus(spark):
    empty = spark.createDataFrame([], "id string, text string")
    assert bm25.statistics(empty).first().asDict() == {"n": 0, "avgdl": 0.0}
    assert ask(spark, empty, "x") == []


def test_vectors(spark):
    frame = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    unit = [r[0] for r in frame.select(V.l2_normalize(F.col("v"))).collect()]
    assert unit[0] == pytest.approx([0.6, 0.8], abs=1e-7)
    assert unit[1] == [0.0, 0.0]
    codes = [r[0] for r in frame.select(V.quantize(F.col("v"))).collect()]
    assert codes[0]["codes"] == [95, 127]
    assert codes[1]["codes"] == [0, 0]
    assert codes[1]["scale"] == 0.0
    with pytest.raises(Exception, match="width"):
        frame.select(V.of_width(F.col("v"), 3)).collect()


def test_dense_against_numpy(spark):
    rng = np.random.default_rng(3)
    raw = rng.normal(size=(300, 16)).astype(np.float32)
    raw[7] = raw[3]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(raw)], "id long, embedding array<float>")
    queries = vectors.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    exact = {q: np.lexsort((np.arange(300), -np.round(unit.astype(float) @ unit[q].astype(float), 9)))[:10].tolist() for q in range(0, 300, 20)}
    got = {}
    for r in dense.search_float(vectors, queries, 10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got == exact
    shared = dense.agreement(dense.search_int8(vectors, queries, 10), dense.search_float(vectors, queries, 10)).agg(F.avg("shared")).first()[0]
    assert shared >= 0.9


def test_dense_rejects_other_widths(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id long, embedding array<float>")
    with pytest.raises(Exception, match="width"):
        dense.search_float(vectors, queries).collect()


def lists(spark, *rankings):
    rows = [(str(n), 1, i, 0.0, r) for n, ids in enumerate(rankings) for r, i in enumerate(ids, 1)]
    return spark.createDataFrame(rows, "retriever string, query_id long, id string, score double, rank int")


@pytest.mark.parametrize(
    ("rankings", "expected"),
    [([["a", "both"], ["b", "both"]], ["both", "a", "b"]), ([["x", "y"]], ["x", "y"]), ([["b"], ["a"]], ["a", "b"]), ([[], ["a"]], ["a"]), ([], [])],
)
def test_rrf_order(spark, rankings, expected):
    assert [r["id"] for r in fuse.rrf(lists(spark, *rankings)).orderBy("rank").collect()] == expected


def test_rrf_score(spark):
    assert fuse.rrf(lists(spark, ["a"], ["a"])).first()["score"] == pytest.approx(2 / 61, abs=1e-12)


def measured(spark, ranked, grades, kind="identifier"):
    rankings = lists(spark, ranked) if ranked else spark.createDataFrame([("0", 2, "z", 0.0, 1)], lists(spark, ["z"]).schema)
    qrels = spark.createDataFrame([(1, i, g) for i, g in grades.items()], "query_id long, id string, grade int")
    questions = spark.createDataFrame([(1, kind)], "query_id long, kind string")
    return metrics.per_question(rankings, qrels, questions).first().asDict()


def test_metrics(spark):
    m = measured(spark, ["x", "a", "y", "z", "b"], {"a": 2, "b": 2, "c": 2})
    assert m["recall_5"] == pytest.approx(2 / 3)
    assert (m["success_5"], m["mrr"]) == (1.0, 0.5)
    n = measured(spark, ["b", "a"], {"a": 2, "b": 1})["ndcg_10"]
    assert n == pytest.approx((1 / math.log2(2) + 3 / math.log2(3)) / (3 / math.log2(2) + 1 / math.log2(3)), abs=1e-12)
    none = measured(spark, ["x"], {})
    assert (none["recall_5"], none["success_5"], none["ndcg_10"], none["mrr"]) == (1.0, 1.0, 1.0, 1.0)
    missed = measured(spark, [], {"a": 2})
    assert (missed["recall_5"], missed["ndcg_10"], missed["mrr"]) == (0.0, 0.0, 0.0)


def test_term_summary(spark, docs):
    queries = spark.createDataFrame([(1, "lantern burns ladder submarine")], "query_id long, text string")
    hits = bm25.search(docs, queries)
    stats = spark.createDataFrame([(11.4,)], "avgdl double")
    got = {r["id"]: r for r in bm25.term_summary(bm25.explain(docs, queries, hits.select("query_id", "id")), stats).collect()}
    assert (got["a"]["present"], got["a"]["absent"], got["a"]["avgdl"]) == (["burns", "lantern"], ["ladder"], 11)
    assert (got["c"]["present"], got["c"]["absent"]) == (["lantern"], ["burns", "ladder"])
    assert {r["id"]: r["score"] for r in hits.collect()} == pytest.approx({i: r["total"] for i, r in got.items()})


def test_bootstrap_against_plain_python(spark):
    values = [0.0, 0.5, 1.0, 1.0, 0.25]

    def sequence():
        seed = metrics.SEED
        while True:
            seed = (seed + metrics.STEP) & 0xFFFFFFFF
            t = (seed ^ seed >> 15) * (1 | seed) & 0xFFFFFFFF
            t = (t + ((t ^ t >> 7) * (61 | t) & 0xFFFFFFFF) & 0xFFFFFFFF) ^ t
            yield ((t ^ t >> 14) & 0xFFFFFFFF) / 2**32

    draw = sequence()
    means = sorted(sum(values[int(next(draw) * 5)] for _ in range(5)) / 5 for _ in range(2000))
    frame = spark.createDataFrame([("r", i, v) for i, v in enumerate(values)], "retriever string, ord long, value double")
    row = metrics.bootstrap(frame).first()
    assert (row["low"], row["high"]) == pytest.approx((means[50], means[1950]))
    assert row["mean"] == pytest.approx(0.55)
