"""Reranking, judging, variants, waterfalls and linked documents against hand-made cases and plain Python."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions import display
from lodestone.operators import html, metrics, rerank
from lodestone.operators.providers import Retryable


@pytest.fixture(scope="module")
def listed(spark):
    fused = spark.createDataFrame([(q, i, r) for q in (1, 2, 3, 4, 5) for r, i in enumerate("abcd", 1)], "query_id long, id string, rank int")
    texts = spark.createDataFrame([("a", "ash"), ("b", ""), ("c", "cedar"), ("d", None), ("e", "elm")], "id string, text string")
    return rerank.candidates(fused, texts)


def test_candidates_without_text_are_dropped(listed):
    assert [[tuple(x) for x in r["items"]] for r in listed.collect()] == [[("a", "ash"), ("c", "cedar")]] * 5


def test_replies(spark, listed):
    raws = {1: '{"response":[{"id":1,"score":0.9},{"id":7,"score":0.8},{"id":0,"score":0.1}]}', 2: '{"response":[]}', 3: '{"response":[{"id":-1,"score":1},{"id":0.5,"score":1},{"score":1},null]}', 4: "no json"}
    replies = spark.createDataFrame([(q, raw, None) for q, raw in raws.items()], "query_id long, raw string, error string")
    found = {}
    for r in rerank.reranked(listed, replies).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["id"], r["score"], r["degraded"]))
    assert found[1] == [("c", 0.9, None), ("a", 0.1, None)]
    for q, reason in ((2, "reranker returned nothing"), (3, "reranker returned no usable indices"), (4, "reranker returned nothing"), (5, "reranker returned nothing")):
        assert found[q] == [("a", 1.0, reason), ("c", 0.5, reason)]


def test_strict_refuses_degraded(spark, listed):
    replies = spark.createDataFrame([(1, None, "quota used up")], "query_id long, raw string, error string")
    with pytest.raises(Exception, match="reranker degraded: quota used up"):
        rerank.reranked(listed.where("query_id = 1"), replies, strict=True).collect()


def test_model_is_asked(spark, listed):
    def by_length(question, texts):
        if question == "bad":
            raise ValueError("model is away")
        return json.dumps({"response": [{"id": i, "score": len(texts[i])} for i in sorted(range(len(texts)), key=lambda i: -len(texts[i]))]})

    questions = spark.createDataFrame([(1, "trees"), (2, "bad")], "query_id long, text string")
    got = rerank.reranked(listed.where("query_id < 3"), rerank.asked(listed, questions, by_length)).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["id"], r["degraded"]) for r in got] == [(1, "c", None), (1, "a", None), (2, "a", "model is away"), (2, "c", "model is away")]


def test_scores(spark):
    raw = [(1, 5, '{"scores":[0, 1, 1.01, "0.5", 0.25]}'), (2, 2, '{"scores":[true]}'), (3, 1, None), (4, 0, '{"scores":[1]}'), (5, 1, '{"scores":"1"}')]
    got = {(r["batch_id"], r["idx"]): r["score"] for r in rerank.scores(spark.createDataFrame(raw, "batch_id long, n int, raw string")).collect()}
    assert got == {(1, 0): 0.0, (1, 1): 1.0, (1, 2): None, (1, 3): None, (1, 4): 0.25, (2, 0): None, (2, 1): None, (3, 0): None, (5, 0): None}


def test_batches_and_verdicts(spark):
    rows = [(1, i, 1, f"s{i}", f"e{i}") for i in range(27)] + [(2, 0, 1, "x" * 1200, "y" * 3000)]
    batches = rerank.batched(spark.createDataFrame(rows, "answer_id long, claim_idx int, n int, sentence string, evidence string"))
    assert sorted((r["answer_id"], r["batch"], len(r["pairs"])) for r in batches.collect()) == [(1, 0, 12), (1, 1, 12), (1, 2, 3), (2, 0, 1)]
    capped = batches.where("answer_id = 2").select(rerank.pair_prompt(F.col("pairs")).alias("p")).first()["p"]
    assert "x" * 1000 in capped and "x" * 1001 not in capped and "y" * 2400 in capped and "y" * 2401 not in capped

    def first(prompt):
        raise Retryable("quota used up")

    def second(prompt):
        if "s12" in prompt:
            raise ValueError("too long")
        return json.dumps({"verdicts": [{"index": i, "label": "supported" if i else "not_supported"} for i in range(prompt.count("[pair "))]})

    named = batches.where("answer_id = 1").withColumnRenamed("batch", "batch_id").select("batch_id", "pairs")
    got = {(r["batch_id"], r["idx"]): (r["score"], r["model"], r["degraded"]) for r in rerank.entail(named, [("one", first), ("two", second)], sleep=lambda s: None).collect()}
    assert len(got) == 27
    assert got[0, 0] == (0.0, "two", None) and got[0, 11] == (1.0, "two", None) and got[2, 2][0] == 1.0
    assert got[1, 0] == (None, None, "one: quota used up · two: too long")


def test_variants(spark):
    rows = [("g:a", q, k, v, v, v, v) for q, (k, v) in enumerate([("identifier", 1.0), ("identifier", 0.0), ("conceptual", 0.5), ("refusal", 0.0)])]
    scores = spark.createDataFrame(rows, "retriever string, query_id long, kind string, recall_10 double, success_5 double, mrr double, ndcg_10 double")
    got = metrics.by_variant(scores)
    r = got.first()
    assert (r["group"], r["variant"], r["n"], r["recall_10"], r["identifier"], r["conceptual"]) == ("g", "g:a", 3, 0.5, 0.5, 0.5)
    line = metrics.variant_lines(got, metrics.variant_intervals(scores)).first()["line"]
    assert line == "| g:a | 50.0% (0–100) | 50.0% (0–100) | 0.500 | 0.500 | 50.0% | 50.0% |"


def test_waterfall(spark):
    rows = [(u, t, float(v)) for t, (u, v) in enumerate([("a", 3), ("b", 2), ("a", -1), (None, 5), ("a", 4), ("a", 2), (None, 1)])] + [("a", 9, None), ("z", 1, 0.0)]
    got = display.waterfall(spark.createDataFrame(rows, "u string, t int, v double").repartition(3), "v", ("u",), ("t",)).collect()
    expected = set()
    for u in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == u), key=lambda x: x[1])
        total, before = sum(x[2] or 0 for x in own), 0.0
        for x in own:
            expected.add((u, x[1], before, None if x[2] is None or not total else round(x[2] / total, 9)))
            before += x[2] or 0
    assert {(r["u"], r["t"], r["start"], None if r["share"] is None else round(r["share"], 9)) for r in got} == expected
    assert len(got) == len(rows)
    empty = spark.createDataFrame([], "u string, t int, v double")
    assert display.waterfall(empty, "v", ("u",), ("t",)).collect() == []


def test_linked_documents(spark):
    pages = spark.createDataFrame([('<a href="https://x.example/help/focus-order.html">1</a><a href="https://x.example/help/focus-order.html">2</a>',), ('<a href="https://x.example/help/labels.html#top">3</a>',), (None,)], "html string")
    got = html.linked_documents(pages, r"(https://x\.example/help/[a-z-]+\.html)", "help").collect()
    assert sorted(map(tuple, got)) == [("help/focus-order", "https://x.example/help/focus-order.html"), ("help/labels", "https://x.example/help/labels.html")]
