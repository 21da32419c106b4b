"""Quotes, claims, answers and verdicts against hand-made cases."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import answers, verify
from lodestone.plans import evidence

TEXT = "#### Rule 7.3.12 Lantern Not Doused (Brief)\n\nWhile a pilot boat crosses the bar, its lantern is never wholly covered by the crew's own sails."


def test_normal_maps():
    n = verify.Normal("a  b’c")
    assert (n.text, n.starts, n.ends) == ("a b'c", [0, 1, 3, 4, 5], [1, 3, 4, 5, 6])
    n = verify.Normal("a…b")
    assert (n.text, n.starts, n.ends) == ("a...b", [0, 1, 1, 1, 2], [1, 2, 2, 2, 3])
    n = verify.Normal("e\u0301")
    assert (len(n.text), n.starts, n.ends) == (1, [0], [2])
    assert verify.Normal(" \n").text == ""


@pytest.mark.parametrize(
    ("quote", "text", "expected"),
    [
        ("pilot boat\n crosses", TEXT, "pilot boat crosses"),
        ("Pilot boat crosses", TEXT, None),
        ("  ", TEXT, None),
        ("Night Watch: Lamps on the pier burn low;", "Night Watch\n\nLamps on the pier burn low;", "Lamps on the pier burn low;"),
        ("Day Watch: Lamps on the pier burn low;", "Night Watch\n\nLamps on the pier burn low;", None),
        ("don't", "they don’t", "don’t"),
    ],
)
def test_locate(quote, text, expected):
    found = verify.locate(quote, text)
    assert (text[slice(*found)] if found else None) == expected


def frames(spark, claims, chunks):
    c = spark.createDataFrame(claims, "answer_id long, claim_idx int, sentence string, chunk_ids array<string>, quote string")
    k = spark.createDataFrame(chunks, "id string, doc_title string, heading_path array<string>, sc_ref string, text string, char_start int")
    return c, k


def judged(spark, claims, chunks, scores):
    """scores: by chunk."""
    c, k = frames(spark, claims, chunks)

    def judge(pairs):
        table = spark.createDataFrame(list(scores.items()), "cid string, s double")
        return pairs.join(table, F.col("span.chunk_id") == F.col("cid"), "left").withColumn("score", F.col("s")).drop("cid", "s")

    return {r["claim_idx"]: r for r in verify.verify(c, verify.citations(c, k), judge).collect()}


CHUNKS = [("c1", "Doc", ["H"], None, "one fact here", 100), ("c2", "Doc", ["H"], None, "also one fact here", 0), ("c3", "Contrast (Level AAA)", ["H"], "1.4.6", "one fact here", 0)]


@pytest.mark.parametrize(
    ("ids", "scores", "status", "entailment", "chunk"),
    [
        (["c1"], {"c1": 1.0}, "verified", 1.0, "c1"),
        (["c1"], {}, "unverified", None, "c1"),
        (["c1", "c2"], {"c1": 0.0, "c2": 1.0}, "verified", 1.0, "c2"),
        (["c1", "c2"], {"c2": 0.5}, "partial", 0.5, "c2"),
        (["c1", "c2"], {"c1": 0.5, "c2": 0.5}, "partial", 0.5, "c1"),
        (["c1"], {"c1": 7.0}, "unverified", None, "c1"),
        (["missing"], {}, "unsupported", 0.0, None),
        (["c1"], {"c1": 0.2}, "unsupported", 0.2, "c1"),
    ],
)
def test_verify(spark, ids, scores, status, entailment, chunk):
    r = judged(spark, [(1, 0, "s", ids, "one fact")], CHUNKS, scores)[0]
    assert (r["status"], r["entailment"]) == (status, entailment)
    assert (r["span"]["chunk_id"] if r["span"] else None) == chunk
    if chunk == "c1":
        assert (r["span"]["start"], r["span"]["end"]) == (100, 108)


def test_levels_demote(spark):
    claims = [(1, 0, "Text needs contrast.", ["c3"], "one fact"), (1, 1, "At Level AAA it does.", ["c3"], "one fact"), (1, 2, "Under 1.4.6 it does.", ["c3"], "one fact")]
    got = judged(spark, claims, CHUNKS, {"c3": 1.0})
    assert [(got[i]["status"], got[i]["level_omitted"]) for i in range(3)] == [("partial", "AAA"), ("verified", None), ("verified", None)]


def test_statuses_and_metrics(spark):
    claims = [(1, 0, "a", ["c1", "c2", "x", "y"], "fact here"), (1, 1, "a", ["c1"], "nowhere"), (1, 2, "b", ["c1"], "one fact")]
    c, k = frames(spark, claims, CHUNKS)
    v = verify.verify(c, verify.citations(c, k), lambda p: p.withColumn("score", F.lit(1.0)))
    said = spark.createDataFrame([(1, i, s) for i, s in enumerate("abcd")] + [(2, 0, "z")], "answer_id long, pos int, sentence string")
    status = verify.sentence_status(said, v)
    assert {(r["answer_id"], r["sentence"]): r["status"] for r in status.collect()} == {(1, "a"): "verified", (1, "b"): "verified", (1, "c"): "uncited", (1, "d"): "uncited", (2, "z"): "uncited"}
    m = {r["answer_id"]: r for r in verify.citation_metrics(status, v).collect()}
    assert (m[1]["coverage"], m[1]["precision"], m[1]["uncited_rate"]) == (0.5, 3 / 6, 0.5)
    assert m[1]["quote_failure_rate"] == pytest.approx(1 / 3)
    assert (m[1]["unsupported_rate"], m[1]["unverified_rate"]) == (0.0, 0.0)
    failed = v.where("claim_idx = 1").withColumn("sentence", F.lit("c"))
    n = {r["answer_id"]: r for r in verify.citation_metrics(verify.sentence_status(said, v.unionByName(failed)), v.unionByName(failed)).collect()}
    assert n[1]["unsupported_rate"] == 1 / 4 and n[1]["quote_failure_rate"] == 2 / 4
    assert (n[1]["failed"], n[1]["judged"], n[1]["c_verified"], n[1]["levels_omitted"]) == (2, 2, 2, 0)
    assert (m[2]["coverage"], m[2]["precision"], m[2]["claims"]) == (0.0, 0.0, 0)
    total = verify.citation_summary(verify.citation_metrics(status, v)).first()
    assert (total["coverage"], total["sentences"]) == (0.25, 5)


def parsed(spark, raw):
    return answers.parse(spark.createDataFrame([(1, raw if isinstance(raw, str) else json.dumps(raw))], "answer_id long, raw string")).first()


@pytest.mark.parametrize(
    ("raw", "error"),
    [
        ("no json", "answer is not an object"),
        ([1], "answer is not an object"),
        ({"answerable": "true", "sentences": ["a"], "claims": []}, "answer.answerable is not a boolean"),
        ({"answerable": True, "sentences": ["a", 1], "claims": []}, "answer.sentences is not an array of strings"),
        ({"answerable": True, "sentences": "a", "claims": []}, "answer.sentences is not an array of strings"),
        ({"answerable": True, "sentences": ["  "], "claims": []}, "answer.sentences is empty"),
        ({"answerable": True, "sentences": ["a"]}, "answer.claims is not an array"),
    ],
)
def test_fatal_errors(spark, raw, error):
    assert parsed(spark, raw)["error"] == error


def test_claims(spark):
    good = {"sentenceIndex": 0, "chunkIds": ["c1", "c1", "c2"], "quote": "q"}
    bad = [3, {}, good | {"sentenceIndex": 9}, good | {"sentenceIndex": 0.5}, good | {"chunkIds": []}, good | {"chunkIds": [1]}, good | {"quote": " "}, {k: v for k, v in good.items() if k != "quote"}]
    r = parsed(spark, {"answerable": True, "sentences": ["  ", "Real sentence. [claim 0]", "Other."], "claims": [good, *bad]})
    assert r["error"] is None
    assert r["sentences"] == ["Real sentence.", "Other."]
    assert [(c["sentence"], c["chunk_ids"], c["quote"]) for c in r["claims"]] == [("Real sentence.", ["c1", "c2"], "q")]
    assert r["dropped"] == [f"claim {i}: {x}" for i, x in enumerate(("not an object", "sentenceIndex is not an integer", "sentenceIndex 9 is out of range", "sentenceIndex is not an integer", "chunkIds is empty", "chunkIds is not an array of strings", "quote is empty", "quote is not a string"), 1)]


@pytest.mark.parametrize(
    ("said", "expected"),
    [(["AAA x", "AA y"], ["AA y", "AAA x"]), (["p", "AAA x", "q", "Level A y"], ["p", "Level A y", "q", "AAA x"]), (["AAA x", "p"], ["AAA x", "p"]), (["A x", "AA y"], ["A x", "AA y"])],
)
def test_by_level(spark, said, expected):
    frame = spark.createDataFrame([(said,)], "s array<string>")
    assert frame.select(answers.by_level(F.col("s"))).first()[0] == expected


@pytest.mark.parametrize(
    ("verdicts", "n", "expected"),
    [
        ([{"index": 1, "label": "not_supported"}, {"index": 0, "label": "supported"}], 2, [1.0, 0.0]),
        ([{"index": 0, "label": "supported"}], 3, [1.0, None, None]),
        ([{"index": 0, "label": "x"}, {"index": 9, "label": "supported"}, {"index": 1.5, "label": "supported"}, "s", None], 2, [None, None]),
        ([{"index": 0, "label": "supported"}, {"index": 0, "label": "partially_supported"}], 1, [0.5]),
        ("none", 1, [None]),
    ],
)
def test_verdicts(spark, verdicts, n, expected):
    raw = spark.createDataFrame([(1, n, json.dumps({"verdicts": verdicts}))], "batch_id long, n int, raw string")
    assert [r["score"] for r in answers.verdicts(raw).orderBy("idx").collect()] == expected


def test_probes_are_told_apart(spark):
    rows = [(f"c{i}", i, f"d{i % 7}", " ".join(f"word{(i * 31 + j * (i % 5 + 1)) % 997}x{j}" for j in range(60)) + " don’t “stop” — ever") for i in range(0, 53 * 30)]
    chunks = spark.createDataFrame(rows, "id string, ordinal long, doc_id string, text string")
    got = verify.probes(chunks).withColumn("ok", verify.quote_holds(F.col("quote"), F.col("text"))).collect()
    assert len(got) > 100
    assert all(r["ok"] == r["should_match"] for r in got)
    assert all((verify.locate(r["quote"], r["text"]) is not None) == r["should_match"] for r in got)


def test_fabrication_results_agree_with_their_probes(spark):
    sf_dir = "/root/testdata/sf0.001"
    probes = evidence.fabrication_results(spark, sf_dir).collect()
    assert probes and all(0 <= r["accepted"] <= r["n"] for r in probes)
    assert all(r["accepted"] == (r["n"] if r["should_match"] else 0) for r in probes)
