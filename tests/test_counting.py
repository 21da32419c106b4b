"""Texts are cut and counted without the tokenizers' patterns where that gives the same, and only words that are asked for stay."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import bm25, lists


def drawn(n, seed=8):
    r = random.Random(seed)
    signs = "aabBCzéÉßŸÿſ19  -_.,\n\t'\x00\x7f"
    return ["".join(r.choices(signs, k=r.randint(0, 30))) for _ in range(n)] + ["x.", "Y", "ÉCole", "ÉcoleÉ", "1.2.3", "a-B", "-", "", "v1.2 A.B-c", "é×b", "Σς"]


def test_texts_are_cut_as_the_patterns_cut_them(spark):
    texts = drawn(3000)
    odd, special = lists._looked(pa.array(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = docs.orderBy("id").select(F.col("text").rlike(T.ODD).alias("o"), F.col("text").rlike(T.SPECIAL).alias("s"), T.tokens(F.col("text")).alias("t"), T.plain_tokens(F.col("text")).alias("p")).toArrow()
    assert odd.tolist() == want["o"].to_pylist()
    assert special.tolist() == [s and not o for s, o in zip(want["s"].to_pylist(), odd, strict=True)]
    rows = pa.array(texts).filter(pa.array(~odd))
    lens, tokens = lists._compound(rows)
    ends, low = np.concatenate([[0], np.cumsum(lens)]), [t.lower() for t in tokens.to_pylist()]
    assert [low[a:b] for a, b in zip(ends, ends[1:], strict=False)] == want["t"].filter(pa.array(~odd)).to_pylist()


def test_only_words_that_are_asked_for_stay(spark):
    texts = drawn(400) + ["común word", "foo-bar", "İx word"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    queries = spark.createDataFrame([(1, "Word foo-BAR"), (2, "común x")], "query_id long, text string")
    few, all_ = bm25.two_counted(docs, bm25.two_terms(queries)), bm25.two_counted(docs)
    for a, b, tokens in zip(few, all_, (T.tokens, T.plain_tokens), strict=True):
        lens = [sorted(map(tuple, x.select(F.explode(F.arrays_zip("ids", "lens")).alias("r")).select("r.*").collect())) for x in (a, b)]
        assert lens[0] == lens[1]
        kept, words = ({r[0] for r in x.select(F.explode("words")).collect()} for x in (a, b))
        asked = {r[0] for r in bm25.query_terms(queries, tokens).select("term").collect()}
        assert kept >= asked & words and len(kept) < len(words) / 4
        hits = [sorted(map(tuple, bm25.search_counted(x, queries, 400, tokens).select("query_id", "id", "rank").collect())) for x in (a, b)]
        assert hits[0] == hits[1] and hits[0]


def test_postings_are_not_shuffled_where_no_id_repeats(spark):
    texts = drawn(500)
    queries = spark.createDataFrame([(1, "a b c é 1")], "query_id long, text string")
    blocks = lists.query_blocks(bm25.query_terms(queries))
    for ids in (lambda i: i, lambda i: i % 300):
        docs = spark.createDataFrame([(ids(i), t) for i, t in enumerate(texts)], "id long, text string").repartition(3)
        got = {}
        for r in lists.postings_of(bm25.counted(docs), blocks).collect():
            doc, size, tf = (np.frombuffer(r[c], np.int32) for c in ("doc", "len", "tf"))
            for d, n, t, k in zip(doc, size, r["term"], tf, strict=True):
                key = r["ids"][d], int(n), blocks.first()["vocabulary"][t]
                assert key not in got
                got[key] = int(k)
        plain = bm25.postings(docs).join(bm25.query_terms(queries).select("term"), "term", "left_semi")
        assert got == {(r["id"], r["len"], r["term"]): r["tf"] for r in plain.collect()}
