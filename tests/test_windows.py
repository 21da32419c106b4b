"""Windows and statistics in one pass: against the rule, on long texts, and with large ids."""

import random
import time

from lodestone.operators import chunk


def plain(text, size, step):
    out, n = [], len(text)
    for at in range(0, n, step):
        if at and at - step + size >= n:
            break
        end = min(at + size, n)
        if end < n:
            end = max((p for p in range(at + size // 2 + 1, at + size + 1) if text[p : p + 1] == " "), default=end)
        start = min((p + 1 for p in range(at, min(at + 40, n)) if text[p] == " "), default=at) if at else 0
        out.append((start, end))
    return out


def test_windows_follow_the_rule():
    r = random.Random(1)
    for _ in range(400):
        text = "".join(r.choice("ab é\n  ") for _ in range(r.randrange(300)))
        size = r.randrange(2, 90)
        step = r.randrange(1, size + 1)
        assert list(chunk.windows_of(text, size, step)) == plain(text, size, step)


def test_twenty_megabytes_take_seconds(spark):
    docs = spark.sql("SELECT 1L AS doc_id, repeat('some words of a text. \\n', 900000) AS text UNION ALL SELECT NULL, 'no id' UNION ALL SELECT 2, NULL")
    began = time.time()
    windows = chunk.fixed_windows(docs)
    assert windows.where("doc_id = 1").count() > 15_000 and windows.where("doc_id IS NULL").count() == 1
    s = chunk.statistics(windows.selectExpr("*", "CAST(NULL AS string) AS sc_ref"), docs).first()
    assert s["n"] > 15_000 and s["holds"] == 1.0
    assert time.time() - began < 90


def test_flags_of_chunks_beside_their_documents(spark):
    docs = spark.createDataFrame([(1, "ab\ncd ef"), (2, "xy"), (2, "xyz"), (None, "q"), (3, None)], "doc_id long, text string")
    rows = [(1, "ab", 0, 2), (1, "cd", 3, 5), (1, "ef", 6, 8), (1, "no", 6, 8), (2, "xy", 0, 2), (None, "q", 0, 1), (3, "", 0, 0), (9, "a", 0, 1)]
    from pyspark.sql import functions as F

    chunked = spark.createDataFrame(rows, "doc_id long, text string, char_start int, char_end int")
    got = sorted(tuple(r) for r in chunk.beside_documents(chunked, docs, [F.col("doc_id"), F.col("text")]).collect())
    assert got == [(1, "ab", 1, 0, 1), (1, "cd", 1, 0, 1), (1, "ef", 1, 1, 0), (1, "no", 0, 1, 0), (2, "xy", 1, 0, 1), (2, "xy", 1, 1, 1)]


def test_ids_beyond_53_bits_beside_a_null(spark):
    docs = spark.createDataFrame([((1 << 60) + 1, "a" * 2000), (None, "b")], "doc_id long, text string")
    assert {r["doc_id"] for r in chunk.hard_pieces(docs).collect()} == {(1 << 60) + 1, None} == {r["doc_id"] for r in chunk.fixed_windows(docs).collect()}
