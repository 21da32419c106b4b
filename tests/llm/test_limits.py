"""Ids beyond 53 bits, texts of many findings or blanks, rows that repeat by the hundred thousand, names that clash."""

import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.llm import mixing, near_dup, pages, quality, secrets, spans
from lodestone.llm.common import repeated

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BIG = 1 << 60


def test_large_ids_beside_a_null_stay(spark):
    rows = [(BIG + 2 * i + 1, "word " * (i + 1), "en", "ab"[i % 2], 1) for i in range(6)] + [(None, "no id", "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    assert {r["doc_id"] for r in mixing.mix(docs).collect()} == {r[0] for r in rows}
    assert {r["doc_id"] for r in secrets.scan(docs).collect()} == {r[0] for r in rows}
    assert {r["doc_id"] for r in near_dup.near_duplicates(docs).collect()} == {r[0] for r in rows}
    got = pages.main_text(docs.select(F.col("doc_id").alias("page_id"), F.lit("http://h/x").alias("url"), F.col("text").alias("html"))).collect()
    assert {r["page_id"] for r in got} == {r[0] for r in rows}


def test_ten_megabytes_of_hashes(spark):
    text = " ".join(f"{i * 2654435761 % (1 << 160):040x}" for i in range(250_000)) + " password=abcdefghijklmnop"
    docs = spark.createDataFrame([(1, text, "en", "a", len(text)), (2, "clean", "en", "a", 5)], DOCS)
    began = time.time()
    found = {r["doc_id"]: r["spans"] for r in secrets.scan(docs).collect()}
    assert len(found[1]) == 250_001 and found[2] == [] and all(s["start"] == 41 * i for i, s in enumerate(found[1][:-1]))
    new = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert new == {1: " ".join(["[hex]"] * 250_000) + " [assign]", 2: "clean"}
    assert time.time() - began < 120


OLD = re.compile(rb"(?<=[.!?])[ \t\r\x0b\x0c]+|[ \t\r]*\n\s*")


@pytest.mark.parametrize("text", [b" " * 5_000_000, b"\t" * 5_000_000, b"word" + b" " * 5_000_000 + b"end", b"Yes." + b" \r" * 2_000_000, b"a \n" * 1_000_000, (b"." + b" " * 3 + b"\x0b\n") * 500_000])
def test_blanks_take_seconds(text):
    began = time.time()
    spans.sentences(text)
    assert time.time() - began < 10


def test_borders_are_where_they_were():
    import itertools

    for n in range(7):
        for x in itertools.product(b"a. \n\x0b\r", repeat=n):
            text = bytes(x)
            assert [m.span() for m in spans.BORDER.finditer(text)] == [m.span() for m in OLD.finditer(text)], text


def test_equal_rows_are_counted_not_gathered(spark):
    many = spark.range(200_000).select(F.lit(1000).cast("long").alias("doc_id"), F.lit("two words").alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(9).cast("long").alias("n_chars"))
    docs = many.unionByName(spark.createDataFrame([(i, "w " * (i + 1), "en", "b", 1) for i in range(300)], DOCS))
    assert mixing.mixed(docs).where("n > 1").count() == 1
    rows = mixing.mix(docs).groupBy("source_size").agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max(F.col("taken") / F.col("size")).alias("most")).collect()
    assert sorted(r["n"] for r in rows) == [300, 200_000] and all(abs(r["taken"] - r["target"]) < 300 and r["most"] <= 2 for r in rows)
    assert mixing.apply_mix(docs).where("doc_id = 1000").count() * 2 == next(r["taken"] for r in rows if r["n"] > 300)


def test_rows_are_repeated_as_often_as_told(spark):
    told = {0: 0, 1: 1, 2: 1023, 3: 1024, 4: 1025, 5: 70_000, 6: 2_500_000}
    rows = spark.createDataFrame(list(told.items()), "k int, times long")
    assert {r["k"]: r["count"] for r in repeated(rows, "times").groupBy("k").count().collect()} == {k: n for k, n in told.items() if n}


NAMES = ("key", "row", "good", "blob", "spans", "edits", "last", "new", "total", "row_key", "times", "__part", "__again", "__key", "__id", "__spans", "__blob", "__copies", "__copy", "n", "p", "spin", "block")


def test_names_of_the_operators_as_further_columns(spark):
    rows = [(i, f"Some text of {i} and password: abcdefghijklmnop{i} " * 3, "en", "ab"[i % 2], 1) for i in range(12)] + [(1, None, None, None, None), (None, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    for name in NAMES:
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int").withColumn("key", F.lit(1))
    for got in (quality.keep_good(docs, labels), near_dup.keep_one(docs), secrets.redact(docs), mixing.apply_mix(docs)):
        assert got.columns == docs.columns and got.dtypes == docs.dtypes
        kept = Counter(tuple(r[n] for n in ("doc_id", *NAMES)) for r in got.collect())
        assert kept and set(kept) <= {tuple(r[n] for n in ("doc_id", *NAMES)) for r in docs.collect()}


def test_stages_on_an_empty_table(spark):
    none = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for got in (quality.keep_good(none, labels), near_dup.keep_one(none), secrets.redact(none), mixing.apply_mix(none)):
        assert got.columns == none.columns and got.count() == 0


def test_a_shared_ledger_is_read_for_these_documents_only(spark, tmp_path):
    folder = f"file://{tmp_path}/ledger"
    old = spark.createDataFrame([(i, f"token={'x' * 12}{i}", "en", "a", 1) for i in range(50)], DOCS)
    assert secrets.findings(old, folder).count() == 50
    new = spark.createDataFrame([(1, f"token={'x' * 12}7", "en", "a", 1), (2, "nothing", "en", "a", 1)], DOCS)
    assert secrets.findings(new, folder).count() == 1
    assert spark.read.parquet(folder).count() == 51
