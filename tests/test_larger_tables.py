"""What only larger tables showed: references that were cut, and work that grew faster than its input."""

import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import bm25, html, lists
from lodestone.plans import registry


def test_titles_with_references_that_were_cut(spark, tmp_path):
    heads = ["a&amp;&amp", "a&amp;&am", "a&amp;&", "token = &quot", "x &lt;b&gt; &amp;lt; &quot;y&quot;", "&middot; z", "plain"]
    rows = [(i, f"/p{i}", f"<html><body><main><h1>{h}</h1><p>text</p></main></body></html>") for i, h in enumerate(heads)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, registry.queries()["page_titles"](spark, str(tmp_path)).collect()))
    sql = registry.oracle_sql()["page_titles"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(duckdb.sql(sql).fetchall())


def test_pages_themselves_read_references_as_html_does():
    assert html.normalize("<h1>a &amp</h1><p>&copy b</p>", "1") == ("a &", "# a &\n\n© b")


def texts(n, seed=5):
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.7)) % 400}" for _ in range(4000)]
    return [" ".join(r.choices(words, k=r.randint(0, 25))) for _ in range(n)]


def test_lists_in_blocks_are_those_of_single_rows(spark):
    """More queries and documents than a block has, copies, null texts, ids that repeat (one document) or are null."""
    own = texts(1500)
    rows = [(str(i % 1400), t if i % 50 else None) for i, t in enumerate(own)] + [(f"copy{i}", own[7]) for i in range(200)] + [(None, own[9]), (None, own[9]), (None, own[10])]
    docs = spark.createDataFrame(rows, "id string, text string").repartition(5)
    queries = spark.createDataFrame(list(enumerate([*texts(298, 6), "", None])), "query_id long, text string")
    plain = bm25.scored(bm25.matches(docs, queries), 10)
    columns = ("query_id", "id", F.round("score", 8).alias("score"), "rank")

    def listed(frame):
        return sorted(map(tuple, frame.select(*columns).collect()), key=lambda r: (r[0], r[3]))

    assert listed(bm25.search(docs, queries, 10)) == listed(plain)
    swept = bm25.sweep(docs, queries, [(1.2, 0.75), (0.6, 1.0)], 10)
    assert listed(swept.where("k1 = 1.2")) == listed(plain)
    assert listed(swept.where("k1 = 0.6")) == listed(bm25.scored(bm25.matches(docs, queries), 10, 0.6, 1.0))


ODD_TEXTS = ["", None, "Plain words, e.g. these: 12 of 3", "foo-bar a_b 1.2.3 x.y", "camelCase HTTPServer", "Ünï Çödé ÀÉ Žluť", "a\u00d7b c\u00f7d \u00bfqu\u00e9? \u00aa\u00b5\u00ba", "e\u0301te\u0301 “quoted” – dash…", "\u0130stanbul i", "ΣΑΣ ςσ", " \t lead\ntrail \r\n", "日本語 テスト１２ ½ ²", "\u00a0nbsp\u00a0x\x7fy\x00z", "ſtraße ŉ ĸ ǅ", "한국 \U0001d400\U0001f600 ok"]


def test_documents_are_counted_as_their_tokens(spark):
    """Texts go out whole and are counted in blocks; what both tokenizers share is held once."""
    docs = spark.createDataFrame(list(enumerate(ODD_TEXTS * 3)), "id long, text string").repartition(3)
    for counts, tokens in zip(bm25.two_counted(docs), (T.tokens, T.plain_tokens), strict=True):
        want = {r[0]: (len(r[1]), dict(Counter(r[1]))) for r in docs.select("id", tokens(F.col("text"))).collect()}
        for again in (counts, bm25.counted(docs, tokens)):
            got = {}
            for r in again.collect():
                sizes, term, tf = (np.frombuffer(r[c], np.int32) for c in ("sizes", "term", "tf"))
                for i, (a, b) in enumerate(zip(ends := np.concatenate([[0], np.cumsum(sizes)]), ends[1:], strict=False)):
                    got[r["ids"][i]] = (r["lens"][i], {r["words"][t]: int(n) for t, n in zip(term[a:b], tf[a:b], strict=True)})
            assert got == want
    shared = docs.select("id", F.lit("a b a").alias("plain"), F.when(F.col("id") % 10 == 0, "c").alias("full"))
    assert lists.counted(shared, ("plain",)).where("size(lists) = 2").select(F.explode("ids")).count() == shared.where("full IS NULL").count()


def test_what_leaves_a_task_does_not_grow_with_documents(spark):
    docs = spark.range(6000).select("id", F.concat(F.lit("common word"), F.col("id") % 7).alias("text"))
    queries = spark.createDataFrame([(i, f"common word{i}") for i in range(20)], "query_id long, text string")
    blocks = lists.query_blocks(bm25.query_terms(queries))
    held = lists.postings(bm25.tokenized(docs), blocks)
    assert held.select(F.explode("term")).count() == 12000
    stats = docs.select(F.count("*").alias("n"), F.lit(2.0).alias("avgdl"))
    found = lists.hits(held, lists.weighted(blocks, held, stats, bm25.idf(F.col("n"), F.col("df"))), [(1.2, 0.75)], 3)
    assert 60 <= found.count() <= 60 * found.rdd.getNumPartitions()


def test_pages_and_chunks_go_out_in_small_batches(spark):
    """However many rows a task reads, what it hands on at once stays near OUT_CHARS."""
    page = "<html><body><main><h1>t</h1>" + "<p>" + "Some words of text here. " * 2000 + "</p></main></body></html>"
    pages = spark.range(60).coalesce(1).select(F.col("id").alias("page_id"), F.lit("/u").alias("url"), F.lit(page).alias("html"))

    docs = html.normalize_pages(pages)
    held = [pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(60)]), pa.array(["/u"] * 60), pa.array([page] * 60)], ["page_id", "url", "html"])]
    sent = []
    frame = type("Rows", (), {"select": lambda self, *c: self, "mapInArrow": lambda self, f, schema: sent.extend(f(iter(held)))})()
    html.normalize_pages(frame)
    assert sum(b.num_rows for b in sent) == 60 and max(b.nbytes for b in sent) < 2 * html.OUT_CHARS
    assert docs.count() == 60
