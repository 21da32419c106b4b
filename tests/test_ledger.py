"""A ledger of embeddings sends each different text once."""

from lodestone.operators.providers import HashEncoder
from lodestone.sources import embedding_cache


def test_only_unseen_texts_are_sent(spark, tmp_path):
    path, encoder = str(tmp_path / "ledger"), HashEncoder()
    texts = spark.createDataFrame([(1, "one"), (2, "two"), (3, "one"), (None, "one"), ((1 << 60) + 1, None), (5, "")], "id long, text string")
    assert embedding_cache.unseen(texts, path, "m").count() == 3
    got = {r["id"]: r["embedding"] for r in embedding_cache.embed_once(texts, path, encoder, "m").collect()}
    assert set(got) == {1, 2, 3, None, (1 << 60) + 1, 5} and got[1] == got[3] == got[None] != got[2]
    assert spark.read.parquet(path).count() == 3
    more = texts.unionByName(spark.createDataFrame([(7, "three"), (8, "three")], "id long, text string"))
    assert [r["text"] for r in embedding_cache.unseen(more, path, "m").collect()] == ["three"]
    assert embedding_cache.embed_once(more, path, encoder, "m").count() == 8
    assert spark.read.parquet(path).count() == 4
    assert embedding_cache.unseen(texts, path, "other").count() == 3


def test_texts_that_two_runs_embedded_count_once(spark, tmp_path):
    path = str(tmp_path / "ledger")
    texts = spark.createDataFrame([(1, "one"), (2, "two")], "id long, text string")
    embedding_cache.embed_once(texts, path, HashEncoder(), "m")
    spark.read.parquet(path).write.mode("append").parquet(path)
    assert embedding_cache.embed_once(texts, path, HashEncoder(), "m").count() == 2
