"""Embeddings kept by id: only what is missing is embedded, and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.providers import Encoder, embed
from .index import exists

SCHEMA = "id string, embedding array<float>"


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path) if exists(spark, path) else spark.createDataFrame([], SCHEMA)


def missing(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows of texts whose id the cache lacks."""
    return texts.join(cache.select("id"), "id", "left_anti")


def content_key(text_column: str = "text"):
    """An id that depends on the text only, so equal texts are embedded once."""
    return F.substring(F.sha2(F.col(text_column), 256), 1, 24)


def upsert(spark: SparkSession, texts: DataFrame, path: str, encoder: Encoder) -> DataFrame:
    """The cache with all of texts (id, text)."""
    new = embed(missing(texts.dropDuplicates(["id"]), read_cache(spark, path)), encoder)
    new.write.mode("append").parquet(path)
    return read_cache(spark, path)


LEDGER = "model string, key binary, embedding array<float>"


def named(texts: DataFrame) -> DataFrame:
    """(id, key, text) of texts (id, text): equal texts have one key, and a null text is an empty one."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return texts.select("id", F.unhex(F.sha2(text, 256)).alias("key"), text.alias("text"))


def read_ledger(spark: SparkSession, path: str, model: str) -> DataFrame:
    """(key, embedding) of one model, a row for each key: two runs at once may both have embedded a text."""
    rows = spark.read.schema(LEDGER).parquet(path) if exists(spark, path) else spark.createDataFrame([], LEDGER)
    return rows.where(F.col("model") == model).groupBy("key").agg(F.first("embedding").alias("embedding"))


def unseen(texts: DataFrame, path: str, model: str) -> DataFrame:
    """(id, text): each different text that the ledger lacks for this model, once; the id is its key in hex."""
    new = named(texts).groupBy("key").agg(F.first("text").alias("text"))
    return new.join(read_ledger(texts.sparkSession, path, model).select("key"), "key", "left_anti").select(F.hex("key").alias("id"), "text")


def embed_once(texts: DataFrame, path: str, encoder: Encoder, model: str) -> DataFrame:
    """(id, embedding) of all rows of texts (id, text). Different texts that the ledger lacks are embedded, once each, and
    appended; what is appended comes from tasks that succeeded, so a task that is run again adds nothing twice."""
    spark = texts.sparkSession
    new = embed(unseen(texts, path, model), encoder)
    new.select(F.lit(model).alias("model"), F.unhex("id").alias("key"), "embedding").write.mode("append").parquet(path)
    return named(texts).select("id", "key").join(read_ledger(spark, path, model), "key").select("id", "embedding")
