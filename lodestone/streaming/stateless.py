"""Streams: documents through the same expressions as tables, and a tumbling rate limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

LIMIT, WINDOW = 20, "60 seconds"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema("doc_id long, text string, lang string, source string, n_chars long").option("maxFilesPerTrigger", 1).parquet(path)


def tokenized(docs: DataFrame) -> DataFrame:
    """(doc_id, tokens), of a stream or a table."""
    return docs.select("doc_id", T.tokens(F.col("text")).alias("tokens"))


def rate_limit(events: DataFrame, key: str = "user_id", limit: int = LIMIT, window: str = WINDOW) -> DataFrame:
    """(key, start, n, over) of tumbling windows over events (ts). On a stream, the caller sets the watermark."""
    return events.groupBy(key, F.window("ts", window).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n", (F.col("n") > limit).alias("over"))


def latest(results: DataFrame, key: str, *order: str) -> DataFrame:
    """For each key the result of the latest request, by the columns of order: earlier ones are stale."""
    others = [c for c in results.columns if c != key]
    return results.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("r")).select(key, "r.*")
