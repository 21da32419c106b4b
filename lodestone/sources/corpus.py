"""Corpus sources: text files with a manifest, pages, and what is written back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "doc_id string, doc_title string, source_url string, chars long"


def read_text_corpus(spark: SparkSession, root: str, manifest: str | None = None) -> DataFrame:
    """(doc_id, doc_title, source_url, text) of the .txt files below root: doc_id is the path without the ending, and
    without a manifest the title is the first heading line."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt").select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    base = root.rstrip("/").rsplit("/", 1)[-1]
    docs = files.select(F.regexp_replace(F.url_decode("path"), rf"^.*/{base}/(.*)\.txt$", "$1").alias("doc_id"), F.regexp_replace("text", "\r\n", "\n").alias("text"))
    if manifest is None:
        title = F.regexp_extract("text", r"(?m)^# (.+)$", 1)
        return docs.select("doc_id", F.coalesce(F.nullif(title, F.lit("")), "doc_id").alias("doc_title"), F.lit(None).cast("string").alias("source_url"), "text")
    return read_manifest(spark, manifest).join(docs, "doc_id").select("doc_id", "doc_title", "source_url", "text")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path)


def document(docs: DataFrame, doc_id: str) -> DataFrame:
    """The document of this id, as the reader of a citation opens it; no row if there is none."""
    return docs.where(F.col("doc_id") == doc_id).select("doc_id", "text")


def write_manifest(docs: DataFrame, path: str) -> None:
    docs.select("doc_id", "doc_title", "source_url", F.length("text").cast("long").alias("chars")).write.mode("overwrite").json(path)


def write_text_corpus(docs: DataFrame, root: str) -> None:
    """One folder of text for each document, for export; tables stay Parquet."""
    docs.select("doc_id", "text").repartition("doc_id").write.mode("overwrite").option("lineSep", "\n").partitionBy("doc_id").text(root)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """A graded question set in JSON lines."""
    anchors = "array<struct<doc_id:string,heading:string>>"
    return spark.read.schema(f"id string, question string, kind string, primary {anchors}, related {anchors}, note string").json(path)
