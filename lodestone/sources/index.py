"""The index as tables: chunks, postings with their statistics, and vectors, which are optional.

Chunks are one table, of which readers take the columns they need. Postings are laid out by ranges of terms, so that
a reader of some terms skips most files by their statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import bm25


def indexed(chunks: DataFrame) -> DataFrame:
    """(id, text) as it is indexed."""
    return chunks.select("id", T.document_text(F.col("heading_path"), F.col("text")).alias("text"))


def write_index(chunks: DataFrame, root: str, embeddings: DataFrame | None = None) -> None:
    """embeddings: (id, embedding)."""
    chunks.write.mode("overwrite").parquet(f"{root}/chunks")
    texts = indexed(chunks)
    bm25.postings(texts).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{root}/postings")
    bm25.statistics(texts).write.mode("overwrite").parquet(f"{root}/statistics")
    if embeddings is not None:
        embeddings.select("id", V.quantize(F.col("embedding")).alias("c")).select("id", "c.scale", "c.codes").write.mode("overwrite").parquet(f"{root}/vectors")


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_index(spark: SparkSession, root: str) -> tuple[dict[str, DataFrame], list[str]]:
    """(tables, reasons): chunks, postings and statistics are needed; vectors are left out, with a reason, where they
    are missing or aren't one for each chunk."""
    tables = {name: spark.read.parquet(f"{root}/{name}") for name in ("chunks", "postings", "statistics")}
    if not exists(spark, f"{root}/vectors"):
        return tables, ["vectors are missing"]
    vectors = spark.read.parquet(f"{root}/vectors")
    if vectors.count() != tables["chunks"].count():
        return tables, ["vectors and chunks differ in number"]
    return tables | {"vectors": vectors}, []


def metadata_with_text(meta: DataFrame, texts: DataFrame) -> DataFrame:
    """Chunks whose texts are kept apart: an empty text where there is none."""
    return meta.join(texts.select("id", "text"), "id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def summary(chunks: DataFrame) -> DataFrame:
    """One row: documents, chunks, median and largest tokens, chunks with a reference, terms and mean length."""
    from ..operators.chunk import exact_quantiles

    texts = indexed(chunks)
    counts = chunks.agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("chunks"), F.count("sc_ref").alias("referenced"))
    sizes = exact_quantiles(chunks.select("token_count"), "token_count", {"median_tokens": 0.5, "max_tokens": 1.0}).drop("n")
    terms = texts.select(F.explode(T.tokens(F.col("text"))).alias("t")).agg(F.countDistinct("t").alias("terms"))
    return counts.crossJoin(sizes).crossJoin(terms).crossJoin(bm25.statistics(texts).select("avgdl"))  # one row each


def folders(chunks: DataFrame) -> DataFrame:
    """(folder, documents, chunks, bytes) of chunks (doc_id, text): a document's folder is its id up to the first slash."""
    own = chunks.select(F.substring_index("doc_id", "/", 1).alias("folder"), "doc_id", F.octet_length("text").cast("long").alias("bytes"))
    by_document = own.groupBy("folder", "doc_id").agg(F.count("*").alias("chunks"), F.sum("bytes").alias("bytes"))
    return by_document.groupBy("folder").agg(F.count("*").alias("documents"), F.sum("chunks").alias("chunks"), F.sum("bytes").alias("bytes"))


def read_bm25_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(postings, statistics) of an index in one JSON object: docIds, lengths, avgdl, params, and for each term a flat
    list of document places and counts."""
    schema = "params struct<k1:double,b:double>, docIds array<string>, lengths array<long>, avgdl double, postings map<string,array<long>>"
    whole = spark.read.schema(schema).json(path, multiLine=True)
    pairs = whole.select("docIds", "lengths", F.explode("postings").alias("term", "flat")).select("docIds", "lengths", "term", "flat", F.explode(F.sequence(F.lit(1), F.size("flat") - 1, F.lit(2))).alias("i"))
    place = (F.col("flat")[F.col("i") - 1] + 1).cast("int")
    posted = pairs.select(F.element_at("docIds", place).alias("id"), F.element_at("lengths", place).alias("len"), "term", F.col("flat")[F.col("i")].alias("tf"))
    return posted, whole.select(F.size("docIds").cast("long").alias("n"), "avgdl", "params.k1", "params.b")
