"""What the operators of this subpackage share: keys of rows, batches of texts, the training split."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch, settle, spread  # noqa: F401

#: Bytes of text that a Python step holds at once, besides one document.
BATCH_BYTES = 8 << 20


def row_key(*columns: Column) -> Column:
    """128 bits that stand for the values of a row's columns; a null differs from every value."""
    texts = [c.cast("string") for c in columns]
    return F.unhex(F.md5(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts])))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def whole(docs: DataFrame, key: Column) -> DataFrame:
    """(row, key): docs' rows as structs, so that no name of theirs meets a name of an operator's."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), key.alias("key"))


#: Times that a row is repeated where it lies; beyond, in parts that are dealt out.
REPEATS = 1024


def repeated(rows: DataFrame, times: str) -> DataFrame:
    """rows, each as many times as its column `times` says (0: none), without that column. Rows that are repeated often
    are dealt out over all tasks first, so none repeats a row more than a few thousand times."""
    few, many = rows.where(F.col(times).between(1, REPEATS)), rows.where(F.col(times) > REPEATS)

    def listed(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f"`{c}`") for c in rows.columns if c != times], F.explode(F.array_repeat(F.lit(True), F.col(times).cast("int"))).alias("__again")).drop("__again")

    part = many  # in parts, and those in parts, so that no array is long
    for _ in range(2):
        size = F.greatest(F.ceil(F.col(times) / REPEATS), F.lit(REPEATS)).cast("long")
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.col(times) - 1) / size).cast("int")), lambda i: F.least(size, F.col(times) - i * size))
        own = [F.col(f"`{c}`") for c in rows.columns if c != times]
        part = part.select(*own, F.posexplode(pieces).alias("__part", times)).repartition("__part").drop("__part")
    return listed(few).unionByName(listed(part))


def training_row(doc_id: str = "doc_id") -> Column:
    """Rows that models may learn from: crc32 of doc_id as text, mod 3, is not 1. A null doc_id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """The batches cut into pieces of about `limit` bytes of `column`, each with that column's values as UTF-8 bytes."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield _piece(batch, texts, start, i)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield _piece(batch, texts, start, len(sizes))


def _piece(batch: pa.RecordBatch, texts: pa.Array, start: int, end: int) -> tuple[pa.RecordBatch, list[bytes | None]]:
    return batch.slice(start, end - start), texts.slice(start, end - start).cast(pa.binary() if pa.types.is_string(texts.type) or pa.types.is_binary(texts.type) else pa.large_binary()).to_pylist()
