"""Tables between stages: written to the folder that all executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_SCOPE: ContextVar[str | None] = ContextVar("scratch_scope", default=None)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[str]:
    """Tables between stages that are written inside lie in one folder, which is deleted at the end. What a query
    returns reads such tables, so write or collect it inside, too."""
    folder = scratch(spark, "scope")
    token = _SCOPE.set(folder)
    try:
        yield folder
    finally:
        _SCOPE.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; a temporary one only where that is unset and
    one machine runs everything."""
    if scope := _SCOPE.get():
        return f"{scope}/{name}-{uuid.uuid4().hex}"
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: For rows of up to some megabytes: a reader holds up to 4,096 rows of a row group at once, so groups are cut by size, which
#: is looked at every few rows.
HEAVY = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "4", "parquet.page.size.row.check.max": "64"}


#: Of what goes to a Python worker at once. Spark's own is 64 MB, which a task holds several times over.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside sends Python workers BATCH_BYTES at once, unless the session says less. Results don't depend on it."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(min(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before), BATCH_BYTES)))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def settle(df: DataFrame, name: str, heavy: bool = False) -> DataFrame:
    """df, written to the shared folder and read again: what is lost with an executor is reread, not recomputed. heavy:
    whether rows are large, as those that hold many documents are."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**(HEAVY if heavy else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, *order) -> DataFrame:
    """rows with place: 0, 1, 2, ... in this order. Ranges are numbered apart, and a row for each range says how many
    come before it, so no task sees more than a range."""
    dealt = settle(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "numbered")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return dealt.withColumn("inside", inside).join(starts, "part").withColumn("place", F.col("begin") + F.col("inside")).drop("part", "begin", "inside")


def spread(df: DataFrame) -> DataFrame:
    """df, dealt over all cores where its files make fewer tasks than there are: a small table is often one row group,
    and then one task's work. Tables with tasks enough stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
