"""What reports and views derive: hit lines, previews, shares of a maximum, waterfalls, table rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import settle

LABEL, PREVIEW = 70, 600


def hit_line(rank: Column, score: Column, doc_id: Column, label: Column) -> Column:
    return F.concat(F.lpad(rank.cast("string"), 2, " "), F.lit(". "), F.format_string("%.3f", score), F.lit("  "), doc_id, F.lit("  "), F.substring(label, 1, LABEL))


def preview(text: Column) -> Column:
    """The start of a text, with runs of line ends made one."""
    return F.substring(F.regexp_replace(text, r"\n{2,}", "\n"), 1, PREVIEW)


def of_peak(value: Column, *keys: str) -> Column:
    """value over the largest of its group; 0 where that is 0."""
    return F.coalesce(value / F.nullif(F.max(value).over(Window.partitionBy(*keys)), F.lit(0.0)), F.lit(0.0))


def waterfall(rows: DataFrame, value: str, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """rows with (start, share): the sum of what comes before in the group, and the part of the group's total. Groups are
    cut into ranges of their order, and a row for each range carries the sums before it, so no task sees more of a group
    than a range."""
    dealt = settle(rows.repartitionByRange(*keys, *order).withColumn("part", F.spark_partition_id()), "waterfall")
    sums = dealt.groupBy(*keys, "part").agg(F.sum(value).alias("sum"))
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ranges = sums.select(*keys, "part", F.coalesce(F.sum("sum").over(earlier), F.lit(0.0)).alias("begin"), F.sum("sum").over(Window.partitionBy(*keys)).alias("total"))
    inside = Window.partitionBy(*keys, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("inside", F.coalesce(F.sum(value).over(inside), F.lit(0.0)))
    same = [summed[k].eqNullSafe(ranges[k]) for k in (*keys, "part")]
    joined = summed.join(ranges, same).select(*[summed[c] for c in rows.columns], (F.col("begin") + F.col("inside")).alias("start"), (F.col(value) / F.nullif("total", F.lit(0.0))).alias("share"))
    return joined


def report_row(name: Column, values: list[tuple[Column, str]], available: Column) -> Column:
    """A row of a Markdown table; dashes where the retriever wasn't available."""
    cells = [F.when(available, F.format_string(f, v)).otherwise("—") for v, f in values]
    return F.concat_ws(" ", F.lit("|"), name, *[c for cell in cells for c in (F.lit("|"), cell)], F.lit("|"))
