"""Retrieval metrics, ablation tables and bootstrap intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS = (5, 10, 30)
RESAMPLES, SEED, STEP = 2000, 0x9E3779B9, 0x6D2B79F5


def judged(rankings: DataFrame, qrels: DataFrame, questions: DataFrame) -> DataFrame:
    """(retriever, query_id, kind, n_primary, ideal, hits): a row for each question and retriever, hits being
    (rank, grade) of ranked ids that have a grade. qrels: (query_id, id, grade), 2 is primary, 1 related."""
    retrievers = rankings.select("retriever").distinct()
    grades = qrels.groupBy("query_id").agg(F.count_if(F.col("grade") == 2).alias("n_primary"), F.reverse(F.sort_array(F.collect_list("grade"))).alias("grades"))
    found = rankings.join(qrels, ["query_id", "id"]).groupBy("retriever", "query_id").agg(F.collect_list(F.struct("rank", "grade")).alias("hits"))
    # retrievers are a handful of names
    wide = questions.select("query_id", "kind").crossJoin(F.broadcast(retrievers)).join(grades, "query_id", "left").join(found, ["retriever", "query_id"], "left")
    empty = F.expr("cast(array() as array<struct<rank:int,grade:int>>)")
    return wide.select("retriever", "query_id", "kind", F.coalesce("n_primary", F.lit(0)).alias("n_primary"), F.coalesce("grades", F.array().cast("array<int>")).alias("grades"), F.coalesce("hits", empty).alias("hits"))


def within(k: int, grade: int) -> Column:
    return F.size(F.filter("hits", lambda h: (h["rank"] <= k) & (h["grade"] >= grade)))


def recall(k: int) -> Column:
    """1 for a question without relevant ids."""
    return F.when(F.col("n_primary") == 0, F.lit(1.0)).otherwise(within(k, 2) / F.least(F.col("n_primary"), F.lit(k)))


def success(k: int) -> Column:
    return F.when(F.col("n_primary") == 0, F.lit(1.0)).otherwise((within(k, 2) > 0).cast("double"))


def reciprocal_rank() -> Column:
    """1 for a question without relevant ids, 0 where none was found."""
    return F.when(F.col("n_primary") == 0, F.lit(1.0)).otherwise(first_relevant())


def first_relevant() -> Column:
    return F.coalesce(1.0 / F.array_min(F.transform(F.filter("hits", lambda h: h["grade"] == 2), lambda h: h["rank"])), F.lit(0.0))


def gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)


def ndcg(k: int) -> Column:
    """1 without grades."""
    got = F.aggregate(F.filter("hits", lambda h: h["rank"] <= k), F.lit(0.0), lambda a, h: a + gain(h["grade"], h["rank"]))
    best = F.aggregate(F.transform(F.slice("grades", 1, k), lambda g, i: gain(g, i + 1)), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size("grades") == 0, F.lit(1.0)).when(best == 0, F.lit(0.0)).otherwise(got / best)


def per_question(rankings: DataFrame, qrels: DataFrame, questions: DataFrame) -> DataFrame:
    """(retriever, query_id, kind, recall_5, ..., success_5, ..., mrr, ndcg_10)"""
    values = [*[recall(k).alias(f"recall_{k}") for k in CUTS], *[success(k).alias(f"success_{k}") for k in CUTS], reciprocal_rank().alias("mrr"), ndcg(10).alias("ndcg_10")]
    return judged(rankings, qrels, questions).select("retriever", "query_id", "kind", *values)


def ablation(scores: DataFrame) -> DataFrame:
    """Means of all questions that aren't refusals, for each retriever, and for each kind below it (kind null: all)."""
    names = [c for c in scores.columns if c not in ("retriever", "query_id", "kind")]
    return scores.where(F.col("kind") != "refusal").groupingSets([["retriever", "kind"], ["retriever"]], "retriever", "kind").agg(F.count("*").alias("n"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in names])


def by_variant(scores: DataFrame) -> DataFrame:
    """(group, variant, n, recall_10, success_5, mrr, ndcg_10, identifier, conceptual) over questions that aren't
    refusals: means for each retriever, named group:variant, the last two being the recall of one kind."""
    means = [F.avg(c).alias(c) for c in ("recall_10", "success_5", "mrr", "ndcg_10")]
    kinds = [F.coalesce(F.avg(F.when(F.col("kind") == k, F.col("recall_10"))), F.lit(0.0)).alias(k) for k in ("identifier", "conceptual")]
    rows = scores.where("kind <> 'refusal'").groupBy(F.col("retriever").alias("variant")).agg(F.count("*").alias("n"), *means, *kinds)
    return rows.select(F.split("variant", ":")[0].alias("group"), "*")


def variant_intervals(scores: DataFrame, measures: tuple[str, ...] = ("recall_10", "success_5")) -> DataFrame:
    """(variant, measure, mean, low, high) of each measure, over the same questions."""
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in measures]))
    long = scores.where("kind <> 'refusal'").select(F.col("retriever").alias("variant"), F.col("query_id").alias("ord"), values.alias("x")).select("variant", "ord", "x.measure", "x.value")
    return bootstrap(long, ("variant", "measure"))


def variant_lines(rows: DataFrame, intervals: DataFrame) -> DataFrame:
    """(group, variant, line): rows of a Markdown table, with percentages and 95 % intervals."""
    ends = intervals.groupBy("variant").agg(F.map_from_entries(F.collect_list(F.struct("measure", F.struct("low", "high")))).alias("ci"))

    def share(name: str) -> Column:
        return F.format_string("%.1f%%", 100 * F.col(name))

    def with_ends(name: str) -> Column:
        return F.concat(share(name), F.format_string(" (%.0f–%.0f)", 100 * F.col("ci")[name]["low"], 100 * F.col("ci")[name]["high"]))

    cells = [with_ends("recall_10"), with_ends("success_5"), F.format_string("%.3f", "mrr"), F.format_string("%.3f", "ndcg_10"), share("identifier"), share("conceptual")]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "variant", *cells), F.lit(" |"))
    return rows.join(ends, "variant").select("group", "variant", line.alias("line"))


def draws(first: int, n: int) -> np.ndarray:
    """Numbers first .. first + n - 1 of the seeded sequence, in [0, 1). Each depends on its own place only."""
    u = np.uint32
    with np.errstate(over="ignore"):
        seed = (u(SEED) + (np.arange(first + 1, first + n + 1, dtype=np.uint64) * np.uint64(STEP)).astype(u)).astype(u)
        t = (seed ^ (seed >> u(15))) * (u(1) | seed)
        t = (t + (t ^ (t >> u(7))) * (u(61) | t)) ^ t
        t = t ^ (t >> u(14))
    return t.astype(np.float64) / 4294967296.0


def bootstrap(values: DataFrame, keys: tuple[str, ...] = ("retriever",), resamples: int = RESAMPLES) -> DataFrame:
    """(keys, mean, low, high): percentile intervals of the mean of `value`, over (keys, ord, value).

    The resamples of a key are dealt over tasks; one key's values are a question set, which every task holds.
    """
    listed = values.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"]).alias("vs"))
    parts = listed.select("*", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1), F.lit(100))).alias("at"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for row in rows.itertuples(index=False):
                v = np.array(row.vs, dtype=float)
                m = min(100, resamples - row.at)
                picked = v[np.floor(draws(row.at * len(v), m * len(v)) * len(v)).astype(int)].reshape(m, len(v))
                means = picked.cumsum(axis=1)[:, -1] / len(v)
                out.append(pd.DataFrame({k: [getattr(row, k)] * m for k in keys} | {"m": means}))
            yield pd.concat(out) if out else pd.DataFrame({**{k: [] for k in keys}, "m": []})

    means = parts.mapInPandas(run, ", ".join(f"{k} {dict(values.dtypes)[k]}" for k in keys) + ", m double")
    ordered = means.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy("m")) - 1)
    low, high = int(0.025 * resamples), int(0.975 * resamples)
    ends = ordered.groupBy(*keys).agg(F.max(F.when(F.col("i") == low, F.col("m"))).alias("low"), F.max(F.when(F.col("i") == high, F.col("m"))).alias("high"))
    return listed.select(*keys, (F.aggregate("vs", F.lit(0.0), lambda a, x: a + x) / F.size("vs")).alias("mean")).join(ends, list(keys))
