"""Reciprocal-rank fusion, its votes, and what separates rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bm25 import CANDIDATES

RRF_K = 60
RERANKED = 8


def union(rankings: dict[str, DataFrame]) -> DataFrame:
    """(retriever, query_id, id, score, rank) of several rankings."""
    out = None
    for name, frame in rankings.items():
        named = frame.select(F.lit(name).alias("retriever"), "query_id", "id", "score", "rank")
        out = named if out is None else out.unionByName(named)
    return out


def rrf(rankings: DataFrame, k: int = RRF_K, top: int = CANDIDATES, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(keys, id, score, rank): sums of 1 / (k + rank) over all lists; an id that repeats in a list adds again; ties go
    to the lower id."""
    scored = rankings.groupBy(*keys, "id").agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"))
    order = Window.partitionBy(*keys).orderBy(F.round("score", 12).desc(), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def sweep(rankings: DataFrame, ks: tuple[int, ...], top: int = CANDIDATES) -> DataFrame:
    """(k, query_id, id, score, rank) for each k: the lists are read once for all."""
    wide = rankings.select("*", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    scored = wide.groupBy("k", "query_id", "id").agg(F.sum(1.0 / (F.col("k") + F.col("rank"))).alias("score"))
    order = Window.partitionBy("k", "query_id").orderBy(F.round("score", 12).desc(), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def votes(rankings: DataFrame, retrievers: list[str], k: int = RRF_K) -> DataFrame:
    """(query_id, id, vote of each retriever, score): 0 for a list that lacks the id."""
    parts = [F.sum(F.when(F.col("retriever") == r, 1.0 / (F.lit(k) + F.col("rank"))).otherwise(0.0)).alias(f"vote_{r}") for r in retrievers]
    return rankings.groupBy("query_id", "id").agg(*parts, F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"))


def only_in(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(query_id, id, rank) of a's first k that aren't among b's."""
    return a.where(F.col("rank") <= k).join(b.where(F.col("rank") <= k), ["query_id", "id"], "left_anti").select("query_id", "id", "rank")


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, n_union, n_both, n_first, n_second)"""
    both = a.select("query_id", "id", F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select("query_id", "id", F.lit(0).alias("x"), F.lit(1).alias("y"))).groupBy("query_id", "id").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    return both.groupBy("query_id").agg(F.count("*").alias("n_union"), F.count_if((F.col("x") == 1) & (F.col("y") == 1)).alias("n_both"), F.count_if(F.col("y") == 0).alias("n_first"), F.count_if(F.col("x") == 0).alias("n_second"))


def movement(final: DataFrame, fused: DataFrame, head: int = RERANKED) -> DataFrame:
    """(query_id, id, final_rank, fused_rank, moved, outside): moved is null where the fused list lacks the id."""
    before = fused.select("query_id", "id", F.col("rank").alias("fused_rank"))
    return final.select("query_id", "id", F.col("rank").alias("final_rank")).join(before, ["query_id", "id"], "left").select("query_id", "id", "final_rank", "fused_rank", (F.col("fused_rank") - F.col("final_rank")).alias("moved"), F.coalesce(F.col("fused_rank") > head, F.lit(True)).alias("outside"))


def movement_summary(moves: DataFrame) -> DataFrame:
    """For each query: promoted, held, demoted and from outside the head, and who moved most."""
    return moves.groupBy("query_id").agg(F.count_if(F.col("moved") > 0).alias("promoted"), F.count_if(F.col("moved") == 0).alias("held"), F.count_if(F.col("moved") < 0).alias("demoted"), F.count_if("outside").alias("from_outside"), F.min(F.when(F.col("moved").isNotNull(), F.struct((-F.abs("moved")).alias("by"), "id")))["id"].alias("most_moved"))


def rerank_fallback(fused: DataFrame, k: int = RERANKED) -> DataFrame:
    """What a reranker that fails leaves: the fused order, with scores 1 - place / n, and the reason."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    return fused.withColumn("score", 1 - (F.col("rank") - 1) / n).where(F.col("rank") <= k).select("query_id", "id", "score", "rank", F.lit("reranker unavailable").alias("degraded"))
