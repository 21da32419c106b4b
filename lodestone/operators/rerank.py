"""Reranking and judging by pluggable models: what is sent, what is read from replies, and what is left on failure.

Replies are tables (query_id or batch_id, raw, error), so that recorded ones and a model's own are read alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import answers
from .fuse import RERANKED
from .providers import CAPS, capped, chain, with_backoff


def candidates(fused: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, items): the fused ids that have a text, in their order, at most 30, as an array of (id, text)."""
    held = fused.select("query_id", "id", "rank").join(texts.select("id", capped(F.col("text"), "chunk").alias("text")), "id").where("text <> ''")
    first = held.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id"))).where(F.col("place") <= CAPS["candidates"])
    listed = F.sort_array(F.collect_list(F.struct("place", "id", "text")))
    return first.groupBy("query_id").agg(F.transform(listed, lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text"))).alias("items"))


def asked(listed: DataFrame, questions: DataFrame, model: Callable[[str, list[str]], str]) -> DataFrame:
    """(query_id, raw, error): the model's reply to each question (query_id, text) and its candidates' texts, or why
    there is none. What may pass is tried again, as for all providers."""
    wide = questions.select("query_id", capped(F.col("text"), "query").alias("question")).join(listed, "query_id")

    def ask(question: str, texts: list[str]) -> tuple[str | None, str | None]:
        try:
            return with_backoff(lambda: model(question, texts)), None
        except Exception as e:  # noqa: BLE001  a provider may raise anything
            return None, str(e) or type(e).__name__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = [ask(q or "", t or []) for q, t in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array([x[i] for x in found], pa.string()) for i in (0, 1))], ["query_id", "raw", "error"])

    sent = wide.select("query_id", "question", F.transform("items", lambda x: x["text"]).alias("texts"))
    return sent.mapInArrow(run, f"query_id {dict(sent.dtypes)['query_id']}, raw string, error string")


def reranked(listed: DataFrame, replies: DataFrame, k: int = RERANKED, strict: bool = False) -> DataFrame:
    """(query_id, id, score, rank, degraded): the first k in the reply's order. A reply is an object whose `response`
    lists (id, score), id being a candidate's place from 0; places that no candidate has are dropped. Without a usable
    reply the fused order stays, with scores 1 - place / n and the reason; `strict` makes that an error, since such a
    row repeats the fused one."""
    wide = listed.join(replies, "query_id", "left").withColumn("n", F.size("items"))
    given = F.from_json(F.to_json(answers.field(F.try_parse_json("raw"), "response")), "array<variant>")
    wide = wide.withColumn("given", F.coalesce(given, F.array().cast("array<variant>")))
    placed = F.transform("given", lambda x: F.struct(F.try_variant_get(x, "$.id", "double").alias("at"), F.try_variant_get(x, "$.score", "double").alias("score")))
    wide = wide.withColumn("usable", F.filter(placed, lambda x: F.coalesce((x["at"] == F.floor(x["at"])) & (x["at"] >= 0) & (x["at"] < F.col("n")), F.lit(False))))
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(F.size("given") == 0, "reranker returned nothing").when(F.size("usable") == 0, "reranker returned no usable indices")
    ranked = F.transform("usable", lambda x: F.struct(F.get("items", x["at"].cast("int"))["id"].alias("id"), x["score"].alias("score")))
    fused = F.transform("items", lambda x, i: F.struct(x["id"].alias("id"), (1 - i / F.col("n")).alias("score")))
    kept = F.raise_error(F.concat(F.lit("reranker degraded: "), F.col("reason"))) if strict else fused
    wide = wide.withColumn("reason", reason).withColumn("best", F.when(F.col("reason").isNull(), ranked).otherwise(kept))
    return wide.select("query_id", F.posexplode(F.slice("best", 1, k)).alias("i", "x"), "reason").select("query_id", "x.id", "x.score", (F.col("i") + 1).alias("rank"), F.col("reason").alias("degraded"))


def scores(replies: DataFrame) -> DataFrame:
    """replies (batch_id, n, raw) to (batch_id, idx, score), a row for each of n pairs: the number at its place in the
    reply's `scores`, null unless that is a number from 0 to 1. An outage is no verdict, so it is never 0."""
    given = F.from_json(F.to_json(answers.field(F.try_parse_json("raw"), "scores")), "array<variant>")
    rows = replies.where("n > 0").select("batch_id", given.alias("given"), F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("idx"))
    own = F.get("given", F.col("idx"))
    value = F.try_variant_get(own, "$", "double")
    number = answers.kind_of(own).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
    return rows.select("batch_id", "idx", F.when(number & value.between(0.0, 1.0), value).alias("score"))


def pair_prompt(pairs: Column) -> Column:
    """What a judge is asked about an array of (sentence, evidence): a verdict for every numbered pair."""
    rule = "Below are numbered pairs of a claim and a text. Take every pair by itself and answer each number with one verdict. Say supported where the text alone shows all that the claim states, partially_supported where it shows only some of it, and not_supported otherwise. Claims and texts may be in different languages."
    blocks = F.transform(pairs, lambda x, i: F.concat(F.lit("[pair "), i.cast("string"), F.lit("]\nevidence: "), capped(x["evidence"], "chunk"), F.lit("\nclaim: "), capped(x["sentence"], "sentence")))
    return F.concat(F.lit(rule + "\n\n"), F.array_join(blocks, "\n\n"))


def batched(pairs: DataFrame, keys: tuple[str, ...] = ("answer_id",), order: tuple[str, ...] = ("claim_idx", "n"), size: int = CAPS["pairs"]) -> DataFrame:
    """(keys, batch, pairs): pairs (keys, order, sentence, evidence) of each key in requests of at most `size`."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    dealt = pairs.withColumn("at", at).withColumn("batch", F.floor(F.col("at") / size).cast("int"))
    listed = F.sort_array(F.collect_list(F.struct("at", "sentence", "evidence")))
    return dealt.groupBy(*keys, "batch").agg(F.transform(listed, lambda x: F.struct(x["sentence"].alias("sentence"), x["evidence"].alias("evidence"))).alias("pairs"))


def entail(batches: DataFrame, models: list[tuple[str, Callable[[str], str]]], **options) -> DataFrame:
    """(batch_id, idx, score, model, degraded) of batches (batch_id, pairs): the verdicts of the first model that
    answers; null scores and all reasons where none did. options: those of `chain`."""
    replies = chain(batches.select("batch_id", F.size("pairs").alias("n"), pair_prompt(F.col("pairs")).alias("prompt")), "prompt", models, **options)
    read = answers.verdicts(replies.select("batch_id", "n", F.col("answer").alias("raw")))
    return read.join(replies.select("batch_id", "model", "degraded"), "batch_id")
