"""Resolving a graded question set's anchors to chunks, and what the set looks like."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunk import exact_quantiles


def matches(anchors: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, grade, doc_id, heading, id): anchors (query_id, grade, doc_id, heading) with the chunks whose path, or
    a heading line in whose text, holds the heading in any case; all chunks of the document without a heading."""
    needle = F.lower("heading")
    in_path = F.exists("heading_path", lambda h: F.contains(F.lower(h), needle))
    in_text = F.exists(F.split("text", "\n"), lambda x: F.startswith(x, F.lit("#")) & F.contains(F.lower(x), needle))
    wide = anchors.join(chunks.select("id", "doc_id", "heading_path", "text"), "doc_id")
    return wide.where(F.col("heading").isNull() | in_path | in_text).select("query_id", "grade", "doc_id", "heading", "id")


def anchors(golden: DataFrame) -> DataFrame:
    """golden (id, kind, primary, related) as rows; related defaults to the primary anchors' whole documents."""
    whole = F.array_distinct(F.transform("primary", lambda a: F.struct(a["doc_id"].alias("doc_id"), F.lit(None).cast("string").alias("heading"))))
    related = F.coalesce("related", whole)
    both = F.concat(F.transform("primary", lambda a: F.struct(F.lit(2).alias("grade"), a["doc_id"].alias("doc_id"), a["heading"].alias("heading"))), F.transform(related, lambda a: F.struct(F.lit(1).alias("grade"), a["doc_id"].alias("doc_id"), a["heading"].alias("heading"))))
    return golden.select(F.col("id").alias("query_id"), F.explode(both).alias("a")).select("query_id", "a.*")


def resolve(golden: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(qrels (query_id, id, grade), problems (query_id, problem)): of two grades of one chunk the higher counts. A
    problem is an anchor, primary or related, that no chunk matches, a refusal with anchors, or another question without
    any primary chunk."""
    asked = anchors(golden)
    found = matches(asked, chunks)
    qrels = found.groupBy("query_id", "id").agg(F.max("grade").alias("grade"))
    hit = found.select("query_id", "doc_id", F.coalesce("heading", F.lit("")).alias("named")).distinct()
    missing = asked.withColumn("named", F.coalesce("heading", F.lit(""))).join(hit, ["query_id", "doc_id", "named"], "left_anti")
    refused = golden.where((F.col("kind") == "refusal") & (F.size("primary") > 0)).select(F.col("id").alias("query_id"), F.lit("a refusal has anchors").alias("problem"))
    empty = unresolved(golden, qrels).select("query_id", F.lit("no primary chunk").alias("problem"))
    return qrels, missing.select("query_id", F.concat(F.lit("no chunk of "), "doc_id", F.lit(" matches "), F.coalesce("heading", F.lit("the document"))).alias("problem")).unionByName(refused).unionByName(empty)


def unresolved(golden: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id) of the questions that aren't refusals and have no primary chunk."""
    return golden.where(F.col("kind") != "refusal").select(F.col("id").alias("query_id")).join(qrels.where("grade = 2").select("query_id"), "query_id", "left_anti")


def resolved(golden: DataFrame, chunks: DataFrame) -> DataFrame:
    """qrels, or an error that names the first problems: scores against a set that lost its chunks mean nothing."""
    qrels, problems = resolve(golden, chunks)
    found = problems.orderBy("query_id", "problem").limit(20).collect()
    if found:
        raise ValueError("the question set doesn't resolve:\n" + "\n".join(f"{r['query_id']}: {r['problem']}" for r in found))
    return qrels


def report(golden: DataFrame, qrels: DataFrame) -> DataFrame:
    """(kind, questions, primary, related) for each kind."""
    sizes = qrels.groupBy("query_id").agg(F.count_if(F.col("grade") == 2).alias("primary"), F.count_if(F.col("grade") == 1).alias("related"))
    return golden.select(F.col("id").alias("query_id"), "kind").join(sizes, "query_id", "left").groupBy("kind").agg(F.count("*").alias("questions"), F.coalesce(F.sum("primary"), F.lit(0)).alias("primary"), F.coalesce(F.sum("related"), F.lit(0)).alias("related"))


def widths(questions: DataFrame, qrels: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row over the questions (query_id, kind) that aren't refusals: smallest, middle and largest number of primary
    chunks, the widest graded set, and its share of all chunks."""
    sizes = qrels.groupBy("query_id").agg(F.count_if(F.col("grade") == 2).alias("size"), F.count("*").alias("graded"))
    of = questions.where(F.col("kind") != "refusal").select("query_id").join(sizes, "query_id", "left").select(F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("graded", F.lit(0)).alias("graded"))
    spread = exact_quantiles(of.select("size"), "size", {"least": 0.0, "median": 0.5, "most": 1.0})
    widest = of.agg(F.max("graded").alias("widest")).crossJoin(chunks.agg(F.count("*").alias("chunks")))
    return spread.crossJoin(widest).select("n", "least", "median", "most", "widest", F.coalesce(F.col("widest") / F.nullif("chunks", F.lit(0)), F.lit(0.0)).alias("share"))  # one row each
