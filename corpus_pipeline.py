"""A corpus pipeline: quality, near-duplicates, secrets, mixing, pieces.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All but the last return the columns of
documents: the first two drop rows (documents that the classifier rejects; all but one of each group of near-duplicates),
the third replaces secrets in the text, the fourth gives each row as often as the mix takes it. The last has a row for
each of those with its ids.

Defined cases: those of the operators. A null or empty text is scored, linked with nothing, holds no secret, has size 0
(the mix may take it, at no words); a null doc_id is kept and counts as held out; rows that
repeat count once from the second stage on; an empty table gives an empty result; further columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import mixing, near_dup, pieces, quality, secrets
from lodestone.llm.common import documents, settle
from lodestone.llm.queries import tokenizer


#: Documents are near-duplicates from so many percent of common shingles on; op3's own contract has 85.
NEAR_PERCENT = 80


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs, NEAR_PERCENT)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = pieces.encode_documents(docs, tokenizer("piece_bpe_32k.model"), lists=("ids",))
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [("quality", good_documents), ("near_duplicates", distinct_documents), ("secrets", without_secrets), ("mix", mixed_sources), ("pieces", encoded)]

#: SQL can express neither the classifier nor the mix; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
