"""The queries of the ten operators, each over its whole table, and the SQL that those which SQL can express must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversations, language, media, mixing, near_dup, negatives, pages, pieces, quality, repetition, secrets, spans, token_files
from .common import documents, spread
from .conversation_sql import op12_sql


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_index(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op2_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(documents(spark, sf_dir))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op5_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(documents(spark, sf_dir))


def op6_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(documents(spark, sf_dir)))


def op7_baseline_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media(documents(spark, sf_dir))


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.remove_repeats(documents(spark, sf_dir))


def op9_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op10_additive_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_anchor_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op12_streamed_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.damaged_report(spread(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op13_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(spread(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_files, op2_cube_mix, op3_bbit_minhash, op4_pieces, op5_suffix_repetition, op6_blob_ledger, op7_baseline_jpeg, op8_sentence_spans, op9_language_mixture, op10_additive_model, op11_anchor_tree_negatives, op12_streamed_repair, op13_page_differencing)}


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN list_aggregate(ws, 'string_agg', ' ') ELSE list_aggregate(ws[i : i + 4], 'string_agg', ' ') END AS sh
  FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i) WHERE len(ws) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)
), d AS (SELECT a AS u, b AS v FROM e UNION ALL SELECT b, a FROM e
), r AS (SELECT u, v FROM d UNION SELECT r.u, d.v FROM r JOIN d ON r.v = d.u
), c AS (SELECT u, least(u, min(v)) AS component_id FROM r GROUP BY u)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id, w.doc_id = coalesce(c.component_id, w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.u = w.doc_id
"""


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
), p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), n AS (
  SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INTEGER AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
)
SELECT * FROM n WHERE rank <= 5
"""


def _op6_sql() -> str:
    """A place is what the pieces and matches before it add up to."""
    kinds = []
    for rank, rule in enumerate(secrets.RULES):
        pattern = rule.pattern.replace("(?i:(password|passwd|secret|token|api_?key))", "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])").replace("'", "''")
        kinds.append(f"""SELECT doc_id, '{rule.kind}' AS kind, {rank} AS rank, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS g, string_split_regex(t, '{pattern}') AS b, {rule.least} AS least FROM t""")
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE)
    base = ", ".join(f"'{r.kind}'" for r in secrets.BASE)
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents
), k AS ({" UNION ALL ".join(kinds)}
), p AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM k WHERE len(m) > 0
), q AS (SELECT doc_id, kind, rank, list_sum(list_transform(b[1 : i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0)::BIGINT AS s, length(m[i]) AS n FROM p WHERE length(g[i]) >= least
), a AS (SELECT doc_id, {counts}, coalesce(string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rank) FILTER (kind IN ({base})), '') AS own, string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rank) AS spans FROM q GROUP BY doc_id)
SELECT t.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE)}, sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN a ON a.doc_id = t.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_bbit_minhash": OP3_SQL, "op6_blob_ledger": _op6_sql(), "op11_anchor_tree_negatives": OP11_SQL, "op12_streamed_repair": op12_sql()}
