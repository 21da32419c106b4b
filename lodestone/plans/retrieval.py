"""Queries about tokens, rankings, vectors, fusion and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import display
from ..functions import text as T
from ..functions import vectors as V
from ..operators import blockmax, bm25, contain, dense, fuse, golden, metrics, providers
from ..sources import embedding_cache
from ..sources.scratch import scratch, settle, spread
from . import sql
from .registry import query, table

PARAMS = [(1.2, 0.0), (1.2, 0.75), (1.2, 1.0), (0.6, 0.75), (2.0, 0.75)]
RRF_KS = (1, 10, 60, 200)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and every twentieth as queries."""
    all_ = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return all_, all_.where(F.col("id") % 20 == 0).withColumnRenamed("id", "query_id")


def r6(c: str | Column) -> Column:
    return F.round(c, 6)


def shown(ranking: DataFrame, *more: str) -> DataFrame:
    return ranking.select(*more, "query_id", "id", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"SELECT doc_id, len(t)::BIGINT AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {sql.tokens('text')} AS t FROM documents)")
def tokenize_documents(spark, sf_dir):
    t = spread(table(spark, sf_dir, "documents")).select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(f"SELECT doc_id, len(t)::BIGINT AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {sql.plain_tokens('text')} AS t FROM documents)")
def plain_tokens(spark, sf_dir):
    t = spread(table(spark, sf_dir, "documents")).select("doc_id", T.plain_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(f"SELECT doc_id, len(string_split(p, '{sql.CUT}'))::BIGINT AS n_pieces, md5(p) AS digest FROM (SELECT doc_id, {sql.camel('text')} AS p FROM documents)")
def camel_boundaries(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", F.split("text", T.CAMEL).alias("p"))
    return t.select("doc_id", F.size("p").cast("long").alias("n_pieces"), F.md5(F.array_join("p", sql.CUT)).alias("digest"))


@query(f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({sql.tokens('text')}) AS term FROM documents) GROUP BY term")
def token_df(spark, sf_dir):
    return bm25.postings(docs(spark, sf_dir)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(f"SELECT count(*) AS n, round(sum(len(t))::DOUBLE / count(*), 6) AS avgdl FROM (SELECT {sql.tokens('text')} AS t FROM documents)")
def bm25_stats(spark, sf_dir):
    return bm25.statistics(docs(spark, sf_dir)).select("n", r6("avgdl").alias("avgdl"))


@query(f"SELECT term, round(ln(1::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({sql.tokens('text')}) AS term FROM documents) GROUP BY term), (SELECT count(*) AS n FROM documents)")
def bm25_idf(spark, sf_dir):
    n = docs(spark, sf_dir).agg(F.count("*").alias("n"))
    return bm25.frequencies(bm25.postings(docs(spark, sf_dir))).crossJoin(F.broadcast(n)).select("term", r6(bm25.idf(F.col("n"), F.col("df"))).alias("idf"))


@query(f"WITH {sql.bm25()} SELECT query_id, id, round(score, 6) AS score, rank FROM r")
def bm25_topk(spark, sf_dir):
    return shown(bm25.search(docs(spark, sf_dir), asked(spark, sf_dir)))


@query(f"WITH {sql.bm25()} SELECT query_id, id, round(score, 6) AS score, rank FROM r")
def bm25_blocks_topk(spark, sf_dir):
    """Over an index of blocks that is written first: blocks that can't reach a query's first 30 are skipped."""
    return shown(blockmax.search_documents(docs(spark, sf_dir), asked(spark, sf_dir)))


@query(f"WITH {sql.bm25(sql.plain_tokens)} SELECT query_id, id, round(score, 6) AS score, rank FROM r")
def bm25_plain_topk(spark, sf_dir):
    return shown(bm25.search(docs(spark, sf_dir), asked(spark, sf_dir), tokens=T.plain_tokens))


_SWEEP = f"""WITH {sql.bm25()}, pr AS (SELECT unnest([{", ".join(f"{{'k1': {a}::DOUBLE, 'b': {b}::DOUBLE}}" for a, b in PARAMS)}], recursive := true)),
z AS (SELECT k1, b, query_id, id, sum(idf * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * len / avgdl))) AS score, min(pos) AS first FROM w, pr GROUP BY ALL)
SELECT k1, b, query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY k1, b, query_id ORDER BY round(score, 9) DESC, first, id) AS rank FROM z) WHERE rank <= 30"""


@query(_SWEEP)
def bm25_param_sweep(spark, sf_dir):
    return shown(bm25.sweep(docs(spark, sf_dir), asked(spark, sf_dir), PARAMS), "k1", "b")


_EXPLAIN = f"""WITH {sql.bm25()}, t AS (SELECT query_id, id FROM r)
SELECT t.query_id, t.id, q.term, coalesce(f.df, 0) AS df, round(coalesce(ln(1::DOUBLE + (n - f.df + 0.5::DOUBLE) / (f.df + 0.5::DOUBLE)), 0), 6) AS idf, coalesce(w.tf, 0) AS tf, round(coalesce(w.idf * (w.tf * 2.2::DOUBLE) / (w.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * w.len / w.avgdl)), 0), 6) AS score
FROM t JOIN q ON q.query_id = t.query_id LEFT JOIN f ON f.term = q.term LEFT JOIN w ON w.query_id = t.query_id AND w.id = t.id AND w.term = q.term, st"""


def explained(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(the terms of all hits, the statistics): searched and explained from one table of tokens."""
    own = asked(spark, sf_dir)
    listed = bm25.tokenized(docs(spark, sf_dir))
    found = bm25.matches_of(listed, own)
    hits = settle(bm25.scored(found, bm25.CANDIDATES).select("query_id", "id"), "hits")
    return bm25.explain_matches(found, own, hits), listed


@query(_EXPLAIN)
def bm25_explain(spark, sf_dir):
    return explained(spark, sf_dir)[0].select("query_id", "id", "term", "df", r6("idf").alias("idf"), "tf", r6("score").alias("score"))


@query(f"""WITH {sql.bm25()}, e AS (SELECT r.query_id, r.id, q.pos, q.term, coalesce(f.df, 0) AS df, coalesce(w.tf, 0) AS tf, coalesce(w.idf * (w.tf * 2.2::DOUBLE) / (w.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * w.len / w.avgdl)), 0) AS score FROM r JOIN q ON q.query_id = r.query_id LEFT JOIN f ON f.term = q.term LEFT JOIN w ON w.query_id = r.query_id AND w.id = r.id AND w.term = q.term)
SELECT query_id, id, array_to_string(list(term ORDER BY round(score, 9) DESC, pos) FILTER (tf > 0), ' ') AS present, coalesce(array_to_string(list(term ORDER BY pos) FILTER (tf = 0 AND df > 0), ' '), '') AS absent, round(sum(score), 6) AS total, (SELECT round(avgdl) FROM st)::BIGINT AS avgdl FROM e GROUP BY query_id, id""")
def term_summary(spark, sf_dir):
    """Which terms of its query each hit holds, and which only others do."""
    parts, listed = explained(spark, sf_dir)
    stats = listed.agg(F.avg(F.size("tokens")).alias("avgdl"))
    return bm25.term_summary(parts, stats).select("query_id", "id", F.array_join("present", " ").alias("present"), F.array_join("absent", " ").alias("absent"), r6("total").alias("total"), "avgdl")


_DIAG = f"""WITH d AS (SELECT doc_id, unnest(list_distinct({sql.tokens('text')})) AS term FROM documents), f AS (SELECT term, count(*) AS df FROM d GROUP BY term),
q AS (SELECT item_id AS query_id, {sql.tokens('text')} AS t FROM benchmark), u AS (SELECT query_id, unnest(list_distinct(t)) AS term FROM q),
j AS (SELECT query_id, u.term, df FROM u LEFT JOIN f ON f.term = u.term)
SELECT q.query_id, len(t)::BIGINT AS n_tokens, count(j.term) AS n_distinct, count(df) AS n_known, count(j.term) - count(df) AS n_missing,
 arg_min(j.term, (df, j.term)) FILTER (df IS NOT NULL) AS rarest, arg_min(j.term, (-df, j.term)) FILTER (df IS NOT NULL) AS commonest
FROM q LEFT JOIN j ON j.query_id = q.query_id GROUP BY q.query_id, t"""


@query(_DIAG)
def query_token_diagnostics(spark, sf_dir):
    return bm25.diagnostics(docs(spark, sf_dir), asked(spark, sf_dir))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, len(embedding)::INTEGER AS width FROM embeddings")
def vector_norms(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", r6(V.norm(F.col("embedding"))).alias("norm"), F.size("embedding").alias("width"))


@query(f"WITH {sql.CODES} SELECT vec_id, round(scale::DOUBLE, 9) AS scale, array_to_string(codes, ' ') AS codes FROM c")
def quantize_codes(spark, sf_dir):
    c = table(spark, sf_dir, "embeddings").select("vec_id", V.quantize(F.col("embedding")).alias("c"))
    return c.select("vec_id", F.round(F.col("c.scale").cast("double"), 9).alias("scale"), F.array_join(F.transform("c.codes", lambda x: x.cast("string")), " ").alias("codes"))


@query(f"WITH {sql.CODES}, {sql.dense(sql.INT8_SCORE)} SELECT query_id, id, round(score, 6) AS score, rank FROM dr")
def dense_int8_topk(spark, sf_dir):
    return shown(dense.search_int8(*vectors(spark, sf_dir)))


@query(f"WITH {sql.CODES}, {sql.dense(sql.FLOAT_SCORE)} SELECT query_id, id, round(score, 6) AS score, rank FROM dr")
def dense_float_topk(spark, sf_dir):
    return shown(dense.search_float(*vectors(spark, sf_dir)))


@query(f"WITH {sql.CODES}, {sql.dense(sql.INT8_SCORE, '8')}, {sql.dense(sql.FLOAT_SCORE, 'f')} SELECT a.query_id, count(b.id) / 10.0::DOUBLE AS shared FROM dr8 a LEFT JOIN drf b ON b.query_id = a.query_id AND b.id = a.id AND b.rank <= 10 WHERE a.rank <= 10 GROUP BY a.query_id")
def int8_float_agreement(spark, sf_dir):
    v, q = vectors(spark, sf_dir)
    return dense.agreement(dense.search_int8(v, q, 10), dense.search_float(v, q, 10))


@query(f"WITH {sql.CODES} SELECT vec_id, round(list_sum(list_transform(list_zip(u, codes), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (sqrt(list_sum(list_transform(u, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(codes, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS cosine FROM c")
def cosine_calibration(spark, sf_dir):
    u = table(spark, sf_dir, "embeddings").select("vec_id", V.l2_normalize(F.col("embedding")).alias("u"), V.quantize(F.col("embedding"))["codes"].alias("codes"))
    return u.select("vec_id", r6(V.cosine(F.col("u"), F.col("codes"))).alias("cosine"))


def two_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Of the full and of the plain tokenizer: the texts are read and cut once for both."""
    own = asked(spark, sf_dir)
    full, plain = bm25.two_counted(docs(spark, sf_dir), bm25.two_terms(own))
    return tuple(settle(bm25.search_counted(counts, own, tokens=f), name) for counts, name, f in ((full, "full", T.tokens), (plain, "plain", T.plain_tokens)))


_TWO = f"WITH {sql.bm25()}, {sql.bm25(sql.plain_tokens, name='2')}, l AS (SELECT 'full' AS retriever, * FROM r UNION ALL SELECT 'plain', * FROM r2)"
_FUSED = "fz AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM l GROUP BY ALL), fr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS rank FROM fz) WHERE rank <= 30)"


def fused(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    a, b = two_lists(spark, sf_dir)
    return a, b, fuse.rrf(fuse.union({"full": a, "plain": b}))


@query(f"{_TWO}, {_FUSED} SELECT query_id, id, round(score, 6) AS score, rank FROM fr")
def rrf_fuse(spark, sf_dir):
    return shown(fused(spark, sf_dir)[2])


@query(f"{_TWO}, ks AS (SELECT unnest({list(RRF_KS)})::INTEGER AS k), z AS (SELECT k, query_id, id, sum(1.0::DOUBLE / (k + rank)) AS score FROM l, ks GROUP BY ALL) SELECT k, query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY k, query_id ORDER BY round(score, 12) DESC, id) AS rank FROM z) WHERE rank <= 30")
def rrf_k_sweep(spark, sf_dir):
    a, b = two_lists(spark, sf_dir)
    wide = fuse.union({"full": a, "plain": b}).select("*", F.explode(F.array(*map(F.lit, RRF_KS))).alias("k"))
    scored = wide.groupBy("k", "query_id", "id").agg(F.sum(1.0 / (F.col("k") + F.col("rank"))).alias("score"))
    return shown(bm25.ranked(scored.withColumn("score", F.round("score", 12)), 30, ("k", "query_id"), ("id",)), "k")


@query(f"{_TWO} SELECT query_id, id, round(sum(CASE WHEN retriever = 'full' THEN 1.0::DOUBLE / (60 + rank) ELSE 0 END), 6) AS vote_full, round(sum(CASE WHEN retriever = 'plain' THEN 1.0::DOUBLE / (60 + rank) ELSE 0 END), 6) AS vote_plain, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM l GROUP BY ALL")
def rrf_votes(spark, sf_dir):
    a, b = two_lists(spark, sf_dir)
    return fuse.votes(fuse.union({"full": a, "plain": b}), ["full", "plain"]).select("query_id", "id", *[r6(c).alias(c) for c in ("vote_full", "vote_plain", "score")])


_BY_RANK = "l2 AS (SELECT * FROM l WHERE retriever = 'full' AND rank <= 12 OR retriever = 'plain' AND rank > 4), fz2 AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM l2 GROUP BY ALL), fr2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS rank FROM fz2)"


def differing(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two lists that differ, the first's best 12 and the second without its best 4, and their fusion."""
    a, b = two_lists(spark, sf_dir)
    a, b = a.where("rank <= 12"), b.where("rank > 4")
    return a, b, fuse.rrf(fuse.union({"full": a, "plain": b}))


@query(f"{_TWO}, {_BY_RANK} SELECT f.query_id, f.id, f.rank FROM fr2 f LEFT JOIN l2 ON l2.retriever = 'full' AND l2.query_id = f.query_id AND l2.id = f.id AND l2.rank <= 10 WHERE f.rank <= 10 AND l2.id IS NULL")
def fused_not_in_first(spark, sf_dir):
    a, _, f = differing(spark, sf_dir)
    return fuse.only_in(f, a, 10).withColumn("rank", F.col("rank").cast("long"))


@query(f"{_TWO}, {_BY_RANK} SELECT f.query_id, f.id, f.rank FROM fr2 f LEFT JOIN l2 ON l2.retriever = 'plain' AND l2.query_id = f.query_id AND l2.id = f.id AND l2.rank <= 10 WHERE f.rank <= 10 AND l2.id IS NULL")
def fused_not_in_second(spark, sf_dir):
    _, b, f = differing(spark, sf_dir)
    return fuse.only_in(f, b, 10).withColumn("rank", F.col("rank").cast("long"))


@query(f"{_TWO} SELECT coalesce(r.query_id, r2.query_id) AS query_id, count(*) AS n_union, count(*) FILTER (r.id IS NOT NULL AND r2.id IS NOT NULL) AS n_both, count(*) FILTER (r2.id IS NULL) AS n_first, count(*) FILTER (r.id IS NULL) AS n_second FROM r FULL JOIN r2 ON r2.query_id = r.query_id AND r2.id = r.id GROUP BY ALL")
def candidate_overlap(spark, sf_dir):
    return fuse.overlap(*two_lists(spark, sf_dir))


_MOVED = f"{_TWO}, {_FUSED}, m AS (SELECT r.query_id, r.id, r.rank AS final_rank, fr.rank AS fused_rank, fr.rank - r.rank AS moved, coalesce(fr.rank > 8, true) AS outside FROM r LEFT JOIN fr ON fr.query_id = r.query_id AND fr.id = r.id WHERE r.rank <= 8)"


@query(f"{_MOVED} SELECT query_id, id, final_rank, fused_rank, moved, outside FROM m")
def rank_movement(spark, sf_dir):
    a, _, f = fused(spark, sf_dir)
    return fuse.movement(a.where("rank <= 8"), f).select("query_id", "id", *[F.col(c).cast("long").alias(c) for c in ("final_rank", "fused_rank", "moved")], "outside")


@query(f"{_MOVED} SELECT query_id, count(*) FILTER (moved > 0) AS promoted, count(*) FILTER (moved = 0) AS held, count(*) FILTER (moved < 0) AS demoted, count(*) FILTER (outside) AS from_outside, arg_min(id, (-abs(moved), id)) FILTER (moved IS NOT NULL) AS most_moved FROM m GROUP BY query_id")
def movement_summary(spark, sf_dir):
    a, _, f = fused(spark, sf_dir)
    return fuse.movement_summary(fuse.movement(a.where("rank <= 8"), f))


@query(f"{_TWO}, {_FUSED} SELECT query_id, id, round(1 - (rank - 1) / (count(*) OVER (PARTITION BY query_id))::DOUBLE, 6) AS score, rank, 'reranker unavailable' AS degraded FROM fr QUALIFY rank <= 8")
def rerank_fallback(spark, sf_dir):
    return fuse.rerank_fallback(fused(spark, sf_dir)[2]).select("query_id", "id", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"), "degraded")


def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, id, grade): documents that hold the first inner window of eight words of a passage of 10 words and
    more; one that holds the whole passage is primary. Written, as several measures are taken against it."""
    passages = asked(spark, sf_dir).withColumn("w", T.words(F.col("text"))).where(F.size("w") >= 10).select("query_id", F.col("text").alias("passage"), F.array_join(F.slice("w", 2, 8), " ").alias("text"))
    held = contain.containing(docs(spark, sf_dir), passages.select("query_id", "text")).join(passages.select("query_id", "passage"), "query_id")
    return settle(held.select("query_id", "id", F.when(F.contains("text", F.col("passage")), 2).otherwise(1).alias("grade")), "relevance")


@query(f"WITH {sql.QRELS} SELECT query_id, id, grade FROM qrels")
def passage_relevance(spark, sf_dir):
    return relevance(spark, sf_dir)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("identifier", "conceptual", "design", "refusal")))
    return asked(spark, sf_dir).select("query_id", F.element_at(kinds, (F.col("query_id") % 4 + 1).cast("int")).alias("kind"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, f = fused(spark, sf_dir)
    return settle(metrics.per_question(fuse.union({"full": a, "plain": b, "fused": f}), relevance(spark, sf_dir), questions(spark, sf_dir)), "scores")


_NAMES = [*(f"recall_{k}" for k in metrics.CUTS), *(f"success_{k}" for k in metrics.CUTS), "mrr", "ndcg_10"]
_HITS = ", ".join(f"count(*) FILTER (rank <= {k} AND grade = 2) AS h{k}" for k in metrics.CUTS)
_NP = f"""np AS (SELECT query_id, count(*) FILTER (grade = 2) AS np, sum(CASE WHEN i <= 10 THEN (2 ** grade - 1) / log2(i + 1) ELSE 0 END) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS i FROM qrels) GROUP BY query_id),
ht AS (SELECT retriever, query_id, {_HITS}, min(rank) FILTER (grade = 2) AS fst, coalesce(sum((2 ** grade - 1) / log2(rank + 1)) FILTER (rank <= 10), 0) AS dcg FROM al JOIN qrels USING (query_id, id) GROUP BY ALL),
pq AS (SELECT rt.retriever, q.query_id, q.kind, {", ".join(f"CASE WHEN coalesce(np, 0) = 0 THEN 1.0::DOUBLE ELSE coalesce(h{k}, 0)::DOUBLE / least(np, {k}) END AS recall_{k}, CASE WHEN coalesce(np, 0) = 0 THEN 1.0::DOUBLE ELSE (coalesce(h{k}, 0) > 0)::INTEGER::DOUBLE END AS success_{k}" for k in metrics.CUTS)},
 CASE WHEN coalesce(np, 0) = 0 THEN 1.0::DOUBLE ELSE coalesce(1.0::DOUBLE / fst, 0) END AS mrr, CASE WHEN ideal IS NULL THEN 1.0::DOUBLE ELSE coalesce(dcg, 0) / ideal END AS ndcg_10
 FROM questions q CROSS JOIN (SELECT DISTINCT retriever FROM al) rt LEFT JOIN np ON np.query_id = q.query_id LEFT JOIN ht ON ht.query_id = q.query_id AND ht.retriever = rt.retriever)"""
_PER = f"{_TWO}, {_FUSED}, {sql.QRELS}, al AS (SELECT * FROM l UNION ALL SELECT 'fused', query_id, id, score, rank FROM fr), {_NP}"


@query(f"{_PER} SELECT retriever, query_id, kind, {', '.join(f'round({n}, 6) AS {n}' for n in _NAMES)} FROM pq")
def question_metrics(spark, sf_dir):
    return scores(spark, sf_dir).select("retriever", "query_id", "kind", *[r6(n).alias(n) for n in _NAMES])


@query(f"{_PER} SELECT retriever, kind, count(*) AS n, {', '.join(f'round(avg({n}), 6) AS {n}' for n in _NAMES)} FROM pq WHERE kind <> 'refusal' GROUP BY GROUPING SETS ((retriever, kind), (retriever))")
def ablation_table(spark, sf_dir):
    return metrics.ablation(scores(spark, sf_dir)).select("retriever", "kind", "n", *[r6(n).alias(n) for n in _NAMES])


@query(f"{_PER} SELECT retriever, '| ' || retriever || ' | ' || printf('%.1f', 100 * avg(recall_10)) || ' | ' || printf('%.3f', avg(mrr)) || ' |' AS line FROM pq WHERE kind <> 'refusal' GROUP BY retriever")
def ablation_report(spark, sf_dir):
    means = metrics.ablation(scores(spark, sf_dir)).where("kind IS NULL")
    return means.select("retriever", display.report_row(F.col("retriever"), [(100 * F.col("recall_10"), "%.1f"), (F.col("mrr"), "%.3f")], F.col("n") > 0).alias("line"))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rankings of every variant, named group:variant. The texts are cut once, and the full tokenizer's postings serve
    all parameters."""
    own = asked(spark, sf_dir)
    full, plain = bm25.two_counted(docs(spark, sf_dir), bm25.two_terms(own))
    plain = settle(bm25.search_counted(plain, own, tokens=T.plain_tokens), "plain")
    swept = settle(bm25.sweep_counted(full, own, PARAMS), "swept")
    full = swept.where("k1 = 1.2 AND b = 0.75")
    fused_by = fuse.sweep(fuse.union({"full": full, "plain": plain}), RRF_KS)
    columns = ("query_id", "id", "score", "rank")
    by_params = swept.select(F.format_string("bm25:k1=%.1f,b=%.2f", "k1", "b").alias("retriever"), *columns)
    by_k = fused_by.select(F.format_string("fusion:k=%d", "k").alias("retriever"), *columns)
    return fuse.union({"tokenizer:plain": plain, "tokenizer:full": full}).unionByName(by_params).unionByName(by_k)


_VARIANTS = f"""{_TWO}, {sql.QRELS}, pr AS (SELECT unnest([{", ".join(f"{{'k1': {a}::DOUBLE, 'b': {b}::DOUBLE}}" for a, b in PARAMS)}], recursive := true)),
bz AS (SELECT k1, b, query_id, id, sum(idf * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * len / avgdl))) AS score, min(pos) AS first FROM w, pr GROUP BY ALL),
ks AS (SELECT unnest({list(RRF_KS)})::INTEGER AS k), kz AS (SELECT k, query_id, id, sum(1.0::DOUBLE / (k + rank)) AS score FROM l, ks GROUP BY ALL),
al AS (SELECT 'tokenizer:' || retriever AS retriever, query_id, id, rank FROM l
 UNION ALL SELECT * FROM (SELECT printf('bm25:k1=%.1f,b=%.2f', k1, b), query_id, id, row_number() OVER (PARTITION BY k1, b, query_id ORDER BY round(score, 9) DESC, first, id) AS rank FROM bz) WHERE rank <= 30
 UNION ALL SELECT * FROM (SELECT 'fusion:k=' || k, query_id, id, row_number() OVER (PARTITION BY k, query_id ORDER BY round(score, 12) DESC, id) AS rank FROM kz) WHERE rank <= 30), {_NP}"""


def variant_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(metrics.per_question(settle(variants(spark, sf_dir), "variants"), relevance(spark, sf_dir), questions(spark, sf_dir)), "scores")


@query(f"""{_VARIANTS} SELECT string_split(retriever, ':')[1] AS "group", retriever AS variant, count(*) AS n, {', '.join(f'round(avg({n}), 6) AS {n}' for n in ('recall_10', 'success_5', 'mrr', 'ndcg_10'))}, {', '.join(f"round(coalesce(avg(recall_10) FILTER (kind = '{k}'), 0), 6) AS {k}" for k in ('identifier', 'conceptual'))} FROM pq WHERE kind <> 'refusal' GROUP BY retriever""")
def variant_metrics(spark, sf_dir):
    """Tokenizers, parameters of BM25 and of the fusion, in all measures."""
    rows = metrics.by_variant(variant_scores(spark, sf_dir))
    return rows.select("group", "variant", "n", *[r6(c).alias(c) for c in rows.columns if c not in ("group", "variant", "n")])


@query()
def variant_report(spark, sf_dir):
    """The same as rows of a table, with intervals; the bootstrap is a seeded sequence that SQL can't express."""
    scored = variant_scores(spark, sf_dir)
    return metrics.variant_lines(metrics.by_variant(scored), metrics.variant_intervals(scored))


@query(f"WITH {sql.bm25()} SELECT query_id, rank, lpad(rank::VARCHAR, 2, ' ') || '. ' || printf('%.3f', score) || '  ' || id || '  ' || substr(source, 1, 70) AS line, substr(regexp_replace(text, '\\n{{2,}}', chr(10), 'g'), 1, 600) AS preview FROM r JOIN documents ON doc_id = id WHERE rank <= 10")
def hit_lines(spark, sf_dir):
    top = bm25.search(docs(spark, sf_dir), asked(spark, sf_dir), 10)
    wide = top.join(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id"), "id")
    line = display.hit_line(F.col("rank"), F.col("score"), F.col("id").cast("string"), F.col("source"))
    return wide.select("query_id", F.col("rank").cast("long").alias("rank"), line.alias("line"), display.preview(F.col("text")).alias("preview"))


@query(f"WITH {sql.bm25()} SELECT query_id, id, round(score / max(score) OVER (PARTITION BY query_id), 6) AS share FROM r")
def score_shares(spark, sf_dir):
    return bm25.search(docs(spark, sf_dir), asked(spark, sf_dir)).select("query_id", "id", r6(display.of_peak(F.col("score"), "query_id")).alias("share"))


@query("SELECT event_id, round(coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS start, round(value / sum(value) OVER (PARTITION BY user_id), 6) AS share FROM events")
def waterfall(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return display.waterfall(events, "value", ("user_id",), ("ts", "event_id")).select("event_id", r6("start").alias("start"), r6("share").alias("share"))


@query()
def bootstrap_ci(spark, sf_dir):
    values = scores(spark, sf_dir).where("kind <> 'refusal'").select("retriever", F.col("query_id").alias("ord"), F.col("recall_10").alias("value"))
    return metrics.bootstrap(values).select("retriever", *[r6(c).alias(c) for c in ("mean", "low", "high")])


@query(f"""WITH {sql.QRELS}, z AS (SELECT q.query_id, count(*) FILTER (grade = 2) AS s, count(id) AS g FROM questions q LEFT JOIN qrels ON qrels.query_id = q.query_id WHERE kind <> 'refusal' GROUP BY q.query_id), o AS (SELECT list(s ORDER BY s) AS l, count(*) AS n, max(g) AS widest FROM z)
SELECT n, l[1] AS least, l[least(n, n // 2 + 1)] AS median, l[n] AS most, widest, round(widest / (SELECT count(*) FROM documents)::DOUBLE, 6) AS share FROM o WHERE n > 0""")
def relevance_widths(spark, sf_dir):
    return golden.widths(questions(spark, sf_dir), relevance(spark, sf_dir), docs(spark, sf_dir)).withColumn("share", r6("share"))


@query(f"WITH {sql.QRELS} SELECT q.query_id FROM questions q LEFT JOIN qrels ON qrels.query_id = q.query_id AND grade = 2 WHERE kind <> 'refusal' AND id IS NULL")
def unresolved_questions(spark, sf_dir):
    return golden.unresolved(questions(spark, sf_dir).withColumnRenamed("query_id", "id"), relevance(spark, sf_dir))


@query("SELECT d.doc_id, d.n_chars FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id WHERE e.vec_id IS NULL")
def missing_embeddings(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return table(spark, sf_dir, "documents").join(e, "doc_id", "left_anti").select("doc_id", "n_chars")


@query(f"""WITH {sql.bm25()}, {sql.bm25(name='h', text="lang || ' > ' || source || chr(10) || text")}
SELECT r.query_id, count(rh.id) / 10.0::DOUBLE AS shared FROM r LEFT JOIN rh ON rh.query_id = r.query_id AND rh.id = r.id AND rh.rank <= 10 WHERE r.rank <= 10 GROUP BY r.query_id""")
def header_ablation(spark, sf_dir):
    """How much of the first ten stays when headings are indexed with the text."""
    both = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("id"), "text", T.document_text(F.array("lang", "source"), F.col("text")).alias("headed"))
    a, b = (settle(bm25.search(both.select("id", F.col(c).alias("text")), asked(spark, sf_dir), 10), c) for c in ("text", "headed"))
    return a.groupBy("query_id").agg(F.count("*").alias("n")).join(dense.agreement(a, b), "query_id", "left").select("query_id", F.coalesce("shared", F.lit(0.0)).alias("shared"))


_DECOMPOSED = {"é": "e\u0301", "è": "e\u0300", "ü": "u\u0308", "ö": "o\u0308", "ä": "a\u0308", "ñ": "n\u0303", "ç": "c\u0327", "í": "i\u0301", "ó": "o\u0301", "á": "a\u0301"}


def decomposed(text: Column) -> Column:
    """Common letters with their marks apart."""
    for one, two in _DECOMPOSED.items():
        text = F.replace(text, F.lit(one), F.lit(two))
    return text


@query(f"WITH {sql.bm25()} SELECT query_id, id, round(score, 6) AS score, rank FROM r")
def bm25_decomposed_topk(spark, sf_dir):
    """Documents whose letters and marks are apart, asked for in composed form: as if both were composed."""
    return shown(bm25.search(docs(spark, sf_dir).withColumn("text", decomposed(F.col("text"))), asked(spark, sf_dir)))


@query(f"SELECT doc_id, length({sql.normal('text')})::INTEGER AS n_chars, md5({sql.normal('text')}) AS digest FROM documents")
def normalize_decomposed(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.normalize_for_match(decomposed(F.col("text"))).alias("t"))
    return d.select("doc_id", F.length("t").alias("n_chars"), F.md5("t").alias("digest"))


@query("SELECT count(*) AS texts, count(DISTINCT coalesce(text, '')) AS sent, 0::BIGINT AS sent_again, count(*) AS embedded, count(DISTINCT coalesce(text, '')) AS kept FROM documents")
def embedding_ledger(spark, sf_dir):
    """Documents and what a ledger of embeddings sends for them: each different text once, and nothing a second time."""
    path, encoder, texts = scratch(spark, "embedding-ledger"), providers.HashEncoder(), docs(spark, sf_dir)
    sent = settle(embedding_cache.unseen(texts, path, "hash"), "sent").agg(F.count("*").alias("sent"))
    found = embedding_cache.embed_once(texts, path, encoder, "hash").agg(F.count("embedding").alias("embedded"))
    again = embedding_cache.unseen(texts, path, "hash").agg(F.count("*").alias("sent_again"))
    kept = embedding_cache.read_ledger(spark, path, "hash").agg(F.count("*").alias("kept"))
    rows = texts.agg(F.count("*").alias("texts"))
    return rows.crossJoin(sent).crossJoin(again).crossJoin(found).crossJoin(kept)  # a row each


@query()
def query_prefix_ablation(spark, sf_dir):
    """How much of the first ten stays when queries are embedded with their instruction, with the stand-in encoder."""
    encoder = providers.HashEncoder()
    index = dense.index_int8(providers.embed(docs(spark, sf_dir), encoder))
    plain = asked(spark, sf_dir).withColumnRenamed("query_id", "id")
    both = (settle(providers.embed(q, encoder), "asked").withColumnRenamed("id", "query_id") for q in (plain, plain.withColumn("text", providers.query_text(F.col("text")))))
    return dense.agreement(*[dense.search_index(index, q, 10) for q in both])
