"""Okapi BM25 over DataFrames: postings, statistics, batches of queries, and the explanation of every score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import settle
from . import lists

K1, B = 1.2, 0.75
CANDIDATES = 30

Tokens = Callable[[Column], Column]


def postings(docs: DataFrame, tokens: Tokens = T.tokens) -> DataFrame:
    """(id, len, term, tf) of docs (id, text); len counts all tokens of the document."""
    listed = docs.select("id", tokens(F.col("text")).alias("tokens"))
    return listed.select("id", F.size("tokens").cast("long").alias("len"), F.explode("tokens").alias("term")).groupBy("id", "len", "term").agg(F.count("*").alias("tf"))


def statistics(docs: DataFrame, tokens: Tokens = T.tokens) -> DataFrame:
    """One row: n, avgdl (0 for no documents)."""
    return docs.select(F.size(tokens(F.col("text"))).alias("len")).agg(F.count("*").alias("n"), F.coalesce(F.sum("len") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).cast("double").alias("avgdl"))


def frequencies(posted: DataFrame) -> DataFrame:
    """(term, df)"""
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def query_terms(queries: DataFrame, tokens: Tokens = T.tokens) -> DataFrame:
    """(query_id, pos, term) of queries (query_id, text): each term once."""
    return queries.select("query_id", F.posexplode(F.array_distinct(tokens(F.col("text")))).alias("pos", "term"))


def contribution(k1: Column, b: Column) -> Column:
    return F.col("idf") * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))


def tokenized(docs: DataFrame, **tokenizers: Tokens) -> DataFrame:
    """(id, and a list of tokens for each tokenizer, by its name) of docs (id, text): the texts are read and cut once,
    and written, so that statistics, frequencies and scores all come from here."""
    return settle(docs.select("id", *[f(F.col("text")).alias(name) for name, f in (tokenizers or {"tokens": T.tokens}).items()]), "tokens")


def asked_postings(listed: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings of the terms, the one row of statistics) of listed (id, tokens). Tokens of other terms are dropped
    before they are counted."""
    size = F.size("tokens").cast("long")
    asked = listed.select("id", size.alias("len"), F.explode("tokens").alias("term")).join(terms.select("term").distinct(), "term", "left_semi")
    # by document, so that a document's scores are summed where its postings lie
    held = settle(asked.repartition("id").groupBy("id", "len", "term").agg(F.count("*").alias("tf")), "postings")
    n = F.count("*")
    return held, listed.select(size.alias("len")).agg(n.alias("n"), F.coalesce(F.sum("len") / F.nullif(n, F.lit(0)), F.lit(0.0)).cast("double").alias("avgdl"))


def matches(docs: DataFrame, queries: DataFrame, tokens: Tokens = T.tokens) -> DataFrame:
    """(query_id, pos, term, id, len, tf, df, idf, avgdl): a row for each term of a query that a document holds."""
    return matches_of(tokenized(docs, tokens=tokens), queries, tokens)


def matches_of(listed: DataFrame, queries: DataFrame, tokens: Tokens = T.tokens) -> DataFrame:
    """The same over listed (id, tokens)."""
    terms = query_terms(queries, tokens)
    return _weighted(terms, *asked_postings(listed, terms))


def matches_in(posted: DataFrame, stats: DataFrame, queries: DataFrame, tokens: Tokens = T.tokens) -> DataFrame:
    """The same over an index: postings (id, len, term, tf) and the one row of statistics."""
    terms = query_terms(queries, tokens)
    return _weighted(terms, posted.join(terms.select("term").distinct(), "term", "left_semi"), stats)


def _weighted(terms: DataFrame, held: DataFrame, stats: DataFrame) -> DataFrame:
    # a row for each term of a query; written, so that Spark knows its size and sends it to the postings where it is small
    known = terms.join(frequencies(held), "term").crossJoin(F.broadcast(stats.select("n", "avgdl")))  # one row
    weights = settle(known.withColumn("idf", idf(F.col("n"), F.col("df"))), "weights")
    return held.join(weights, "term")


def ranked(scored: DataFrame, k: int, keys: tuple[str, ...] = ("query_id",), ties: tuple[str, ...] = ("first", "id")) -> DataFrame:
    """The k best of each key with their rank. Scores tie if they agree in nine decimals, as sums have no fixed order."""
    order = Window.partitionBy(*keys).orderBy(F.round("score", 9).desc(), *ties)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def scored(found: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, id, score, rank) of matches: ties go to the document that an earlier query term found, then to the
    lower id."""
    parts = found.select("query_id", "id", "pos", contribution(F.lit(k1), F.lit(b)).alias("part"))
    sums = parts.groupBy("query_id", "id").agg(F.sum("part").alias("score"), F.min("pos").alias("first"))
    return ranked(sums, k).select("query_id", "id", "score", "rank")


def counted(docs: DataFrame, tokens: Tokens = T.tokens, terms: DataFrame | None = None) -> DataFrame:
    """Docs (id, text), read, cut and counted once: the rows that searches take. terms: those of all queries that will
    come; other words are then counted in lengths only."""
    asked = lists.asked_words(terms) if terms is not None else None
    if tokens not in (T.tokens, T.plain_tokens):
        return lists.counted(docs.select("id", tokens(F.col("text")).alias("tokens")), asked=asked)
    return _two(docs, ("full" if tokens is T.tokens else "plain",), asked)


def two_counted(docs: DataFrame, terms: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The same of the full and of the plain tokenizer, which share what is equal."""
    counts = _two(docs, ("full", "plain"), lists.asked_words(terms) if terms is not None else None)
    return lists.of_list(counts, "full"), lists.of_list(counts, "plain")


def two_terms(queries: DataFrame) -> DataFrame:
    """(term) of queries, by either tokenizer."""
    return query_terms(queries).select("term").union(query_terms(queries, T.plain_tokens).select("term"))


def _two(docs: DataFrame, only: tuple[str, ...], asked: Broadcast | None) -> DataFrame:
    simple, others = lists.counted_texts(docs, only, asked)
    marked = others.select("id", "text", F.col("text").rlike(T.ODD).alias("odd"))
    plain, full = T.lines(F.col("text"), F.col("odd"))
    columns = [plain.alias("plain"), *([full.alias("full")] if "full" in only else [])]
    return simple.unionByName(lists.counted(marked.select("id", *columns), ("plain",), only, asked))


def counted_statistics(counts: DataFrame) -> DataFrame:
    """The one row of statistics."""
    n, total = F.sum(F.size("ids")), F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x))
    return counts.agg(F.coalesce(n, F.lit(0)).alias("n"), F.coalesce(total / F.nullif(n, F.lit(0)), F.lit(0.0)).cast("double").alias("avgdl"))


def sweep_counted(counts: DataFrame, queries: DataFrame, params: list[tuple[float, float]], k: int = CANDIDATES, tokens: Tokens = T.tokens) -> DataFrame:
    """(k1, b, query_id, id, score, rank) for each pair of parameters, over `lists.counted`'s rows of one column: postings
    are made once for all, and scored in blocks. Ties as in `scored`."""
    blocks = lists.query_blocks(query_terms(queries, tokens))
    held = lists.postings_of(counts, blocks)
    pairs = [(float(x), float(y)) for x, y in params]
    found = lists.hits(held, lists.weighted(blocks, held, counted_statistics(counts), idf(F.col("n"), F.col("df"))), pairs, k)
    return ranked(found, k, ("k1", "b", "query_id")).select("k1", "b", "query_id", "id", "score", "rank")


def search_counted(counts: DataFrame, queries: DataFrame, k: int = CANDIDATES, tokens: Tokens = T.tokens, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, id, score, rank) over the same rows, which several searches share."""
    return sweep_counted(counts, queries, [(k1, b)], k, tokens).select("query_id", "id", "score", "rank")


def sweep_tokenized(listed: DataFrame, queries: DataFrame, params: list[tuple[float, float]], k: int = CANDIDATES, tokens: Tokens = T.tokens) -> DataFrame:
    """`sweep_counted` over listed (id, tokens)."""
    return sweep_counted(lists.counted(listed.select("id", "tokens")), queries, params, k, tokens)


def search(docs: DataFrame, queries: DataFrame, k: int = CANDIDATES, tokens: Tokens = T.tokens, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, id, score, rank) over documents (id, text), which are tokenized on the way."""
    return search_counted(counted(docs, tokens, query_terms(queries, tokens)), queries, k, tokens, k1, b)


def search_tokenized(listed: DataFrame, queries: DataFrame, k: int = CANDIDATES, tokens: Tokens = T.tokens, k1: float = K1, b: float = B) -> DataFrame:
    """The same over listed (id, tokens)."""
    return sweep_tokenized(listed, queries, [(k1, b)], k, tokens).select("query_id", "id", "score", "rank")


def search_index(posted: DataFrame, stats: DataFrame, queries: DataFrame, k: int = CANDIDATES, k1: float = K1, b: float = B) -> DataFrame:
    """The same over an index that was built once: only postings of the queries' terms are read and joined."""
    return scored(matches_in(posted, stats, queries), k, k1, b)


def sweep(docs: DataFrame, queries: DataFrame, params: list[tuple[float, float]], k: int = CANDIDATES) -> DataFrame:
    """(k1, b, query_id, id, score, rank) for each pair of parameters: postings are made once for all."""
    return sweep_counted(counted(docs, terms=query_terms(queries)), queries, params, k)


def explain(docs: DataFrame, queries: DataFrame, pairs: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, id, term, df, idf, tf, score, pos) for each of pairs (query_id, id) and each distinct term of the query;
    terms that the document or the index lacks count 0. The scores of a pair add up to the search's score."""
    return explain_matches(matches(docs, queries), queries, pairs, k1, b)


def explain_matches(found: DataFrame, queries: DataFrame, pairs: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    known = found.select("query_id", "term", "df", "idf").distinct()
    wanted = pairs.join(query_terms(queries), "query_id").join(known, ["query_id", "term"], "left")
    parts = found.join(pairs, ["query_id", "id"], "left_semi").select("query_id", "id", "term", "tf", contribution(F.lit(k1), F.lit(b)).alias("score"))
    zero = [F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in (("df", 0), ("idf", 0.0), ("tf", 0), ("score", 0.0))]
    return wanted.join(parts, ["query_id", "id", "term"], "left").select("query_id", "id", "term", *zero, "pos")


def term_summary(parts: DataFrame, stats: DataFrame) -> DataFrame:
    """Of `explain`'s rows, for each pair: the terms that the document holds, the largest score first, those that only
    other documents hold, both in the query's order where nothing else tells, the score's total, and the mean length, rounded."""
    present = F.filter("listed", lambda x: x["tf"] > 0)
    absent = F.array_sort(F.transform(F.filter("listed", lambda x: (x["tf"] == 0) & (x["df"] > 0)), lambda x: F.struct(x["pos"].alias("pos"), x["term"].alias("term"))))
    listed = parts.groupBy("query_id", "id").agg(F.array_sort(F.collect_list(F.struct((-F.round("score", 9)).alias("by"), "pos", "term", "tf", "df"))).alias("listed"), F.sum("score").alias("total"))
    one = F.broadcast(stats.select(F.round("avgdl").cast("long").alias("avgdl")))  # one row
    return listed.select("query_id", "id", F.transform(present, lambda x: x["term"]).alias("present"), F.transform(absent, lambda x: x["term"]).alias("absent"), "total").crossJoin(one)


def diagnostics(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """For each query: counts of all, distinct, known and missing terms, and the rarest and commonest known one."""
    listed = queries.select("query_id", T.tokens(F.col("text")).alias("tokens"))
    terms = query_terms(queries)
    held = docs.select("id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).join(terms.select("term").distinct(), "term", "left_semi")
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    of = terms.join(df, "term", "left").groupBy("query_id").agg(
        F.count("*").alias("n_distinct"), F.count("df").alias("n_known"), (F.count("*") - F.count("df")).alias("n_missing"),
        F.min(F.when(F.col("df").isNotNull(), F.struct("df", "term")))["term"].alias("rarest"), F.min(F.when(F.col("df").isNotNull(), F.struct((-F.col("df")).alias("df"), "term")))["term"].alias("commonest"),
    )
    return listed.select("query_id", F.size("tokens").cast("long").alias("n_tokens")).join(of, "query_id", "left").select("query_id", "n_tokens", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_distinct", "n_known", "n_missing")], "rarest", "commonest")
