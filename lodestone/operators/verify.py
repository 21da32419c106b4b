"""Checking claims against the chunks they cite: quotes with their spans, a judge's scores, statuses, and metrics."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import Normal
from ..sources.scratch import numbered

VERIFIED_AT, PARTIAL_AT = 0.7, 0.4
JUDGED_PER_CLAIM = 2
#: What no chunk says.
INVENTED = "Every lighthouse keeper shall count the passing ships twice before the evening bell."
STATUSES = ("verified", "partial", "unverified", "unsupported", "uncited")

WHITE_BEFORE = re.compile(r"\s+\Z")
TERM = r"([^:\n]{1,60}):\s+(.+)"


def locate(quote: str | None, text: str | None) -> tuple[int, int] | None:
    """Where text holds the quote; or, for "Term: definition", the definition below a line that is the term."""
    if not quote or not text:
        return None
    haystack = Normal(text)
    found = next(haystack.find(Normal(quote).text), None)
    if found:
        return found
    m = re.fullmatch(TERM, quote, re.S)
    term = Normal(m[1]).text.strip() if m else ""
    if term:
        for start, end in haystack.find(Normal(m[2]).text):
            gap = WHITE_BEFORE.search(text[:start])
            if gap and "\n" in gap[0]:
                # the line above ends at one of the gap's line ends; the nearest line that holds something
                line = text[: gap.start()].rsplit("\n", 1)[-1]
                if Normal(line).text.strip() == term:
                    return start, end
    return None


def quote_holds(quote: Column, text: Column) -> Column:
    """The exact form of the check as an expression, where no span is needed."""
    needle = T.normalize_for_match(quote)
    return F.coalesce((needle != "") & F.contains(T.normalize_for_match(text), needle), F.lit(False))


def citations(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """(answer_id, claim_idx, pos, sentence, quote, chunk_id, doc_title, heading_path, sc_ref, text, span): a row for
    each cited chunk; one that doesn't exist has no text and no span. Spans are offsets in the document. Only chunks that
    hold the quote, or its definition, are searched for the place."""
    cited = claims.select("answer_id", "claim_idx", "sentence", "quote", F.posexplode("chunk_ids").alias("pos", "chunk_id"))
    wide = cited.join(chunks.select(F.col("id").alias("chunk_id"), "doc_title", "heading_path", "sc_ref", "text", "char_start"), "chunk_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [locate(q, t) if m else None for q, t, m in zip(rows["quote"], rows["text"], rows["maybe"], strict=True)]
            base = rows["char_start"].fillna(0).astype(int)
            starts = [None if f is None else f[0] + b for f, b in zip(found, base, strict=True)]
            ends = [None if f is None else f[1] + b for f, b in zip(found, base, strict=True)]
            yield rows.assign(span_start=pd.array(starts, dtype="Int32"), span_end=pd.array(ends, dtype="Int32"))[[*names]]

    names = ["answer_id", "claim_idx", "pos", "sentence", "quote", "chunk_id", "doc_title", "heading_path", "sc_ref", "text", "span_start", "span_end"]
    kinds = dict(wide.dtypes)
    schema = ", ".join(f"{c} {kinds.get(c, 'int')}" for c in names)
    definition = F.regexp_extract("quote", f"(?s)^{TERM}$", 2)
    maybe = quote_holds(F.col("quote"), F.col("text")) | quote_holds(definition, F.col("text"))
    return wide.select(*names[:-2], "char_start", maybe.alias("maybe")).mapInPandas(run, schema)


def status_of(score: Column, verified_at: float = VERIFIED_AT, partial_at: float = PARTIAL_AT) -> Column:
    return F.when(score.isNull(), "unverified").when(score >= verified_at, "verified").when(score >= partial_at, "partial").otherwise("unsupported")


Judge = Callable[[DataFrame], DataFrame]


def overlap_judge(pairs: DataFrame) -> DataFrame:
    """A judge that needs no model: 1, 0.5 or 0 by the share of the sentence's words that the evidence holds."""
    share = F.size(F.array_intersect(T.plain_tokens(F.col("sentence")), T.plain_tokens(F.col("evidence")))) / F.greatest(F.size(F.array_distinct(T.plain_tokens(F.col("sentence")))), F.lit(1))
    return pairs.withColumn("score", F.when(share >= 0.9, 1.0).when(share >= 0.5, 0.5).otherwise(0.0))


def holding(cited: DataFrame) -> DataFrame:
    """The citations that hold their quote, numbered n = 1, 2, ... for each claim."""
    return cited.where(F.col("span_start").isNotNull()).withColumn("n", F.row_number().over(Window.partitionBy("answer_id", "claim_idx").orderBy("pos")))


def judged_pairs(held: DataFrame) -> DataFrame:
    """(answer_id, claim_idx, n, sentence, evidence, span, omitted) of the first holding citations of each claim."""
    level = T.level_of(F.col("doc_title"), F.col("text"))
    omitted = F.when(level.isNotNull() & ~T.names_level(F.col("sentence"), F.col("sc_ref"), level), level)
    return held.where(F.col("n") <= JUDGED_PER_CLAIM).select("answer_id", "claim_idx", "n", "sentence", T.evidence(F.col("doc_title"), F.col("heading_path"), F.col("text")).alias("evidence"), F.struct("chunk_id", F.col("span_start").alias("start"), F.col("span_end").alias("end")).alias("span"), omitted.alias("omitted"))


def verify(claims: DataFrame, cited: DataFrame, judge: Judge = overlap_judge) -> DataFrame:
    """claims with quote_match, supporting_chunk_ids, span, entailment, status, level_omitted.

    cited: rows as of `citations`. The judge gets rows with sentence and evidence, of the first supporting chunks of
    claims whose quote holds, and adds score; scores outside [0, 1] count as none. The best score decides, the first of
    equal ones.
    """
    key = ["answer_id", "claim_idx"]
    held = holding(cited)
    support = held.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "chunk_id"))), lambda x: x["chunk_id"]).alias("supporting_chunk_ids"))
    pairs = judged_pairs(held)
    scored = judge(pairs).withColumn("score", F.when(F.col("score").between(0.0, 1.0), F.col("score")))
    order = F.struct(F.coalesce(-F.col("score"), F.lit(1.0)).alias("s"), "n")
    best = scored.groupBy(*key).agg(F.min_by(F.struct("score", "span", "omitted"), order).alias("b"))
    wide = claims.join(support, key, "left").join(best, key, "left")
    match = F.col("supporting_chunk_ids").isNotNull()
    entailment = F.when(match, F.col("b.score")).otherwise(0.0)
    status = F.when(match, status_of(F.col("b.score"))).otherwise("unsupported")
    demoted = (status == "verified") & F.col("b.omitted").isNotNull()
    return wide.select(*claims.columns, match.alias("quote_match"), F.coalesce("supporting_chunk_ids", F.array().cast("array<string>")).alias("supporting_chunk_ids"), F.when(match, F.col("b.span")).alias("span"), entailment.alias("entailment"), F.when(demoted, "partial").otherwise(status).alias("status"), F.when(demoted, F.col("b.omitted")).alias("level_omitted"))


def sentence_status(sentences: DataFrame, verified: DataFrame) -> DataFrame:
    """sentences (answer_id, pos, sentence) with status: the best of their claims', uncited without any."""
    rank = F.element_at(F.create_map(*[F.lit(x) for s, r in (("verified", 4), ("partial", 3), ("unverified", 2), ("unsupported", 1)) for x in (s, r)]), F.col("status"))
    best = verified.groupBy("answer_id", "sentence").agg(F.max_by("status", rank).alias("status"))
    return sentences.join(best, ["answer_id", "sentence"], "left").select("answer_id", "pos", "sentence", F.coalesce("status", F.lit("uncited")).alias("status"))


def citation_metrics(sentences: DataFrame, verified: DataFrame) -> DataFrame:
    """For each answer: six rates (0 where nothing is counted), the counts of sentences by status, the totals, and claims
    whose quote failed, that were judged, are verified, and left out a level. Coverage and the last three rates are of
    sentences. sentences: rows as of `sentence_status`."""
    n = F.count("*")
    by_status = sentences.groupBy("answer_id").agg(n.alias("sentences"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES])
    of = verified.groupBy("answer_id").agg(F.count("*").alias("claims"), F.sum(F.size("chunk_ids")).alias("cited"), F.sum(F.size("supporting_chunk_ids")).alias("supporting"), F.count_if(~F.col("quote_match")).alias("failed"), F.count_if(F.col("entailment").isNotNull() & F.col("quote_match")).alias("judged"), F.count_if(F.col("status") == "verified").alias("c_verified"), F.count_if(F.col("level_omitted").isNotNull()).alias("levels_omitted"))
    wide = by_status.join(of, "answer_id", "left").fillna(0, ["claims", "cited", "supporting", "failed", "judged", "c_verified", "levels_omitted"])

    def rate(a: Column, b: Column) -> Column:
        return F.when(b == 0, F.lit(0.0)).otherwise(a / b)

    c = F.col
    return wide.select("answer_id", "sentences", "claims", *[f"n_{s}" for s in STATUSES], rate(c("sentences") - c("n_uncited"), c("sentences")).alias("coverage"), rate(c("supporting"), c("cited")).alias("precision"), rate(c("failed"), c("claims")).alias("quote_failure_rate"), rate(c("n_unsupported"), c("sentences")).alias("unsupported_rate"), rate(c("n_unverified"), c("sentences")).alias("unverified_rate"), rate(c("n_uncited"), c("sentences")).alias("uncited_rate"), "cited", "failed", "judged", "c_verified", "levels_omitted")


RATES = ("coverage", "precision", "quote_failure_rate", "unsupported_rate", "unverified_rate", "uncited_rate")


def citation_summary(metrics: DataFrame) -> DataFrame:
    """One row: rates averaged over answers, counts summed."""
    counts = [F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("sentences", "claims", *[f"n_{s}" for s in STATUSES])]
    return metrics.agg(F.count("*").alias("answers"), *counts, *[F.coalesce(F.avg(r), F.lit(0.0)).alias(r) for r in RATES])


def probes(chunks: DataFrame, every: int = 53, length: int = 12) -> DataFrame:
    """Deliberate fabrications of every so manieth chunk: (probe, should_match, quote, id, text), id and text of the
    chunk that is cited. chunks: (id, ordinal, doc_id, text)."""
    w = T.words(F.col("text"))
    third = F.floor(F.size(w) / 3).cast("int")
    sample = chunks.where(F.col("ordinal") % every == 0).select("id", "ordinal", "doc_id", "text", w.alias("w"), F.array_join(F.slice(w, third + 1, length), " ").alias("excerpt"))
    usable = sample.where(F.length("excerpt") >= 40)
    places = numbered(usable.select("id", "ordinal"), "ordinal").select("id", F.col("place").alias("i"))
    usable = usable.join(places, "id").crossJoin(F.broadcast(places.agg(F.count("*").alias("n"))))  # one row
    other = usable.select(F.pmod(F.col("i") - 7, F.col("n")).alias("i"), F.col("id").alias("other_id"), F.col("doc_id").alias("other_doc"), F.col("text").alias("other_text"))
    wide = usable.join(other, "i")
    parts = F.split("excerpt", " ")
    middle = F.floor(F.size(parts) / 2).cast("int")
    swapped = F.array_join(F.transform(parts, lambda x, j: F.when(j == middle, "quincunx").otherwise(x)), " ")
    straight = F.translate("excerpt", "‘’“”–—", "''\"\"--")
    stitched = F.array_join(F.concat(F.slice("w", 1, 6), F.slice("w", -6, 6)), " ")
    own = (F.col("id"), F.col("text"))
    rows = [
        ("verbatim", True, F.col("excerpt"), F.lit(True), own),
        ("reflowed", True, F.replace(F.col("excerpt"), F.lit(" "), F.lit("\n   ")), F.lit(True), own),
        ("straightened", True, straight, F.col("excerpt").rlike("[‘’“”–—]"), own),
        ("wrong chunk", False, F.col("excerpt"), F.col("doc_id") != F.col("other_doc"), (F.col("other_id"), F.col("other_text"))),
        ("one word replaced", False, swapped, F.lit(True), own),
        ("stitched", False, stitched, F.size("w") >= 30, own),
        ("invented", False, F.lit(INVENTED), F.lit(True), own),
    ]
    built = F.array(*[F.struct(F.lit(name).alias("probe"), F.lit(ok).alias("should_match"), quote.alias("quote"), when.alias("use"), cited[0].alias("id"), cited[1].alias("text")) for name, ok, quote, when, cited in rows])
    return wide.select(F.explode(built).alias("p")).select("p.*").where("use").drop("use")

