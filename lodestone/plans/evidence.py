"""Queries about quotes, claims, statuses, answers and verdicts, over documents as chunks and passages as answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers, bm25, rerank, verify
from ..operators.providers import prompt
from . import sql
from ..sources.scratch import settle, spread
from .registry import query, table
from .retrieval import _FUSED, _TWO, asked, docs, fused, r6


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks. Titles of some name a level, and some have a reference."""
    d = spread(table(spark, sf_dir, "documents"))
    level = F.element_at(F.array(F.lit(""), F.lit(" (Level A)"), F.lit(" (Level AA)"), F.lit(" (Level AAA)")), (F.col("doc_id") % 4 + 1).cast("int"))
    ref = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("1.4."), (F.col("doc_id") % 10).cast("string")))
    return d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("doc_id").alias("ordinal"), F.concat(F.lit("Document "), F.col("doc_id").cast("string"), level).alias("doc_title"), F.array("lang", "source").alias("heading_path"), ref.alias("sc_ref"), "text", F.lit(0).alias("char_start"), F.col("doc_id").cast("string").alias("doc_id"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(answer_id, pos, sentence): the passages' sentences."""
    cut = F.transform(F.regexp_extract_all("text", F.lit(r"[^.]+\."), F.lit(0)), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    return asked(spark, sf_dir).select(F.col("query_id").alias("answer_id"), F.posexplode(cut).alias("pos", "sentence"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim for each sentence but every fifth, citing the three best documents of its passage and, for every third,
    a chunk that doesn't exist. Every fourth quote has a word too many."""
    top = bm25.search(docs(spark, sf_dir), asked(spark, sf_dir), 3)
    cited = top.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: F.concat(F.lit("d"), x["id"].cast("string"))).alias("ids"))
    s = sentences(spark, sf_dir).where("pos % 5 <> 4").join(cited, F.col("answer_id") == F.col("query_id"))
    ids = F.when(F.col("pos") % 3 == 0, F.array_append("ids", F.lit("missing"))).otherwise(F.col("ids"))
    quote = F.when(F.col("pos") % 4 == 3, F.concat(F.col("sentence"), F.lit(" blancmange"))).otherwise(F.col("sentence"))
    return settle(s.select("answer_id", F.col("pos").alias("claim_idx"), "sentence", ids.alias("chunk_ids"), quote.alias("quote")), "claims")


def verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = claims(spark, sf_dir)
    return settle(verify.verify(own, settle(verify.citations(own, chunk_table(spark, sf_dir)), "citations")), "verified")


_CHUNKS = "ch AS (SELECT 'd' || doc_id AS id, doc_id AS ordinal, 'Document ' || doc_id || ['', ' (Level A)', ' (Level AA)', ' (Level AAA)'][doc_id % 4 + 1] AS doc_title, [lang, source] AS heading_path, CASE WHEN doc_id % 3 = 0 THEN '1.4.' || (doc_id % 10) END AS sc_ref, text, doc_id::VARCHAR AS doc_id, ['', 'A', 'AA', 'AAA'][doc_id % 4 + 1] AS level FROM documents)"
_SENTENCES = r"se AS (SELECT item_id AS answer_id, (unnest(range(len(l))))::INTEGER AS pos, trim(regexp_replace(unnest(l), '\s+', ' ', 'g')) AS sentence FROM (SELECT item_id, regexp_extract_all(text, '[^.]+\.') AS l FROM benchmark))"
_CLAIMS = f"""WITH {sql.bm25()}, {_CHUNKS}, {_SENTENCES},
ci AS (SELECT query_id, list('d' || id ORDER BY rank) AS ids FROM r WHERE rank <= 3 GROUP BY query_id),
cl AS (SELECT answer_id, pos AS claim_idx, sentence, CASE WHEN pos % 3 = 0 THEN list_append(ids, 'missing') ELSE ids END AS chunk_ids, CASE WHEN pos % 4 = 3 THEN sentence || ' blancmange' ELSE sentence END AS quote FROM se JOIN ci ON query_id = answer_id WHERE pos % 5 <> 4),
ct AS (SELECT *, unnest(chunk_ids) AS cid, unnest(range(len(chunk_ids))) AS p FROM cl),
hd AS (SELECT ct.*, ch.doc_title, ch.heading_path, ch.sc_ref, ch.text, ch.level, row_number() OVER (PARTITION BY answer_id, claim_idx ORDER BY p) AS n FROM ct JOIN ch ON ch.id = cid WHERE contains({sql.normal('ch.text')}, {sql.normal('quote')}))"""
_JUDGED = rf"""{_CLAIMS},
jd AS (SELECT *, len(list_intersect(list_distinct({sql.plain_tokens('sentence')}), {sql.plain_tokens("concat_ws(chr(10), doc_title, array_to_string(heading_path, ' > '), '', text)")})) / greatest(len(list_distinct({sql.plain_tokens('sentence')})), 1)::DOUBLE AS share,
 CASE WHEN level <> '' AND NOT (CASE WHEN level = 'A' THEN regexp_matches(sentence, '(^|[^A-Za-z0-9_])(Level|Livello)\s+A([^A-Za-z0-9_]|$)') ELSE regexp_matches(sentence, '(^|[^A-Za-z0-9_])' || level || '([^A-Za-z0-9_]|$)') END OR coalesce(contains(sentence, sc_ref), false)) THEN level END AS omitted FROM hd WHERE n <= 2),
sc AS (SELECT *, CASE WHEN share >= 0.9 THEN 1.0::DOUBLE WHEN share >= 0.5 THEN 0.5 ELSE 0 END AS score FROM jd),
be AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY answer_id, claim_idx ORDER BY score DESC, n) = 1),
su AS (SELECT answer_id, claim_idx, list(cid ORDER BY p) AS supporting FROM hd GROUP BY ALL),
ve AS (SELECT cl.answer_id, cl.claim_idx, cl.sentence, cl.chunk_ids, supporting IS NOT NULL AS quote_match, coalesce(supporting, []) AS supporting, be.cid AS span_chunk, coalesce(be.score, 0) AS entailment,
 CASE WHEN supporting IS NULL OR be.score < 0.4 THEN 'unsupported' WHEN be.score >= 0.7 AND omitted IS NULL THEN 'verified' ELSE 'partial' END AS status, CASE WHEN be.score >= 0.7 THEN omitted END AS level_omitted
 FROM cl LEFT JOIN su USING (answer_id, claim_idx) LEFT JOIN be USING (answer_id, claim_idx)),
ss AS (SELECT se.answer_id, se.pos, se.sentence, coalesce(arg_max(status, CASE status WHEN 'verified' THEN 4 WHEN 'partial' THEN 3 WHEN 'unverified' THEN 2 ELSE 1 END), 'uncited') AS status FROM se LEFT JOIN ve ON ve.answer_id = se.answer_id AND ve.sentence = se.sentence GROUP BY ALL)"""
_METRICS = f"""{_JUDGED},
b AS (SELECT answer_id, count(*) AS sentences, {", ".join(f"count(*) FILTER (status = '{s}') AS n_{s}" for s in verify.STATUSES)} FROM ss GROUP BY answer_id),
o AS (SELECT answer_id, count(*) AS claims, sum(len(chunk_ids)) AS cited, sum(len(supporting)) AS supp, count(*) FILTER (NOT quote_match) AS failed, count(*) FILTER (quote_match AND entailment IS NOT NULL) AS judged, count(*) FILTER (status = 'verified') AS c_verified, count(level_omitted) AS levels_omitted FROM ve GROUP BY answer_id),
mt AS (SELECT b.*, coalesce(claims, 0) AS claims, coalesce((sentences - n_uncited)::DOUBLE / nullif(sentences, 0), 0) AS coverage, coalesce(supp::DOUBLE / nullif(cited, 0), 0) AS precision, coalesce(failed::DOUBLE / nullif(claims, 0), 0) AS quote_failure_rate, coalesce(n_unsupported::DOUBLE / nullif(sentences, 0), 0) AS unsupported_rate, coalesce(n_unverified::DOUBLE / nullif(sentences, 0), 0) AS unverified_rate, coalesce(n_uncited::DOUBLE / nullif(sentences, 0), 0) AS uncited_rate, coalesce(failed, 0) AS failed, coalesce(judged, 0) AS judged, coalesce(c_verified, 0) AS c_verified, coalesce(levels_omitted, 0) AS levels_omitted FROM b LEFT JOIN o ON o.answer_id = b.answer_id)"""


@query(f"SELECT doc_id, length({sql.normal('text')})::INTEGER AS n_chars, md5({sql.normal('text')}) AS digest FROM documents")
def normalize_for_match(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", T.normalize_for_match(F.col("text")).alias("t"))
    return d.select("doc_id", F.length("t").alias("n_chars"), F.md5("t").alias("digest"))


@query(f"{_CLAIMS} SELECT answer_id, claim_idx, cid AS chunk_id, n FROM hd")
def quote_match(spark, sf_dir):
    own = claims(spark, sf_dir)
    cited = own.select("answer_id", "claim_idx", "quote", F.posexplode("chunk_ids").alias("pos", "chunk_id")).join(chunk_table(spark, sf_dir).select(F.col("id").alias("chunk_id"), "text"), "chunk_id")
    held = cited.where(verify.quote_holds(F.col("quote"), F.col("text")))
    n = F.row_number().over(Window.partitionBy("answer_id", "claim_idx").orderBy("pos")).cast("long")
    return held.select("answer_id", "claim_idx", "chunk_id", n.alias("n"))


@query(f"{_JUDGED} SELECT answer_id, claim_idx, quote_match, array_to_string(supporting, ',') AS supporting, span_chunk, entailment, status, level_omitted FROM ve")
def claim_status(spark, sf_dir):
    return verified(spark, sf_dir).select("answer_id", "claim_idx", "quote_match", F.array_join("supporting_chunk_ids", ",").alias("supporting"), F.col("span.chunk_id").alias("span_chunk"), "entailment", "status", "level_omitted")


@query(f"{_JUDGED} SELECT answer_id, claim_idx, instr({sql.normal('sc.text')}, {sql.normal('quote')}) > 0 AS holds, {sql.normal('quote')} AS found FROM sc WHERE n = 1")
def quote_spans(spark, sf_dir):
    """What the spans of first supporting chunks cut out of their documents, normalised, is the quote."""
    own = claims(spark, sf_dir)
    spans = verify.citations(own, chunk_table(spark, sf_dir)).where("span_start IS NOT NULL")
    first = spans.withColumn("n", F.row_number().over(Window.partitionBy("answer_id", "claim_idx").orderBy("pos"))).where("n = 1")
    found = T.normalize_for_match(F.substring("text", F.col("span_start") + 1, F.col("span_end") - F.col("span_start")))
    return first.select("answer_id", "claim_idx", (found == T.normalize_for_match(F.col("quote"))).alias("holds"), found.alias("found"))


@query(f"{_JUDGED} SELECT answer_id, pos, status FROM ss")
def sentence_status(spark, sf_dir):
    return verify.sentence_status(sentences(spark, sf_dir), verified(spark, sf_dir)).select("answer_id", "pos", "status")


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = verified(spark, sf_dir)
    return verify.citation_metrics(verify.sentence_status(sentences(spark, sf_dir), v), v)


_COUNTS = ["sentences", "claims", *(f"n_{s}" for s in verify.STATUSES)]
_CLAIM_COUNTS = ["failed", "judged", "c_verified", "levels_omitted"]


@query(f"{_METRICS} SELECT answer_id, {', '.join(_COUNTS + _CLAIM_COUNTS)}, {', '.join(f'round({x}, 6) AS {x}' for x in verify.RATES)} FROM mt")
def citation_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir).select("answer_id", *_COUNTS, *_CLAIM_COUNTS, *[r6(x).alias(x) for x in verify.RATES])


@query(f"{_METRICS} SELECT count(*) AS answers, {', '.join(f'sum({x})::BIGINT AS {x}' for x in _COUNTS)}, {', '.join(f'round(avg({x}), 6) AS {x}' for x in verify.RATES)} FROM mt")
def citation_metrics_macro(spark, sf_dir):
    return verify.citation_summary(_metrics(spark, sf_dir)).select("answers", *_COUNTS, *[r6(x).alias(x) for x in verify.RATES])


@query(f"WITH {_CHUNKS} SELECT id, nullif(level, '') AS level, CASE WHEN level <> '' THEN regexp_matches(text, '(^|[^A-Za-z0-9_])AA([^A-Za-z0-9_]|$)') AND level = 'AA' OR level = 'AAA' AND regexp_matches(text, '(^|[^A-Za-z0-9_])AAA([^A-Za-z0-9_]|$)') OR level = 'A' AND regexp_matches(text, '(^|[^A-Za-z0-9_])(Level|Livello)\\s+A([^A-Za-z0-9_]|$)') OR coalesce(contains(text, sc_ref), false) END AS named FROM ch")
def level_of(spark, sf_dir):
    c = chunk_table(spark, sf_dir).withColumn("level", T.level_of(F.col("doc_title"), F.col("text")))
    return c.select("id", "level", F.when(F.col("level").isNotNull(), T.names_level(F.col("text"), F.col("sc_ref"), F.col("level"))).alias("named"))


_PROBES = r"""WITH ch AS (SELECT 'd' || doc_id AS id, doc_id AS ordinal, doc_id::VARCHAR AS doc_id, text, regexp_extract_all(coalesce(text, ''), '\S+') AS w FROM documents),
sm AS (SELECT *, array_to_string(w[len(w) // 3 + 1 : len(w) // 3 + 12], ' ') AS excerpt FROM ch WHERE ordinal % 53 = 0),
us AS (SELECT *, row_number() OVER (ORDER BY ordinal) - 1 AS i, count(*) OVER () AS n FROM sm WHERE length(excerpt) >= 40),
wd AS (SELECT a.*, b.id AS oid, b.doc_id AS odoc, b.text AS otext FROM us a JOIN us b ON b.i = (a.i + 7) % a.n),
pr AS (SELECT 'verbatim' AS probe, id FROM wd UNION ALL SELECT 'reflowed', id FROM wd UNION ALL SELECT 'straightened', id FROM wd WHERE regexp_matches(excerpt, '[‘’“”–—]') UNION ALL SELECT 'wrong chunk', oid FROM wd WHERE doc_id <> odoc UNION ALL SELECT 'one word replaced', id FROM wd UNION ALL SELECT 'stitched', id FROM wd WHERE len(w) >= 30 UNION ALL SELECT 'invented', id FROM wd)
SELECT probe, id, probe IN ('verbatim', 'reflowed', 'straightened') AS should_match FROM pr"""


@query(_PROBES)
def fabrication_probes(spark, sf_dir):
    """Every probe, as it was built."""
    return verify.probes(chunk_table(spark, sf_dir)).select("probe", "id", "should_match")


@query(rf"""{_PROBES.split("pr AS (")[0]} qt AS (SELECT 'verbatim' AS probe, true AS ok, excerpt AS quote, text FROM wd UNION ALL SELECT 'reflowed', true, replace(excerpt, ' ', chr(10) || '   '), text FROM wd UNION ALL SELECT 'straightened', true, translate(excerpt, '‘’“”–—', chr(39) || chr(39) || '""--'), text FROM wd WHERE regexp_matches(excerpt, '[‘’“”–—]') UNION ALL SELECT 'wrong chunk', false, excerpt, otext FROM wd WHERE doc_id <> odoc
 UNION ALL SELECT 'one word replaced', false, array_to_string(list_concat(list_concat(x[1 : len(x) // 2], ['quincunx']), x[len(x) // 2 + 2 :]), ' '), text FROM (SELECT *, string_split(excerpt, ' ') AS x FROM wd) UNION ALL SELECT 'stitched', false, array_to_string(list_concat(w[1 : 6], w[len(w) - 5 :]), ' '), text FROM wd WHERE len(w) >= 30 UNION ALL SELECT 'invented', false, '{verify.INVENTED}', text FROM wd)
SELECT probe, ok AS should_match, count(*) AS n, count(*) FILTER (contains({sql.normal('text')}, {sql.normal('quote')})) AS accepted FROM qt GROUP BY ALL""")
def fabrication_results(spark, sf_dir):
    """For each probe how many were accepted by the exact check."""
    # the check composes texts by a method call, which an aggregate doesn't take
    p = verify.probes(chunk_table(spark, sf_dir)).withColumn("holds", verify.quote_holds(F.col("quote"), F.col("text")))
    return p.groupBy("probe", "should_match").agg(F.count("*").alias("n"), F.count_if("holds").alias("accepted"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("t"))


_TURNS = r"tn AS (SELECT conv_id * 1000 + turn AS answer_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations WHERE role = 'assistant')"


@query(f"WITH {_TURNS} SELECT answer_id, md5(t) AS digest, 1 - 0 AS n FROM tn")
def strip_markers(spark, sf_dir):
    """A sentence with markers put after it is as before."""
    marked = F.concat(F.col("t"), F.element_at(F.array(F.lit(" [claim 0]"), F.lit(" [claims 1, 2]"), F.lit(" [0123456789abcdef] [3]"), F.lit("")), (F.col("answer_id") % 4 + 1).cast("int")))
    return turns(spark, sf_dir).select("answer_id", F.md5(T.strip_markers(marked)).alias("digest"), F.lit(1).alias("n"))


def raw_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a model's JSON: by turns good, with a bad claim, with a wrong index, without sentences, no JSON."""
    k = F.col("answer_id") % 5
    claim = F.to_json(F.struct(F.lit(0).alias("sentenceIndex"), F.array(F.lit("c1"), F.lit("c1"), F.lit("c2")).alias("chunkIds"), F.col("t").alias("quote")))
    other = F.when(k == 1, F.lit('{"sentenceIndex":0,"chunkIds":[],"quote":"x"}')).when(k == 2, F.lit('{"sentenceIndex":9,"chunkIds":["c1"],"quote":"x"}')).otherwise(F.lit('{"sentenceIndex":1,"chunkIds":["c3"],"quote":"y"}'))
    said = F.when(k == 3, F.lit('["  "]')).otherwise(F.to_json(F.array(F.concat(F.col("t"), F.lit(" [claim 0]")), F.lit("Under AAA it is so."), F.lit("At Level A it is so."))))
    raw = F.concat(F.lit('{"answerable":true,"sentences":'), said, F.lit(',"claims":['), claim, F.lit(","), other, F.lit("]}"))
    return turns(spark, sf_dir).select("answer_id", F.when(k == 4, F.lit("no json")).otherwise(raw).alias("raw"))


_PARSED = f"""WITH {_TURNS}, k AS (SELECT *, answer_id % 5 AS k FROM tn)
SELECT answer_id, CASE k WHEN 4 THEN 'answer is not an object' WHEN 3 THEN 'answer.sentences is empty' END AS error, CASE WHEN k < 3 THEN true END AS answerable,
 CASE WHEN k < 3 THEN md5(t || '|At Level A it is so.|Under AAA it is so.') END AS said, CASE WHEN k < 3 THEN 1 + (k = 0)::INTEGER END AS n_claims,
 CASE k WHEN 0 THEN 'c1,c2;c3' WHEN 1 THEN 'c1,c2' WHEN 2 THEN 'c1,c2' END AS cited, CASE k WHEN 0 THEN '' WHEN 1 THEN 'claim 1: chunkIds is empty' WHEN 2 THEN 'claim 1: sentenceIndex 9 is out of range' END AS dropped FROM k"""


@query(_PARSED)
def parse_answers(spark, sf_dir):
    p = answers.parse(raw_answers(spark, sf_dir))
    good = F.col("error").isNull()
    cited = F.array_join(F.transform("claims", lambda c: F.array_join(c["chunk_ids"], ",")), ";")
    return p.select("answer_id", "error", "answerable", F.md5(F.array_join("sentences", "|")).alias("said"), F.when(good, F.size("claims")).alias("n_claims"), F.when(good, cited).alias("cited"), F.when(good, F.array_join("dropped", ";")).alias("dropped"))


@query(f"WITH {_TURNS} SELECT answer_id, md5(CASE answer_id % 3 WHEN 0 THEN 'Level A first.|' || t || '|AA second.|AAA third.' WHEN 1 THEN t || '|Level A.|AAA.' ELSE t || '|AA only.' END) AS digest FROM tn")
def by_level(spark, sf_dir):
    k, t = F.col("answer_id") % 3, F.col("t")
    said = F.when(k == 0, F.array(F.lit("AAA third."), t, F.lit("Level A first."), F.lit("AA second."))).when(k == 1, F.array(t, F.lit("AAA."), F.lit("Level A."))).otherwise(F.array(t, F.lit("AA only.")))
    return turns(spark, sf_dir).select("answer_id", F.md5(F.array_join(answers.by_level(said), "|")).alias("digest"))


@query(f"WITH {_TURNS}, i AS (SELECT answer_id AS batch_id, length(t) % 4 AS m, unnest([0, 1, 2])::INTEGER AS idx FROM tn) SELECT batch_id, idx, CASE WHEN idx = 0 THEN CASE WHEN m = 1 THEN 0.5::DOUBLE ELSE 1.0 END WHEN idx = 1 AND m <> 2 THEN 0.0 END AS score FROM i")
def parse_verdicts(spark, sf_dir):
    m = F.length("t") % 4
    second = F.when(m == 2, F.lit('{"index":1,"label":"maybe"}')).otherwise(F.lit('{"index":1,"label":"not_supported"}'))
    last = F.when(m == 1, F.lit('{"index":0,"label":"partially_supported"}')).when(m == 0, F.lit("null")).otherwise(F.lit('{"index":9,"label":"supported"}'))
    raw = F.concat(F.lit('{"verdicts":[{"index":0,"label":"supported"},'), second, F.lit(","), last, F.lit("]}"))
    return answers.verdicts(turns(spark, sf_dir).select(F.col("answer_id").alias("batch_id"), F.lit(3).alias("n"), raw.alias("raw")))


def _escaped(x: str) -> str:
    return f"""replace(replace(replace(replace({x}, '&', '&amp;'), '"', '&quot;'), '<', '&lt;'), '>', '&gt;')"""


@query(f"""WITH {sql.bm25()}, {_CHUNKS}, pk AS (SELECT query_id, rank, '<source id="' || ch.id || '" title="' || {_escaped('doc_title')} || '">' || chr(10) || substr(text, 1, 2400) || chr(10) || '</source>' AS src FROM r JOIN ch ON ch.id = 'd' || r.id WHERE rank <= 8)
SELECT query_id, count(*)::INTEGER AS n_sources, md5('Answer from the sources only, with a quote for every claim.' || chr(10) || chr(10) || string_agg(src, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Question: ' || substr(b.text, 1, 512)) AS digest FROM pk JOIN benchmark b ON b.item_id = query_id GROUP BY query_id, b.text""")
def source_prompt(spark, sf_dir):
    top = bm25.search(docs(spark, sf_dir), asked(spark, sf_dir), 8).select("query_id", "rank", F.concat(F.lit("d"), F.col("id").cast("string")).alias("id"))
    wide = top.join(chunk_table(spark, sf_dir).select("id", "doc_title", F.substring("text", 1, 2400).alias("text")), "id")
    listed = wide.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id", "doc_title", "text"))), lambda s: F.struct(s["id"].alias("id"), s["doc_title"].alias("title"), s["text"].alias("text"))).alias("sources"))
    return listed.join(asked(spark, sf_dir), "query_id").select("query_id", F.size("sources").alias("n_sources"), F.md5(prompt(F.col("text"), F.col("sources"))).alias("digest"))


@query(f"WITH {_CHUNKS} SELECT id, md5(concat_ws(chr(10), doc_title, array_to_string(heading_path, ' > '), '', text)) AS evidence, md5(array_to_string(heading_path, ' > ') || chr(10) || text) AS indexed, heading_path[-1] AS label, substr(sha256(doc_id || chr(10) || array_to_string(heading_path, ' > ') || chr(10) || text), 1, 16) AS key FROM ch")
def chunk_texts(spark, sf_dir):
    c = chunk_table(spark, sf_dir)
    path, text, title = F.col("heading_path"), F.col("text"), F.col("doc_title")
    return c.select("id", F.md5(T.evidence(title, path, text)).alias("evidence"), F.md5(T.document_text(path, text)).alias("indexed"), T.heading_label(path, title).alias("label"), T.chunk_key(F.col("doc_id"), path, text).alias("key"))


@query(f"WITH {_CHUNKS} SELECT id, concat_ws(' > ', doc_title, array_to_string(heading_path, ' > ')) AS title FROM ch")
def source_titles(spark, sf_dir):
    return chunk_table(spark, sf_dir).select("id", T.source_title(F.col("doc_title"), F.col("heading_path")).alias("title"))


_RERANK = f"""{_TWO}, {_FUSED}, cd AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS place, count(*) OVER (PARTITION BY query_id) AS n FROM fr JOIN documents ON doc_id = id WHERE text <> ''),
rr AS (SELECT query_id, id, CASE WHEN query_id % 4 = 0 THEN n - place ELSE place + 1 END AS rank, CASE WHEN query_id % 4 = 0 THEN (place + 1) / n::DOUBLE ELSE 1 - place / n::DOUBLE END AS score, CASE query_id % 4 WHEN 1 THEN 'reranker returned nothing' WHEN 2 THEN 'reranker returned no usable indices' WHEN 3 THEN 'quota used up' END AS degraded FROM cd)"""


@query(f"{_RERANK} SELECT query_id, id, round(score, 6) AS score, rank, degraded FROM rr WHERE rank <= 8")
def rerank_replies(spark, sf_dir):
    """Replies made from each list: the order reversed, with a place that doesn't exist; an empty one; one of such places
    only; and none, with a reason."""
    listed = settle(rerank.candidates(fused(spark, sf_dir)[2], docs(spark, sf_dir)), "candidates")
    turned = F.transform(F.sequence(F.size("items") - 1, F.lit(0), F.lit(-1)), lambda i: F.struct(i.alias("id"), ((i + 1) / F.size("items")).alias("score")))
    none = F.struct(F.lit(99).alias("id"), F.lit(1.0).alias("score"))
    raw = F.when(F.col("query_id") % 4 == 0, F.to_json(F.struct(F.concat(F.array(none), turned).alias("response")))).when(F.col("query_id") % 4 == 1, '{"response":[]}').when(F.col("query_id") % 4 == 2, '{"response":[{"id":99,"score":1},{"id":-1,"score":1},{"score":1}]}')
    replies = listed.select("query_id", raw.alias("raw"), F.when(F.col("query_id") % 4 == 3, "quota used up").alias("error"))
    return rerank.reranked(listed, replies).select("query_id", "id", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"), "degraded")


@query(f"""{_JUDGED}, nb AS (SELECT answer_id, claim_idx, n, row_number() OVER (PARTITION BY answer_id ORDER BY claim_idx, n) - 1 AS spot FROM jd)
SELECT answer_id, (spot // 12)::INTEGER AS batch, (spot % 12)::INTEGER AS idx, CASE WHEN answer_id % 3 = 1 THEN NULL WHEN (spot % 12) % 4 = 0 THEN 0.25::DOUBLE WHEN (spot % 12) % 4 = 1 THEN 1.0 WHEN (spot % 12) % 4 = 2 AND answer_id % 3 = 0 THEN 0.0 END AS score FROM nb""")
def judge_replies(spark, sf_dir):
    """Pairs in requests of twelve, and replies with scores, with scores out of range or that are no numbers, and none."""
    batches = settle(rerank.batched(verify.judged_pairs(verify.holding(verify.citations(claims(spark, sf_dir), chunk_table(spark, sf_dir))))), "batches")
    third = F.when(F.col("answer_id") % 3 == 0, "0").otherwise("1.5")
    value = F.transform(F.sequence(F.lit(0), F.size("pairs") - 1), lambda i: F.when(i % 4 == 0, "0.25").when(i % 4 == 1, "1").when(i % 4 == 2, third).otherwise('"0.5"'))
    raw = F.when(F.col("answer_id") % 3 != 1, F.concat(F.lit('{"scores":['), F.array_join(value, ","), F.lit("]}")))
    replies = batches.select(F.struct("answer_id", "batch").alias("batch_id"), F.size("pairs").alias("n"), raw.alias("raw"))
    return rerank.scores(replies).select("batch_id.answer_id", "batch_id.batch", "idx", "score")
