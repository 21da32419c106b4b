"""Fragments of the DuckDB SQL that queries must equal."""

from __future__ import annotations

#: A character of private use, which marks borders.
CUT = "\ue000"


def camel(p: str) -> str:
    return rf"regexp_replace(regexp_replace({p}, '([\p{{Ll}}\p{{N}}])(\p{{Lu}})', '\1{CUT}\2', 'g'), '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1{CUT}\2', 'g')"


def tokens(text: str) -> str:
    """The tokens of a text, as a list."""
    parts = "regexp_split_to_array(w, '[-_.]')"
    none = "[]::VARCHAR[]"
    pieces = f"flatten(list_transform({parts}, lambda p: CASE WHEN contains({camel('p')}, '{CUT}') THEN list_transform(string_split({camel('p')}, '{CUT}'), lambda c: lower(c)) ELSE {none} END))"
    more = f"list_concat(CASE WHEN len({parts}) > 1 THEN list_transform({parts}, lambda p: lower(p)) ELSE {none} END, {pieces})"
    return rf"flatten(list_transform(regexp_extract_all(nfc_normalize(coalesce({text}, '')), '[\p{{L}}\p{{N}}]+(?:[-_.][\p{{L}}\p{{N}}]+)*'), lambda w: list_concat([lower(w)], CASE WHEN regexp_full_match(w, '\d+(\.\d+)+') THEN {none} ELSE {more} END)))"


def plain_tokens(text: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({text}, '')), '[\p{{L}}\p{{N}}]+')"


def normal(text: str) -> str:
    """Of quotes."""
    folded = f"translate({text}, '‘’‚‛′“”„‟″‐‑‒–—―−', '''''''''''\"\"\"\"\"-------')"
    return rf"trim(regexp_replace(nfc_normalize(replace({folded}, '…', '...')), '[\s\x{{0B}}\x{{85}}\p{{Z}}\x{{FEFF}}]+', ' ', 'g'))"


def bm25(tokens=tokens, k1: str = "1.2::DOUBLE", b: str = "0.75::DOUBLE", name: str = "", text: str = "text") -> str:
    """CTEs: d (documents' tokens), q (query terms), s (scores and first terms), and r (rankings)."""
    return f"""
d{name} AS (SELECT doc_id AS id, {tokens(text)} AS t FROM documents),
st{name} AS (SELECT count(*) AS n, sum(len(t))::DOUBLE / count(*) AS avgdl FROM d{name}),
qa{name} AS (SELECT item_id AS query_id, {tokens('text')} AS t FROM benchmark),
q{name} AS (SELECT query_id, term, min(pos) AS pos FROM (SELECT query_id, unnest(t) AS term, unnest(range(len(t))) AS pos FROM qa{name}) GROUP BY ALL),
p{name} AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(t) AS len, unnest(t) AS term FROM d{name}) WHERE term IN (SELECT term FROM q{name}) GROUP BY ALL),
f{name} AS (SELECT term, count(*) AS df FROM p{name} GROUP BY term),
w{name} AS (SELECT q.query_id, q.pos, q.term, p.id, p.len, p.tf, f.df, ln(1::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf, avgdl FROM q{name} q JOIN f{name} f ON f.term = q.term JOIN p{name} p ON p.term = q.term, st{name}),
s{name} AS (SELECT query_id, id, sum(idf * (tf * ({k1} + 1)) / (tf + {k1} * (1 - {b} + {b} * len / avgdl))) AS score, min(pos) AS first FROM w{name} GROUP BY ALL),
r{name} AS (SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first, id) AS rank FROM s{name}) WHERE rank <= 30)"""


UNIT = "list_transform(embedding, lambda x: (x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))))::FLOAT)"
UNITS = f"u AS (SELECT vec_id, label, {UNIT} AS u FROM embeddings)"
CODES = f"""{UNITS},
pk AS (SELECT *, list_max(list_transform(u, lambda x: abs(x::DOUBLE))) AS peak FROM u),
c AS (SELECT vec_id, u, (peak / 127)::FLOAT AS scale, list_transform(u, lambda x: floor(x::DOUBLE / peak * 127 + 0.5::DOUBLE)::INTEGER) AS codes FROM pk)"""


def dense(score: str, name: str = "") -> str:
    """CTE dr: rankings of every twentieth vector against all, by an expression over a (query) and b (vector)."""
    return f"""dr{name} AS (SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, {score} AS score FROM c a, c b WHERE a.vec_id % 20 = 0)) WHERE rank <= 30)"""


INT8_SCORE = "list_sum(list_transform(list_zip(a.u, b.codes), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) * b.scale::DOUBLE"
FLOAT_SCORE = "list_sum(list_transform(list_zip(a.u, b.u), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"

#: Relevance: 2 for documents that hold a passage, 1 for others that share its first inner window of eight words.
QRELS = r"""
bw AS (SELECT item_id, text, regexp_extract_all(text, '\S+') AS w FROM benchmark),
bx AS (SELECT item_id AS query_id, text, array_to_string(w[2:9], ' ') AS win FROM bw WHERE len(w) >= 10),
dw AS (SELECT doc_id, text, ' ' || array_to_string(regexp_extract_all(coalesce(text, ''), '\S+'), ' ') || ' ' AS line FROM documents),
qrels AS (SELECT query_id, doc_id AS id, CASE WHEN contains(dw.text, bx.text) THEN 2 ELSE 1 END AS grade FROM bx JOIN dw ON contains(line, ' ' || win || ' ')),
questions AS (SELECT item_id AS query_id, ['identifier', 'conceptual', 'design', 'refusal'][item_id % 4 + 1] AS kind FROM benchmark)"""
