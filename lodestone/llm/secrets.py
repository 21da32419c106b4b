"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of every document is a blob named by the SHA-256 of its text. The ledger, a folder of Parquet files,
has a row for each blob and the rules (with their versions) that have seen it, with the findings. A scan takes each
blob once, runs only the rules that haven't seen it, appends to the ledger and joins the findings to all documents
whose text is that blob: a new rule version rescans every blob for that rule, new documents only their new blobs.

A span is a match's start and end (exclusive) in code points: the pieces between matches are what `split` leaves, so
sums of their lengths give the places without any code outside Spark's functions.

Defined cases: a null text counts as empty; rows with the same doc_id, and rows that repeat, are each reported; a null
doc_id is kept; an empty table gives an empty result; further columns are ignored; texts of any length are scanned
whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import let
from .common import scratch, whole


@dataclass(frozen=True)
class Rule:
    """A match counts if its group (0: all of it) has `least` characters or more."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


#: The order of kinds is the order of equal starts.
BASE = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),
)
#: Further kinds, public formats of keys and tokens.
RULES = (
    *BASE,
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    Rule("forge", 1, r"gh[oprsu]_[A-Za-z0-9]{36,}", 0, 1),
)

SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"


def blob_name(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


HITS = "array<struct<rank:int,at:int,before:bigint,length:int,counts:boolean>>"


def hits_of(text: Column, rule: Rule, rank: int) -> Column:
    """All matches of the rule, left to right, none overlapping: the characters between a match and the one before, its
    own, and whether it is long enough to count."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    between = F.split(text, rule.pattern, -1)
    lengths = F.arrays_zip(F.transform(found, F.length).alias("m"), F.transform(groups, F.length).alias("g"), F.transform(F.slice(between, 1, F.size(found)), F.length).alias("b"))
    hit = F.transform(lengths, lambda x, i: F.struct(F.lit(rank).alias("rank"), i.alias("at"), x["b"].cast("long").alias("before"), x["m"].alias("length"), (x["g"] >= rule.least).alias("counts")))
    return F.when(text.rlike(rule.pattern), hit).otherwise(F.expr(f"cast(array() as {HITS})"))


def spans_of(due: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, rules, spans) of blobs (blob, rules, hits): a match's place is the sum of what lies before it. Each match
    is a row here, so a text's time is in proportion to its matches."""
    listed = due.select("blob", "rules", F.explode_outer("hits").alias("hit")).select("blob", "rules", "hit.*")
    so_far = Window.partitionBy("blob", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("before") + F.col("length")).over(so_far).cast("int")
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    placed = listed.withColumn("end", end)
    span = F.struct((F.col("end") - F.col("length")).alias("start"), "rank", F.element_at(kinds, F.col("rank") + 1).alias("kind"), "end")
    return placed.groupBy("blob").agg(F.first("rules").alias("rules"), F.array_sort(F.collect_list(F.when(F.col("counts"), span))).cast(SPANS).alias("spans"))


def _ledger(spark, folder: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(f"blob binary, rules array<string>, spans {SPANS}").parquet(folder)


def findings(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans) of each blob of docs in which the rules find something, through the ledger.

    ledger: a folder that scans share; a new one if None. Blobs that it has for all rules aren't scanned.
    """
    spark = docs.sparkSession
    ledger = ledger or scratch(spark, "ledger")
    none = F.expr(f"cast(array() as {HITS})")
    ids = F.array(*[F.lit(r.id) for r in rules])
    blobs = docs.select(blob_name(F.col("text")).alias("blob"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).dropDuplicates(["blob"])
    before = _ledger(spark, ledger)
    if before is None:
        due = blobs.withColumn("seen", F.expr("cast(array() as array<string>)"))
    else:
        seen = before.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        due = blobs.join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", F.expr("cast(array() as array<string>)")))
        due = due.where(F.size(F.array_except(ids, F.col("seen"))) > 0)
    new = [F.when(F.array_contains("seen", r.id), none).otherwise(hits_of(F.col("text"), r, i)) for i, r in enumerate(rules)]
    due = due.select("blob", F.array_except(ids, F.col("seen")).alias("rules"), F.concat(*new).alias("hits"))
    spans_of(due, rules).write.mode("append").parquet(ledger)
    # rows of a blob share a rule only if two scans ran at once, and then its spans; of other rules nothing is taken
    current = F.array_intersect("rules", ids)
    wanted = F.filter("spans", lambda s: F.exists(current, lambda r: F.startswith(r, F.concat(s["kind"], F.lit("@")))))
    now = _ledger(spark, ledger)
    if before is not None:  # of a ledger that other scans have filled, only these documents' blobs
        now = now.join(docs.select(blob_name(F.col("text")).alias("blob")).distinct(), "blob", "left_semi")
    found = now.select("blob", wanted.alias("spans")).where(F.size("spans") > 0)
    # equal spans stand side by side once they are sorted; array_distinct would compare every pair of structs
    once = let(F.array_sort(F.flatten("lists")), lambda z: F.filter(z, lambda x, i: (i == 0) | (x != F.get(z, i - 1))))
    spans = F.when(F.size("lists") == 1, F.element_at("lists", 1)).otherwise(once)
    return found.groupBy("blob").agg(F.collect_list("spans").alias("lists")).select("blob", spans.alias("spans"))


def scan(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each row of docs: doc_id, blob, spans (of all rules, by start and order of rules)."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), blob_name(F.col("text")).alias("blob"))
    found = findings(docs, ledger, rules)
    return named.join(found, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.expr(f"cast(array() as {SPANS})")).alias("spans"))


#: Characters of the pieces that a text is cut into once, so that no place is counted from the text's start.
PIECE = 512


def _cut(pieces: Column, start: Column, end: Column) -> Column:
    """The text of these pieces from start to end."""
    first = (start / PIECE).cast("int")
    some = F.array_join(F.slice(pieces, first + 1, F.ceil(end / PIECE).cast("int") - first), "")
    return F.when(end > start, F.substring(some, start - first * PIECE + 1, end - start)).otherwise("")


def edits(found: DataFrame) -> DataFrame:
    """(blob, edits, last) of findings (blob, spans): for each finding that begins after all before it have ended, the
    kind, its start, and where the text before it begins; and the end of the last."""
    listed = found.select("blob", F.posexplode("spans").alias("at", "span")).select("blob", "at", "span.*")
    before = F.coalesce(F.max("end").over(Window.partitionBy("blob").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.when(F.col("start") >= F.col("before"), F.struct("at", "before", "start", "kind"))
    return listed.withColumn("before", before).groupBy("blob").agg(F.array_sort(F.collect_list(own)).alias("edits"), F.max("end").alias("last"))


def redact(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs, with each finding in text replaced by its kind in brackets (one pair for findings that overlap). n_chars,
    where there is one, follows the text."""
    due = edits(findings(docs, ledger, rules)).withColumnRenamed("blob", "key")
    text = F.col("row.text").cast("string")

    def done(pieces: Column) -> Column:
        parts = F.transform("edits", lambda e: F.concat(_cut(pieces, e["before"], e["start"]), F.lit("["), e["kind"], F.lit("]")))
        return F.concat(F.array_join(parts, ""), _cut(pieces, F.col("last"), F.length(text)))

    cut = let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), done)
    out = whole(docs, blob_name(docs["text"])).join(due, "key", "left").withColumn("new", F.when(F.col("last").isNotNull(), cut))
    new = {"text": F.coalesce("new", text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("new").isNull(), F.col("row.n_chars")).otherwise(F.length("new")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def written(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """Of scan's rows: the counts of base kinds, the digest of base spans, and all spans."""
    kinds = [r.kind for r in base]

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in kinds]
    return found.select("doc_id", *counts, F.sha2(written(F.filter("spans", lambda s: s["kind"].isin(kinds))), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
