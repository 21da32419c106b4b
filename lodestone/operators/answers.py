"""Model answers and verdicts: untrusted JSON to typed rows, with a reason for all that is dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

LABELS = {"supported": 1.0, "partially_supported": 0.5, "not_supported": 0.0}


def kind_of(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, a number's type, VOID, or null where there is nothing."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def as_strings(v: Column) -> Column:
    """array<string>, or null unless v is an array of strings only."""
    listed = F.from_json(F.to_json(v), "array<variant>")
    return F.when((kind_of(v) == "ARRAY") & F.forall(listed, lambda x: kind_of(x) == "STRING"), F.transform(listed, lambda x: F.try_variant_get(x, "$", "string")))


def by_level(sentences: Column) -> Column:
    """Sentences that name a level, from the lowest up, in the places that such sentences have; the rest stays."""
    ranked = F.transform(sentences, lambda s, i: F.struct(T.level_rank(s).alias("rank"), i.alias("i"), s.alias("s")))
    named = F.filter(ranked, lambda x: x["rank"].isNotNull())
    places, ordered = F.transform(named, lambda x: x["i"]), F.array_sort(named)
    return F.transform(ranked, lambda x: F.when(x["rank"].isNull(), x["s"]).otherwise(F.try_element_at(ordered, F.array_position(places, x["i"]).cast("int"))["s"]))


def parse(raw: DataFrame) -> DataFrame:
    """raw (answer_id, raw) to (answer_id, error, answerable, sentences, claims, dropped). With an error the rest is
    null; claims are (sentence, chunk_ids, quote)."""
    v = raw.select("answer_id", F.try_parse_json("raw").alias("v"))
    v = v.select("*", as_strings(field(F.col("v"), "sentences")).alias("said"), kind_of(field(F.col("v"), "answerable")).alias("kind"), field(F.col("v"), "claims").alias("cl"))
    v = v.withColumn("clean", F.filter(F.transform("said", lambda s: F.trim(T.strip_markers(s))), lambda s: s != ""))
    error = (
        F.when(F.coalesce(kind_of(F.col("v")), F.lit("")) != "OBJECT", "answer is not an object")
        .when(F.coalesce("kind", F.lit("")) != "BOOLEAN", "answer.answerable is not a boolean")
        .when(F.col("said").isNull(), "answer.sentences is not an array of strings")
        .when(F.size("clean") == 0, "answer.sentences is empty")
        .when(F.coalesce(kind_of(F.col("cl")), F.lit("")) != "ARRAY", "answer.claims is not an array")
    )
    v = v.withColumn("error", error)
    listed = F.when(F.col("error").isNull(), F.from_json(F.to_json("cl"), "array<variant>"))

    def read(c: Column, i: Column) -> Column:
        index, ids, quote = field(c, "sentenceIndex"), field(c, "chunkIds"), field(c, "quote")
        number = F.try_variant_get(index, "$", "double")
        strings = as_strings(ids)
        problem = (
            F.when(F.coalesce(kind_of(c), F.lit("")) != "OBJECT", "not an object")
            .when(~F.coalesce(kind_of(index).isin("BIGINT", "DECIMAL", "DOUBLE") & (number == F.floor(number)), F.lit(False)), "sentenceIndex is not an integer")
            .when((number < 0) | (number >= F.size("clean")), F.concat(F.lit("sentenceIndex "), number.cast("long").cast("string"), F.lit(" is out of range")))
            .when(strings.isNull(), "chunkIds is not an array of strings")
            .when(F.size(strings) == 0, "chunkIds is empty")
            .when(F.coalesce(kind_of(quote), F.lit("")) != "STRING", "quote is not a string")
            .when(F.trim(F.try_variant_get(quote, "$", "string")) == "", "quote is empty")
        )
        sentence = F.try_element_at("clean", (F.try_cast(number, "int") if hasattr(F, "try_cast") else number.cast("int")) + 1)
        return F.struct(F.concat(F.lit("claim "), i.cast("string"), F.lit(": "), problem).alias("dropped"), F.struct(sentence.alias("sentence"), F.array_distinct(strings).alias("chunk_ids"), F.try_variant_get(quote, "$", "string").alias("quote")).alias("claim"))

    v = v.withColumn("all", F.transform(listed, read))
    good = F.col("error").isNull()
    return v.select(
        "answer_id", "error", F.when(good, F.try_variant_get("v", "$.answerable", "boolean")).alias("answerable"), F.when(good, by_level(F.col("clean"))).alias("sentences"),
        F.transform(F.filter("all", lambda x: x["dropped"].isNull()), lambda x: x["claim"]).alias("claims"), F.transform(F.filter("all", lambda x: x["dropped"].isNotNull()), lambda x: x["dropped"]).alias("dropped"),
    )


def verdicts(raw: DataFrame) -> DataFrame:
    """raw (batch_id, n, raw) to (batch_id, idx, score), a row for each of n pairs: null where the verdict is missing or
    bad; of several for one pair the last counts."""
    listed = F.from_json(F.to_json(field(F.try_parse_json("raw"), "verdicts")), "array<variant>")
    found = raw.select("batch_id", "n", F.posexplode(listed).alias("pos", "x")).select("batch_id", "n", "pos", F.try_variant_get("x", "$.index", "double").alias("i"), F.try_variant_get("x", "$.label", "string").alias("label"), kind_of(field(F.col("x"), "index")).alias("kind"))
    score = F.element_at(F.create_map(*[F.lit(x) for p in LABELS.items() for x in p]), F.col("label"))
    good = found.where(F.col("kind").isin("BIGINT", "DECIMAL", "DOUBLE") & (F.col("i") == F.floor("i")) & (F.col("i") >= 0) & (F.col("i") < F.col("n")) & F.col("label").isin(*LABELS))
    last = good.select("batch_id", F.col("i").cast("int").alias("idx"), score.alias("score"), "pos").withColumn("r", F.row_number().over(Window.partitionBy("batch_id", "idx").orderBy(F.desc("pos")))).where("r = 1")
    pairs = raw.where("n > 0").select("batch_id", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("idx"))
    return pairs.join(last.select("batch_id", "idx", "score"), ["batch_id", "idx"], "left")
