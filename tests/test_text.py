"""Tokenizers, normal forms, levels and markers against hand-made cases."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("aria-describedby", ["aria-describedby", "aria", "describedby"]),
        ("errorMessage", ["errormessage", "error", "message"]),
        ("ARIALabel", ["arialabel", "aria", "label"]),
        ("data-errorMessage", ["data-errormessage", "data", "errormessage", "error", "message"]),
        ("2.4.11", ["2.4.11"]),
        ("SC 1.4.3", ["sc", "1.4.3"]),
        ("The focus indicator must be visible.", ["the", "focus", "indicator", "must", "be", "visible"]),
        ("gap-4", ["gap-4", "gap", "4"]),
        ("résumé", ["résumé"]),
        ("H2O v1.x", ["h2o", "h2", "o", "v1.x", "v1", "x"]),
        ("", []),
        (" !? ", []),
    ],
)
def test_tokens(spark, text, expected):
    assert one(spark, T.tokens(F.col("t")), t=text) == expected


def test_tokens_of_null(spark):
    assert spark.sql("select cast(null as string) as t").select(T.tokens(F.col("t"))).first()[0] == []


def test_plain_tokens(spark):
    assert one(spark, T.plain_tokens(F.col("t")), t="aria-describedBy 2.4") == ["aria", "describedby", "2", "4"]


def test_nfc(spark):
    assert one(spark, T.nfc(F.col("t")), t="e\u0301") == unicodedata.normalize("NFC", "e\u0301") == "\u00e9"


def test_normal_forms_of_marks(spark):
    """Clusters: a quote mark with an accent isn't folded, Korean letters apart stay apart, white space takes its marks."""
    texts = ["cafe\u0301 \u2019\u0301 \u2019", "\u1100\u1161", "a \u0301b", " \u0301x", "\u212b\u2026\u0327", "n\u0303\u0301o", "\u03a9 \u2013", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in frame.select(T.normalize_for_match(F.col("t"))).collect()] == [None if t is None else T.Normal(t).text for t in texts]
    assert [r[0] for r in frame.select(T.nfc(F.col("t"))).collect()] == [None if t is None else unicodedata.normalize("NFC", t) for t in texts]


@pytest.mark.parametrize("text", ["\u0130stanbul x", "\u0391\u03a3 a", "Plain Words only 12", "e\u0301Tat", "x-1 y"])
def test_tokens_by_either_way(spark, text):
    """Texts that need the words one by one, and those that don't, by the definition."""
    composed, out = unicodedata.normalize("NFC", text), []
    for word in re.findall(r"[^\W_]+(?:[-_.][^\W_]+)*", composed):
        own = [word, *(word.split("-") if "-" in word else [])]
        out += [w.lower() for w in own] + [p.lower() for p in re.split("(?<=[a-z\u00e9])(?=[A-Z])", word) if p != word]
    assert one(spark, T.tokens(F.col("t")), t=text) == out


@pytest.mark.parametrize(
    ("text", "expected"),
    [("a  \n\t b", "a b"), ("don’t “quote” me — please…", "don't \"quote\" me - please..."), ("  x ", "x"), ("Case Kept", "Case Kept")],
)
def test_normalize_for_match(spark, text, expected):
    assert one(spark, T.normalize_for_match(F.col("t")), t=text) == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Large text needs 3:1. [claim 0]", "Large text needs 3:1."),
        ("Use a label [not a placeholder].", "Use a label [not a placeholder]."),
        ("So. [0123456789abcdef, 0123456789abcdef] [Sources 1, 2]", "So."),
        ("x [1] y", "x [1] y"),
    ],
)
def test_strip_markers(spark, text, expected):
    assert one(spark, T.strip_markers(F.col("t")), t=text) == expected


def test_levels(spark):
    rows = [("Contrast (Level AAA)", "", "AAA"), ("Contrast", "x (Level AA) y (Level AA)", "AA"), ("Contrast", "(Level A) (Level AA)", None), ("", "", None)]
    frame = spark.createDataFrame(rows, "title string, text string, expected string")
    assert all(r[0] == r[1] for r in frame.select(T.level_of(F.col("title"), F.col("text")), "expected").collect())
    named = spark.createDataFrame([("A large text rule.", None, "A", False), ("At Level A it holds.", None, "A", True), ("Under AAA.", None, "AA", False), ("Under 1.4.6 it holds.", "1.4.6", "AAA", True), ("Livello A vale", None, "A", True)], "s string, r string, l string, expected boolean")
    assert all(r[0] == r[1] for r in named.select(T.names_level(F.col("s"), F.col("r"), F.col("l")), "expected").collect())


@pytest.mark.parametrize(
    ("path", "expected"),
    [(["WCAG", "Understanding SC 1.4.3 Contrast"], "1.4.3"), (["2.4.11 Focus", "Intent"], "2.4.11"), (["Checkboxes"], None), ([], None), (["Success Criterion 2.4.1", "SC 2.4.11 x"], "2.4.11")],
)
def test_sc_ref(spark, path, expected):
    frame = spark.createDataFrame([(path,)], "p array<string>")
    assert frame.select(T.sc_ref_of(F.col("p"))).first()[0] == expected


def test_source_block_escapes(spark):
    frame = spark.createDataFrame([("c", 'a "b" & <c>', "text"), ("d", None, "text")], "i string, t string, x string")
    out = [r[0] for r in frame.select(T.source_block(F.col("i"), F.col("t"), F.col("x"))).collect()]
    assert out == ['<source id="c" title="a &quot;b&quot; &amp; &lt;c&gt;">\ntext\n</source>', '<source id="d">\ntext\n</source>']


def test_document_text_keeps_empty_path(spark):
    frame = spark.createDataFrame([([], "t"), (["a", "b"], "t")], "p array<string>, t string")
    assert [r[0] for r in frame.select(T.document_text(F.col("p"), F.col("t"))).collect()] == ["\nt", "a > b\nt"]
