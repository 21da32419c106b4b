"""Language and quality on held-out rows, and the pipeline's stages."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import language, quality
from lodestone.llm.queries import queries

DATA = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r["doc_id"]: r for r in language.identify(docs).collect()}
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert {d for d, r in rows.items() if r["held_out"]} == {d for d in lang if zlib.crc32(str(d).encode()) % 3 == 1}
    tested = [d for d, r in rows.items() if r["held_out"]]
    assert np.mean([rows[d]["lang_pred"] == lang[d] for d in tested]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_language_ignores_what_it_must(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    other = docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("y"))
    assert sorted(map(tuple, language.identify(docs).collect())) == sorted(map(tuple, language.identify(other).collect()))


def test_language_of_odd_rows(odd, texts, none):
    rows = language.identify(odd).collect()
    assert len(rows) == len(texts)
    und = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
    assert und == {1, 2, 3, None}
    assert all(r["score"] == 0.0 for r in rows if r["lang_pred"] == "und")
    assert language.identify(none).collect() == []
    assert {r["lang_pred"] for r in language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_mixtures_find_both_languages():
    a, b = "the quick brown fox jumps over it ", "der schnelle braune fuchs springt hoch "
    table = np.full((language.CELLS, 3), 0.5)
    for i, t in enumerate((a, b, "xyz qqq www ")):
        table[:, i] += np.bincount(language.cells_of((t * 50).encode()), minlength=language.CELLS)
    logs = np.log(table / table.sum(axis=0))
    best, score, size = language.infer([(a * 9).encode(), (a * 6 + b * 3).encode(), (b * 9).encode()], logs)
    assert best.tolist() == [0, 0, 1]
    assert size.tolist() == [1, 2, 1]
    assert 0.5 < score[1] < 0.8 < min(score[0], score[2])


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    tested = [(r["quality"], rows[r["doc_id"]]["score"]) for r in labels.collect() if rows[r["doc_id"]]["held_out"]]
    assert np.mean([(s >= 0.5) == bool(y) for y, s in tested]) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in rows.values())


def test_quality_learns_from_training_rows_only(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(map(tuple, quality.classify(docs, labels).collect())) == sorted(map(tuple, quality.classify(docs.withColumn("source", F.lit("z")), flipped).collect()))


def test_quality_of_odd_rows(spark, odd, texts, none):
    labels = spark.createDataFrame([(100 + i, i % 2, 0) for i in range(30)] + [(100, None, 0), (None, 1, 0), (6, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(odd, labels).collect()
    assert len(rows) == len(texts)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert quality.classify(none, labels).collect() == []
    unlearnt = quality.classify(odd, labels.limit(0)).collect()
    assert {(r["score"], r["predicted"]) for r in unlearnt} == {(0.5, 1)}
    assert quality.keep_good(odd, labels).columns == odd.columns


def test_model_is_additive():
    rng = np.random.default_rng(4)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert {(0, 1)} <= {(i, j) for i, j, _ in model.pairs}
    fresh = rng.random((1000, 3))
    assert np.mean((model.score(fresh) >= 0.5) == ((fresh[:, 0] > 0.5) ^ (fresh[:, 1] > 0.5))) > 0.9
    total = np.full(1000, model.base)
    for i in range(3):
        total += model.tables[i][np.searchsorted(model.cuts[i], fresh[:, i], side="right")]
    for i, j, table in model.pairs:
        total += table[np.searchsorted(model.pair_cuts[i], fresh[:, i], side="right"), np.searchsorted(model.pair_cuts[j], fresh[:, j], side="right")]
    assert model.score(fresh) == pytest.approx(1 / (1 + np.exp(-total)))


def test_trees_split_where_it_pays():
    step = quality.tree(np.array([-5.0, -5, 5, 5]), np.ones(4), 2)
    assert step.tolist() == pytest.approx([-10 / 3, -10 / 3, 10 / 3, 10 / 3])
    assert quality.tree(np.zeros(3), np.ones(3)).tolist() == [0, 0, 0]


def test_pipeline(spark):
    """Each stage on what the one before kept, with its decisions in effect."""
    from lodestone.llm import near_dup, pieces, secrets

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, docs
    frames = []
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, sf_dir).cache()
        frames.append(kept)
    assert all(f.columns == columns for f in frames[:-1])
    good = {r["doc_id"] for r in quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in frames[0].collect()} == good
    alone = {r["doc_id"] for r in near_dup.near_duplicates(frames[0], corpus_pipeline.NEAR_PERCENT).where("kept").collect()}
    assert sorted(r["doc_id"] for r in frames[1].collect()) == sorted(alone)
    assert frames[2].count() == frames[1].count()
    assert secrets.scan(frames[2]).where("size(spans) > 0").count() == 0
    before = {r["doc_id"]: r["text"] for r in frames[2].collect()}
    assert all(before[r["doc_id"]] == r["text"] for r in frames[3].collect())
    model = pieces.encoder(corpus_pipeline.tokenizer("piece_bpe_32k.model")).model
    last = frames[4].collect()
    assert len(last) == frames[3].count()
    assert all(r["ids"] == [1, *model.encode(before[r["doc_id"]]), 2] for r in last[:50])
    assert corpus_pipeline.run(spark, sf_dir).count() == len(last)


def test_pipeline_links_from_80_percent(spark):
    """Pairs between 0.80 and 0.85, below 0.80, and above 0.85, against brute force."""
    rows, expected = [], set()
    for i, changed in enumerate((0, 3, 4, 5, 6, 20)):
        words = [f"w{i}x{j}" for j in range(204)]
        other = [f"new{j}" if j % 10 == 5 and j < 10 * changed else w for j, w in enumerate(words)]
        a, b = ({tuple(w[j : j + 5]) for j in range(200)} for w in (words, other))
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        expected |= {2 * i} if 100 * len(a & b) >= 80 * len(a | b) else {2 * i, 2 * i + 1}
        assert changed != 4 or 0.80 <= len(a & b) / len(a | b) < 0.85
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.distinct_documents(spark, docs, "").collect()} == expected
    assert 5 not in expected and len(expected) == 9


def test_names():
    assert [n.split("_")[0] for n in queries()] == [f"op{i}" for i in range(1, 14)]
