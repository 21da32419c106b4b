"""Windows found by their rarest shingles against a plain search, and ids that pass through models."""

import random

from lodestone.operators import contain, providers


def test_windows_equal_a_plain_search(spark):
    r = random.Random(1)
    word = lambda: r.choice("abcdefg")
    docs = [(i, " ".join(word() for _ in range(r.randrange(60))) + r.choice(["", "\n", "  x\ty"])) for i in range(200)] + [(900, None), (901, "")]
    windows = [(i, " ".join(word() for _ in range(r.randrange(3, 7)))) for i in range(120)] + [(500, "z z z")]
    want = {(q, d) for q, w in windows for d, t in docs if f" {' '.join(w.split())} " in f" {' '.join((t or '').split())} "}
    a, b = spark.createDataFrame(docs, "id long, text string").repartition(4), spark.createDataFrame(windows, "query_id long, text string")
    assert want and {(x["query_id"], x["id"]) for x in contain.containing(a, b, 3).collect()} == want


def test_few_pairs_meet(spark):
    docs = spark.createDataFrame([(i, f"this very common beginning of all texts then number {i} of many more") for i in range(400)], "id long, text string")
    windows = spark.createDataFrame([(q, f"all texts then number {q} of many more") for q in range(0, 400, 10)], "query_id long, text string")
    assert contain.candidates(docs, windows, 5).count() == 40 == contain.containing(docs, windows, 5).count()


def test_ids_stay_through_models(spark):
    big = (1 << 60) + 1
    texts = spark.createDataFrame([(big, "one"), (None, "two"), (big + 2, None)], "id long, text string")
    assert {x["id"] for x in providers.embed(texts, providers.HashEncoder()).collect()} == {big, None, big + 2}
