"""Language and quality against plain versions that share no code with the operators; the pipeline on odd rows."""

import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import language, quality

DATA = "/root/testdata/sf0.001"


def learns(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 != 1


def trigrams(text):
    flat = re.sub(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]", b" ", text.encode()).lower()
    flat = b" " + flat + b" "
    return Counter((int.from_bytes(flat[i : i + 3], "big") * 2654435761 % (1 << 32)) >> 18 for i in range(len(flat) - 2))


def speaks(text):
    return text is not None and any(c.isalpha() for c in text)


def plain_languages(rows):
    """rows: (doc_id, text, lang). In the order of rows: (language, proportion, size of the set)."""
    counts = defaultdict(Counter)
    for doc_id, text, lang in rows:
        if learns(doc_id) and lang is not None and speaks(text):
            counts[lang].update(trigrams(text))
    langs = sorted(counts)
    sums = {x: sum(counts[x].values()) + 0.5 * (1 << 14) for x in langs}

    def mixed(own, allowed):
        p = [{c: (counts[x][c] + 0.5) / sums[x] for c in own} for x in allowed]
        share, n = [1 / len(allowed)] * len(allowed), sum(own.values())
        for _ in range(12):
            new = [0.0] * len(allowed)
            for c, w in own.items():
                parts = [s * q[c] for s, q in zip(share, p)]
                whole = sum(parts)
                for i, part in enumerate(parts):
                    new[i] += w * part / whole
            share = [x / n for x in new]
        return share, sum(w * math.log(sum(s * q[c] for s, q in zip(share, p))) for c, w in own.items())

    out = []
    for _, text, _ in rows:
        if not langs or not speaks(text):
            out.append(("und", 0.0, 0))
            continue
        own = trigrams(text)
        every = dict(zip(langs, mixed(own, langs)[0]))
        likely = {x: mixed(own, [x])[1] for x in langs}
        chosen = [max(langs, key=lambda x: (likely[x], -langs.index(x)))]
        share, reached = {chosen[0]: 1.0}, likely[chosen[0]]
        while len(chosen) < len(langs):
            more = sorted([*chosen, max((x for x in langs if x not in chosen), key=lambda x: (every[x], -langs.index(x)))])
            new, gained = mixed(own, more)
            if gained - reached <= 6 * math.log(sum(own.values()) + 1):
                break
            chosen, share, reached = more, dict(zip(more, new)), gained
        best = max(share, key=lambda x: (share[x], -langs.index(x)))
        out.append((best, every[best], len(chosen)))
    return out


@pytest.mark.parametrize("which", ["given", "odd"])
def test_languages_equal_the_plain_version(spark, odd, which):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 90 OR doc_id % 20 = 0") if which == "given" else odd
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    got = sorted(((r["doc_id"], r["lang_pred"], r["score"], r["n_languages"]) for r in language.identify(docs).collect()), key=key)
    want = sorted(((r[0], *p) for r, p in zip(rows, plain_languages(rows))), key=key)
    assert [(g[0], g[1], g[3]) for g in got] == [(w[0], w[1], w[3]) for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-6)


def plain_features(text):
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * 17
    n, m = len(data), len(words)
    byte = Counter(data)
    of = lambda chars: sum(byte[ord(c)] for c in chars)
    upper, lower = sum(byte[b] for b in range(65, 91)), sum(byte[b] for b in range(97, 123))
    lines = [x for x in data.split(b"\n") if x.strip()]
    sizes = [len(w) for w in words]
    pairs = {(a, b) for a, b in zip(words, words[1:])}
    return [
        math.log1p(m), math.log1p(n), sum(sizes) / m, of("#*$%&|<>~^=@{}[]\\_/+") / m, of("!") / m, upper / max(1, upper + lower), of("0123456789") / n, of(".,;:?") / m, sum(c for b, c in byte.items() if b >= 128) / n,
        (sum(byte[b] for b in range(9, 14)) + byte[32]) / n, len(set(words)) / m, 1 - len(set(lines)) / len(lines), math.log1p(m / len(lines)), -sum(c / n * math.log2(c / n) for c in byte.values()),
        sum(s <= 3 for s in sizes) / m, math.log1p(max(sizes)), 1 - len(pairs) / max(1, m - 1),
    ]


def test_features_equal_the_plain_version(spark, odd, texts):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    rows = [r["text"] for r in docs.collect()]
    got = sorted([r[f] for f in quality.FEATURES] for r in quality.feature_rows(docs).collect())
    for g, w in zip(got, sorted(map(plain_features, rows)), strict=True):
        assert g == pytest.approx(w, rel=1e-9, abs=1e-9)


def quantiles(values, bins):
    s, out = sorted(values), []
    for i in range(1, bins):
        at = i / bins * (len(s) - 1)
        k = int(at)
        out.append(s[k] + (at - k) * (s[min(k + 1, len(s) - 1)] - s[k]))
    return sorted(set(out))


def grown(g, w, leaves):
    """Values of bins: the best split of all leaves, one after another, by plain sums."""
    score = lambda a, b: sum(g[a:b]) ** 2 / (sum(w[a:b]) + 1)
    edges = [0, len(g)]
    while len(edges) <= leaves:
        found = [(score(a, c) + score(c, b) - score(a, b), -c) for a, b in zip(edges, edges[1:]) for c in range(a + 1, b)]
        if not found or max(found)[0] <= 1e-9:
            break
        edges = sorted([*edges, -max(found)[1]])
    return [sum(g[a:b]) / (sum(w[a:b]) + 1) for a, b in zip(edges, edges[1:]) for _ in range(b - a)]


def test_boosting_equals_the_plain_version(monkeypatch):
    import random

    import numpy as np

    monkeypatch.setattr(quality, "ROUNDS", 12)
    monkeypatch.setattr(quality, "PAIR_ROUNDS", 0)
    monkeypatch.setattr(quality, "PAIRS", 0)
    r = random.Random(6)
    x = [[r.gauss(0, 1) for _ in range(4)] for _ in range(200)]
    y = [int(a + 0.5 * b + r.gauss(0, 0.5) > 0) for a, b, *_ in x]
    mean = sum(y) / len(y)
    total = [math.log(mean / (1 - mean))] * len(y)
    cuts = [quantiles([row[i] for row in x], 32) for i in range(4)]
    place = [[sum(c <= row[i] for c in cuts[i]) for row in x] for i in range(4)]
    for _ in range(12):
        for i in range(4):
            g, w = [0.0] * (len(cuts[i]) + 1), [0.0] * (len(cuts[i]) + 1)
            for k, t in enumerate(total):
                p = 1 / (1 + math.exp(-t))
                g[place[i][k]] += y[k] - p
                w[place[i][k]] += p * (1 - p)
            step = [0.1 * v for v in grown(g, w, 4)]
            total = [t + step[place[i][k]] for k, t in enumerate(total)]
    model = quality.fit(np.array(x), np.array(y, float))
    assert model.score(np.array(x)).tolist() == pytest.approx([1 / (1 + math.exp(-t)) for t in total], abs=1e-9)
    assert list(combinations(range(2), 2)) == [(0, 1)] and model.pairs == []


def test_pipeline_on_odd_rows_and_on_none(spark, odd, none, tmp_path):
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(100, 130)], "doc_id long, quality int, toxic int")
    for name, docs in (("odd", odd.drop("spans", "p")), ("none", none)):
        where = str(tmp_path / name)
        docs.write.parquet(f"{where}/documents.parquet")
        labels.write.parquet(f"{where}/labels.parquet")
        got = corpus_pipeline.run(spark, where).collect()
        if name == "none":
            assert got == []
            continue
        good = {r["doc_id"] for r in quality.classify(docs, labels).where("predicted = 1").collect()}
        assert got and {r["doc_id"] for r in got} <= good
        assert all(r["ids"][0] == 1 and r["ids"][-1] == 2 and r["n_tokens"] == len(r["ids"]) for r in got)
        known = dict(docs.select("doc_id", "text").where(F.col("doc_id") >= 100).collect())
        assert len({r["decoded_sha256"] for r in got if r["doc_id"] in known}) == len({r["doc_id"] for r in got if r["doc_id"] in known})
