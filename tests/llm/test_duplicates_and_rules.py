"""Near-duplicates, repetition, secrets, spans and the mix against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import mixing, near_dup, repetition, secrets, spans

from .conftest import SCHEMA, prose


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")


def shingles(text):
    w = words(lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows, percent=85):
    """rows: (id, text) with different ids."""
    sets, up = {d: shingles(t) for d, t in rows}, {d: d for d, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {d: (len(sets[d]), find(d), d == find(d)) for d in ids}


def edited(text, edits, seed):
    r, w = random.Random(seed), text.split(" ")
    for _ in range(edits):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def test_near_duplicates_against_brute_force(spark):
    """Chains and groups around the threshold, where the smallest id is rarely what the others resemble."""
    base = [prose(s, 200) for s in range(4)]
    rows = [(i, edited(base[i % 4], (i * 7) % 12, i)) for i in range(160)]
    chain = prose(50, 150)
    for i in range(12):
        chain = edited(chain, 2, 1000 + i)
        rows.append((200 + i, chain))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_of_odd_rows(odd, texts, none):
    got = near_dup.near_duplicates(odd).collect()
    assert len(got) == len(texts)
    expected = brute_components(list({d: t for d, t, *_ in texts if d is not None}.items()))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is not None} == expected
    assert near_dup.near_duplicates(none).collect() == []
    assert near_dup.keep_one(none).collect() == []


def brute_rows(rows, percent=85, by_id=True):
    """Of any rows (id or None, text): for each its set's size, group and the smallest id of the group."""
    found = brute_components(list(enumerate(t for _, t in rows)), percent)
    group = [found[i][1] for i in range(len(rows))]
    for i, (d, t) in enumerate(rows):
        for j in range(i):
            if by_id and d is not None and d == rows[j][0] and shingles(t) and shingles(rows[j][1]) and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    names = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    return [(found[i][0], group[i], names[group[i]] if found[i][0] else d) for i, (d, _) in enumerate(rows)]


def rows_of_one_id():
    """Other texts under one id, several null ids, repeats, and copies that only they connect."""
    a, b, c, d, e, f = (prose(s, 120) for s in range(300, 306))
    rows = [(1, a), (1, b), (2, edited(a, 1, 1)), (3, edited(b, 1, 2)), (9, c), (None, edited(c, 1, 3)), (None, d), (None, edited(d, 1, 4)), (None, e), (None, None), (None, "")]
    rows += [(20, f), (20, f), (20, ""), (20, None), (21, edited(f, 1, 5)), (5, a.upper()), (30, prose(400, 80)), (30, prose(401, 80)), (31, edited(prose(401, 80), 1, 6)), (29, edited(prose(400, 80), 1, 7))]
    return rows


def test_near_duplicates_of_other_texts_of_one_id(spark):
    rows = rows_of_one_id()
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    expected = [(d, n, name, d is not None and d == name) for (d, _), (n, _, name) in zip(rows, brute_rows(rows), strict=True)]
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, expected))


def test_keep_one_keeps_a_row_of_every_group(spark, odd, texts):
    rows = rows_of_one_id()
    kept = [tuple(r) for r in near_dup.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    found = brute_rows(rows, by_id=False)
    assert set(kept) <= set(rows) and len(kept) == len(set(kept))
    groups = {}
    for row, (n, group, name) in zip(rows, found, strict=True):
        groups.setdefault(group if n else ("empty", row), []).append((row, name))
    for members in groups.values():
        stay = [r for r in kept if r in {row for row, _ in members}]
        assert len(stay) == 1 and stay[0][0] == members[0][1]
    assert near_dup.keep_one(odd).columns == odd.columns
    assert near_dup.keep_one(odd).count() == sum(1 for _ in {g if n else (d, t) for (d, t), (n, g, _) in zip([(d, t) for d, t, *_ in texts], brute_rows([(d, t) for d, t, *_ in texts], by_id=False), strict=True)})


def test_rare_shingles_find_what_the_smallest_hides(spark):
    """Sizes from small to large, so that links cross the classes of sizes."""
    r, rows = random.Random(8), []
    for i in range(60):
        base = [f"x{i % 6}y{j}" for j in range(40)]
        rows.append((i, " ".join(base[: 30 + r.randrange(11)])))
    texts = spark.createDataFrame([(i, i, t, b"") for i, t in rows], "node long, component long, text string, bits binary")
    got = {tuple(x) for x in near_dup.rare_first(texts, 80).collect()}
    sets = {i: shingles(t) for i, t in rows}
    linked = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert linked and linked <= got


def test_estimate_is_corrected():
    a = [f"w{i}".encode() for i in range(2000)]
    b = a[:1500] + [f"v{i}".encode() for i in range(500)]
    x, y = (near_dup.signature(near_dup.shingle_hashes(w))[1] for w in (a, b))
    true = len(near_dup.shingles(a) & near_dup.shingles(b)) / len(near_dup.shingles(a) | near_dup.shingles(b))
    assert near_dup.estimate(x, x) == 1.0
    assert abs(near_dup.estimate(x, y) - true) < 0.2
    other = near_dup.signature(near_dup.shingle_hashes([f"z{i}".encode() for i in range(2000)]))[1]
    assert near_dup.estimate(x, other) < 0.2


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(500, 400), (400, 450)]
    got = {r["node"]: r["component"] for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    expected = {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 60)} | {500: 400, 450: 400}
    assert {k: v for k, v in got.items() if k != v} == expected


def brute_repetition(text):
    w = words(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen, cover = Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            cover |= set(range(i, i + 5))
    eights = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    more, long_cover = Counter(eights), set()
    for i, g in enumerate(eights):
        if more[g] > 1:
            long_cover |= set(range(i, i + 8))
    longest, n = 0, 1
    while n <= len(w) and max(Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)).values()) > 1:
        longest, n = n, n + 1
    lines = [x for x in (text or "").split("\n") if words(x)]
    failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
    kept = not failed and len(long_cover) <= 0.2 * len(w) and longest <= 200
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover), failed, kept, len(long_cover), longest


def test_repetition_against_brute_force(odd, texts, none):
    r = random.Random(5)
    more = [(900 + i, " ".join(r.choice("ab cd ef".split()[: 1 + i % 3]) for _ in range(r.randrange(40)))) for i in range(40)]
    more += [(990, prose(9, 300) + " x " + prose(9, 300)), (991, "#a *b\n#a *b\n\n \nc <d>")]
    rows = [(d, t) for d, t, *_ in texts if d != 10] + more
    got = repetition.repetition(odd.sparkSession.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = sorted(repr((d, *brute_repetition(t))) for d, t in rows)
    assert sorted(repr(tuple(x)) for x in got) == expected
    assert repetition.repetition(odd).count() == len(texts)
    assert repetition.repetition(none).collect() == []


def test_long_repeats_decide_beyond_the_base_rule(spark):
    """Rows that pass the base rule: by coverage one fails, by the longest repeat's part of the text another."""
    own = [f"own{i}" for i in range(1000)]
    many = [f"p{i}" for i in range(90)]
    long = [f"q{i}" for i in range(55)]
    short = [f"r{i}" for i in range(19)]
    rows = [(1, own[:820] + many + own[-1:] + many), (2, own[:890] + long + own[-1:] + long), (3, own[:260] + short + own[-1:] + short), (4, own)]
    got = {r["doc_id"]: r for r in repetition.repetition(spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")).collect()}
    assert {d: (r["n_covered"], r["longest_repeat"], r["base_failed"], r["kept"]) for d, r in got.items()} == {1: (180, 90, False, False), 2: (110, 55, False, False), 3: (38, 19, False, False), 4: (0, 0, False, True)}
    fits = [(5, own[:300] + short + own[-1:] + short), (6, own[:900] + long[:49] + own[-1:] + long[:49]), (7, own[:960] + ["la"] * 70), (8, own[:960] + ["la"] * 50)]
    got = {r["doc_id"]: (r["n_covered"], r["kept"]) for r in repetition.repetition(spark.createDataFrame([(d, " ".join(w)) for d, w in fits], "doc_id long, text string")).collect()}
    assert got == {5: (38, True), 6: (98, True), 7: (70, False), 8: (50, True)}


def brute_secrets(text):
    text, out = text or "", []
    for rank, rule in enumerate(secrets.RULES):
        pattern = rule.pattern.replace("{16,}", "+") if rule.kind == "hex" else rule.pattern
        out += [(m.start(), rank, rule.kind, m.end()) for m in re.finditer(pattern, text, re.ASCII) if len(m[rule.group]) >= rule.least]
    return [(k, s, e) for s, _, k, e in sorted(out)]


SECRETS = [
    "password: password: abcdefghijklmnop", "PassWord = 'abcdefghijkl' é api_key:ABCDEFGHIJKL0123 apikey=x", "😀 AKIA" + "A" * 14 + " AKIA" + "B" * 13, "deadbeef" * 3 + " x " + "0" * 15 + "g" + "f" * 16, "token=token=abcdefghijklmnop",
    "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a" * 36, "secret\":  \"0123456789abcdef0123\" " * 40, "eyJabcdefgh.ijklmnopq.rstuvwxyz", "", None, "nothing here",
]


def test_secrets_against_brute_force(spark, odd, texts, none):
    rows = [(i, t) for i, t in enumerate(SECRETS)] + [(d, t) for d, t, *_ in texts]
    got = secrets.report(secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    expected = []
    for d, t in rows:
        found = brute_secrets(t)
        base = [x for x in found if x[0] in ("assign", "access", "hex")]
        text = ",".join("%s:%d:%d" % x for x in base)
        expected.append((d, *(sum(x[0] == k for x in base) for k in ("assign", "access", "hex")), hashlib.sha256(text.encode()).hexdigest(), ",".join("%s:%d:%d" % x for x in found)))
    assert sorted(repr(tuple(x)) for x in got) == sorted(map(repr, expected))
    assert secrets.scan(odd).count() == len(texts)
    assert secrets.scan(none).collect() == []


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    first = spark.createDataFrame([(1, "password=abcdefghijklmnop"), (2, "password=abcdefghijklmnop"), (3, "plain")], "doc_id long, text string")
    assert [r["n_assign"] for r in secrets.report(secrets.scan(first, ledger)).orderBy("doc_id").collect()] == [1, 1, 0]
    assert spark.read.parquet(ledger).count() == 2
    second = spark.createDataFrame([(1, "password=abcdefghijklmnop"), (4, "AKIA" + "Z" * 16)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_assign"], r["n_access"]) for r in secrets.report(secrets.scan(second, ledger)).collect()}
    assert got == {1: (1, 0), 4: (0, 1)}
    assert spark.read.parquet(ledger).count() == 3
    newer = (*secrets.BASE[:2], secrets.Rule("hex", 2, "[0-9a-f]{4,}", 0, 4))
    again = {r["doc_id"]: r["spans"] for r in secrets.report(secrets.scan(first, ledger, newer)).collect()}
    assert again[1] == "assign:0:25,hex:9:15"
    assert spark.read.parquet(ledger).where("array_contains(rules, 'hex@2') and not array_contains(rules, 'assign@1')").count() == 2


def test_redaction(spark, odd, texts):
    rows = [(1, "é password=abcdefghijklmnop end", 1), (2, "plain", 5), (3, None, None), (4, "token=0123456789abcdef0123 AKIA" + "Q" * 16, 1)]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in secrets.redact(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()}
    assert got == {1: ("é [assign] end", 14), 2: ("plain", 5), 3: (None, None), 4: ("[assign] [access]", 17)}
    assert secrets.redact(odd).columns == odd.columns


def plain_sentences(text):
    """(text, lower-cased words) of each sentence: a word ends one if white space follows it and it ends in a mark, or
    if a line end follows it. Long ones are cut as the module's docstring says."""
    out, current = [], []
    for m in re.finditer(r"^[ \t-\r]+|[^ \t-\r]+[ \t-\r]*", text):
        word = m[0].strip(" \t\n\x0b\x0c\r")
        current.append((m[0], lower(word)))
        if word and (word[-1] in ".!?" and m[0] != word or "\n" in m[0]):
            out.append(current)
            current = []
    out += [current] if current else []
    cut = []
    for sentence in out:
        ws = [w for _, w in sentence if w]
        h = [xxhash.xxh3_64_intdigest(f"{x} {w}".encode()) for x, w in zip(["", *ws], ws, strict=False)]
        n, ends = len(ws), []
        if n > spans.MOST_WORDS:
            k, last = spans.NEAR, 0
            low = [i + 1 for i in range(n) if k <= i < n - k and all(h[i] < h[j] for j in range(i - k, i)) and all(h[i] <= h[j] for j in range(i + 1, i + k + 1))]
            for at in [*low, n]:
                while at - last > spans.MOST_WORDS:
                    last = max(range(last + k + 1, last + spans.MOST_WORDS + 1), key=lambda e: (-h[e - 1], e))
                    ends.append(last)
                ends += [at] if at < n else []
                last = at
        part, seen = [], 0
        for raw, w in sentence:
            part.append((raw, w))
            seen += bool(w)
            if w and seen in ends:
                cut.append(part)
                part = []
        cut += [part] if part else []
    return [("".join(raw for raw, _ in p), tuple(w for _, w in p if w)) for p in cut]


def plain_runs(tiles):
    """(start, end) of each run."""
    for i in range(len(tiles)):
        for end in range(i + spans.RUN, len(tiles) + 1):
            if sum(len(w) for _, w in tiles[i:end]) >= spans.LEAST_WORDS:
                yield i, end
                break


def place_of(row):
    """How rows come before each other: null ids first, then by id, then by what stands for id and text."""
    d, t = row
    named = "-" if d is None else f"{len(str(d))}:{d}"
    body = "-" if t is None else f"{len(t.encode())}:{t}"
    return d is not None, d or 0, hashlib.md5((named + body).encode()).digest()


def brute_spans(rows):
    """What is left of each row that loses something: of equal runs the first place stays."""
    tiles = {row: plain_sentences(row[1] or "") for row in rows}
    places = {}
    for row in tiles:
        for i, end in plain_runs(tiles[row]):
            places.setdefault(tuple(w for _, w in tiles[row][i:end]), []).append((place_of(row), i, end, row))
    gone = {row: set() for row in tiles}
    for found in places.values():
        for _, i, end, row in sorted(found, key=lambda x: x[:2])[1:]:
            gone[row] |= set(range(i, end))
    return [(d, "".join(raw for i, (raw, _) in enumerate(tiles[d, t]) if i not in gone[d, t])) for d, t in rows if gone[d, t]]


def test_spans_against_brute_force(spark, odd, texts, none):
    passage = ". ".join(" ".join(f"Word{i}{j}" for j in range(9)) for i in range(7)) + ". "
    own = [". ".join(f"Own {d} {i} sentence of some length here" for i in range(6)) + ". " for d in range(8)]
    rows = [(d, own[d] + (passage if d % 2 else "") + own[d][:40]) for d in range(8)] + [(20, passage + "Between. " + passage), (21, "")]
    got = [(r["doc_id"], r["text"]) for r in spans.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(brute_spans(rows))
    assert {d for d, _ in got} == {3, 5, 7, 20}
    assert all("Word" not in t and t.startswith(f"Own {d} 0") for d, t in got if d != 20)
    all_odd = [(d, t) for d, t, *_ in texts]
    got = [(r["doc_id"], r["text"]) for r in spans.remove_repeats(odd).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_spans(all_odd)))
    assert {d for d, _ in got} >= {7}
    assert spans.remove_repeats(none).collect() == []


def test_spans_of_other_texts_of_one_id(spark):
    """A row loses only what it repeats itself, whatever other rows of its id, or without one, repeat."""
    passage = "".join(f"Shared line {i} of five words\n" for i in range(8))
    alone = ["".join(f"Sentence {i} of {n} stands alone here. " for i in range(8)) for n in range(6)]
    rows = [(1, "Begins. " + passage), (7, "Copied. " + passage), (7, alone[0]), (None, alone[1] + passage), (None, alone[2]), (None, alone[3] + passage), (8, alone[4] + passage), (8, alone[4] + passage), (8, alone[5])]
    got = [(r["doc_id"], r["text"]) for r in spans.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_spans(rows)))
    left = {t for _, t in got}
    assert not left & {alone[0], alone[2], alone[5]} and alone[4] in left
    assert len(got) == 5


def test_shapes_are_the_callers_choice(spark):
    rows = [(d, f"Own {d} text here. One two three. Four five six. Seven eight nine. Own end {d}.") for d in range(2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert spans.remove_repeats(frame).collect() == []
    assert [r["n_removed"] for r in spans.remove_repeats(frame, spans.Shape(3, 1, None)).collect()] == [3]


def test_spans_of_short_lines(spark):
    """60 words in lines of 4: no three of them hold 15 words."""
    passage = "".join(f"Line {i} of verse\n" for i in range(15))
    rows = [(d, f"Own text {d} that comes first.\n{passage}Own text {d} that comes last.") for d in range(3)]
    got = {r["doc_id"]: r for r in spans.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: (r["n_removed"], r["words_removed"], r["text"]) for d, r in got.items()} == {d: (15, 60, f"Own text {d} that comes first.\nOwn text {d} that comes last.") for d in (1, 2)}


@pytest.mark.parametrize("ends", [(), (30, 60)])
def test_spans_at_any_offset(spark, ends):
    """Copies after 0 to 11 words of other text: 200 words without a border, or two sentences that run on from and into it."""
    n = max(ends, default=200)
    passage = " ".join(f"Passage{i}" + "." * (i + 1 in ends[:-1]) for i in range(n))
    rows = [(d, " ".join([*(f"before{d}x{i}" for i in range(d)), passage, *(f"after{d}x{i}" for i in range(9))])) for d in range(12)]
    got = {r["doc_id"]: r["text"] for r in spans.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == set(range(1, 12))
    assert all(t.count("Passage") <= 2 * spans.MOST_WORDS and t.count("before") == d and t.count("after") == 9 for d, t in got.items())


def test_cuts_of_a_repeated_phrase():
    words = [b"one", b"two", b"three"] * 40
    assert len({tuple(words[a:][:3]) for a in spans.cuts(words)[:-1]} & {tuple(words[1:][a:][:3]) for a in spans.cuts(words[1:])[:-1]}) > 0


@pytest.mark.parametrize("text", ["", "A b. C d! E\nF", "  x.  \n\n y ", " ".join(f"w{i}" for i in range(90)), "3.14 is pi. é"])
def test_sentences_tile(text):
    data = text.encode()
    found = spans.sentences(data)
    assert all(a[1] == b[0] for a, b in zip(found, found[1:], strict=False))
    if found:
        assert found[-1][1] == len(data)
    assert all(len(w) <= spans.MOST_WORDS for _, _, w in found)
    assert [w for _, _, ws in found for w in ws] == data.split()


def brute_targets(sizes):
    names = sorted(x for x in sizes if x is not None) + [x for x in sizes if x is None]
    weight, capped = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}, set()
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[x] for x in capped)
        free = sum(weight[x] for x in names if x not in capped)
        share = {x: rest * weight[x] / free if x not in capped else 2.0 * sizes[x] for x in names}
        more = {x for x in names if x not in capped and share[x] > 2 * sizes[x]}
        if not more:
            return share
        capped |= more


def test_mix(spark, odd, texts, none):
    r = random.Random(1)
    rows = [(i, " ".join(["w"] * r.randrange(1, 400)), "en", f"s{i % 5}" if i % 11 else None, 1) for i in range(4000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs).collect()
    sizes, taken, biggest = Counter(), Counter(), Counter()
    source = {d: s for d, _, _, s, _ in rows}
    for x in got:
        assert x["size"] == len(rows[x["doc_id"]][1].split())
        assert 0 <= x["taken"] <= 2 * x["size"]
        assert x["taken"] % x["size"] == 0
        sizes[source[x["doc_id"]]] += x["size"]
        taken[source[x["doc_id"]]] += x["taken"]
        biggest[source[x["doc_id"]]] = max(biggest[source[x["doc_id"]]], x["size"])
    goal = brute_targets(sizes)
    assert {source[x["doc_id"]]: x["target"] for x in got} == pytest.approx(goal)
    assert all(abs(taken[s] - goal[s]) <= biggest[s] for s in sizes)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((x["doc_id"], x["taken"]) for x in got) == sorted((x["doc_id"], x["taken"]) for x in again)
    weird = mixing.mix(odd).collect()
    assert len(weird) == len(texts)
    assert mixing.mix(none).collect() == []
    assert mixing.apply_mix(none).collect() == []
    applied = mixing.apply_mix(odd)
    assert applied.columns == odd.columns
    assert applied.count() == sum(x["copies"] for x in weird)


def test_mix_tells_rows_apart(spark):
    """Nulls, values that look like them, and rows that only differ in another column are rows of their own."""
    rows = [(1, "x", "en", None, 1), (1, None, "en", "x", 1), (1, "-", "en", None, 1), (None, "1:x", "en", None, 1), (2, "a b", "en", "s", 1), (2, "a b", "de", "s", 1), (2, "a b", None, "s", 1), (3, "same", "en", "s", 1), (3, "same", "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    taken = {}
    for r in mixing.mix(docs, share=2.0).collect():
        taken[r["row_key"]] = taken.get(r["row_key"], 0) + r["copies"]
    keys = [r["k"] for r in docs.select(mixing.key_of(docs).alias("k")).collect()]
    assert len(set(keys)) == len(set(rows)) == 8
    got = Counter(tuple(r) for r in mixing.apply_mix(docs, share=2.0).collect())
    assert got == Counter({row: taken[k] for row, k in zip(rows, keys, strict=True) if taken[k]})
    assert got[rows[0]] == 2 and got[rows[7]] == 4


def test_flight_keeps_sums():
    rng = np.random.default_rng(2)
    p, s = rng.random(500), rng.integers(1, 900, 500)
    out = mixing.flight(p, s, 3)
    assert ((out == 0) | (out == 1)).sum() >= 498
    assert out.sum() == pytest.approx(p.sum())
    assert (out * s).sum() == pytest.approx((p * s).sum())
    mean = np.mean([mixing.flight(p, s, k) for k in range(300)], axis=0)
    assert np.abs(mean - p).max() < 0.15


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, None: 10}, {"a": 0}, {"a": 5, "B": 7, "é": 900, "b": 0, "\U0001f600": 3, "\uffee": 80, None: 1}, {f"host{i:05}": (i * i) % 997 for i in range(500)}])
def test_targets_cap_and_share(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(5)
    got = {r["source"]: r["target"] for r in mixing.targets(frame).collect()}
    assert got == pytest.approx(brute_targets(sizes) if any(sizes.values()) else sizes)


def test_places_over_ranges(spark):
    """More ranges than one, so that numbers go on from range to range."""
    names = [f"s{i:04}" for i in range(3000)] + [None]
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    got = {r["source"]: r["place"] for r in mixing.placed(spark.createDataFrame([(x,) for x in reversed(names)], "source string")).collect()}
    spark.conf.set("spark.sql.adaptive.enabled", old)
    assert got == {x: i for i, x in enumerate(names)}


def test_size_of(spark, texts):
    frame = spark.createDataFrame([(t,) for _, t, *_ in texts], "t string")
    assert [r["n"] for r in frame.select(mixing.size_of(F.col("t")).alias("n")).collect()] == [len(words(t)) for _, t, *_ in texts]
