"""Conversation repair against a shortest path over whole strings of edits, and against its SQL."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import conversations
from lodestone.llm.conversation_sql import op12_sql

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
INK = re.compile(r"[^\x20\x09-\x0D]")


def digest(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{len(text.encode())}:{text}".encode()).digest()


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        act = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if act == 1 else re.sub("[.!?]", "", text) if act == 2 else text
        out += [(conv, turn, "user" if act == 4 else role, text, i) for i in range({0: 0, 3: 2}.get(act, 1))]
    return out


def plain(rows):
    """Dijkstra over (row, roles so far as the pattern's place), by (cost, edits)."""
    found = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damaged(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], digest(r[2], r[3]), r[4]))
        seen, faults = set(), []
        for _, _, role, text, _ in own:
            ink = INK.findall(text)
            faults.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [r[1] for r in own if r[1] is not None]
        queue, done = [(0, "", 0, "", ())], set()
        while queue:
            cost, edits, i, roles, lines = heapq.heappop(queue)
            place = {"": 0, "s": 1}.get(roles, 2 if roles[-1:] == "u" else 3)
            if (i, place) in done:
                continue
            done.add((i, place))
            if i == len(own) and re.fullmatch(r"(s?(ua)+)?", roles):
                break
            new = "assistant" if place == 2 else "user"
            heapq.heappush(queue, (cost + 2, edits + "I", i, roles + new[0], (*lines, f"{new}:")))
            if i == len(own):
                continue
            role, text = own[i][2:4]
            heapq.heappush(queue, (cost + 3, edits + "D", i + 1, roles, lines))
            if faults[i] not in ("blank", "duplicate"):
                stays = faults[i] == "truncated"
                heapq.heappush(queue, (cost + 2 + stays, edits + "R", i + 1, roles + new[0], (*lines, f"{new}:{text}")))
                if role[:1] == new[0] or (role[:1] == "s" and not roles):
                    heapq.heappush(queue, (cost + stays, edits + "K", i + 1, roles + role[0], (*lines, f"{role}:{text}")))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        found[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return found


def many(seed, n):
    r = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(r.choice([0, 1, 1, 2, 3, 5, 9, 14])):
            text = r.choice(["Yes.", "No", "a b c!", " ", "", "Really?", "…", "tail. \t\n", "x\x0b", None, f"own {turn}."])
            rows.append((conv, r.choice([turn, turn, turn, turn // 2, turn * 3, None]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "Umbra"]), text))
    return rows + [(None, 1, "user", "Hi."), (None, None, None, None), (None, 2, "assistant", "Ho.")] + [rows[0], rows[0]]


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_random_conversations_equal_the_plain_version(spark):
    rows = many(1, 300)
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in ("gone", "copy", "digest", "fault", "act", "is_row", "found", "initial", "nth"):
        frame = frame.withColumn(name, F.lit("x"))
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in conversations.damaged_report(frame.repartition(5)).collect()}
    assert got == plain(rows)


def test_sql_gives_the_same(spark, tmp_path):
    rows = many(2, 120)
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    found = con.sql(op12_sql())
    key = lambda r: (r[0] is None, r[0] or 0)
    got = conversations.damaged_report(spark.createDataFrame(rows, SCHEMA)).select(*found.columns).collect()
    assert sorted((tuple(r) for r in got), key=key) == sorted(found.fetchall(), key=key)


def test_repaired_rows_follow_the_pattern_and_make_the_digest(spark):
    rows = spark.createDataFrame(many(3, 60), SCHEMA).withColumn("text", F.coalesce("text", F.lit("")))
    lines = {}
    for r in sorted(conversations.repaired(rows).collect(), key=lambda r: (r["conv_id"] is None, r["conv_id"], r["place"])):
        lines.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert all(re.fullmatch(r"(s?(ua)+)?", "".join(role[0] for role, _ in x)) for x in lines.values())
    for r in conversations.repair_report(rows).collect():
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in lines.get(r["conv_id"], [])).encode()).hexdigest()


def test_nothing_and_a_conversation_that_damage_empties(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert conversations.damaged_report(none).count() == 0
    gone = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    (row,) = conversations.damaged_report(spark.createDataFrame([(7, gone, "user", "Hi.")], SCHEMA)).collect()
    assert tuple(row[c] for c in COLUMNS) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("n", [5_000])
def test_one_giant_conversation_goes_over_many_batches(spark, n):
    r = random.Random(5)
    rows = [(1, t, r.choice(["user", "assistant"]), f"{t}" + r.choice([".", ""])) for t in range(n)]
    long = [(2, 0, "user", "word " * 400_000 + "."), (2, 1, "assistant", "end" + " \t" * 400_000)]
    frame = spark.createDataFrame(rows + long, SCHEMA)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        got = {x["conv_id"]: tuple(x[c] for c in COLUMNS) for x in conversations.damaged_report(frame).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plain(rows + long)


def test_backpointers_beyond_the_limit_lie_in_a_file(monkeypatch):
    monkeypatch.setattr(conversations, "HELD", 100)
    pointers, told = conversations.Pointers(), [i % 50_000 for i in range(1234)]
    for p in told:
        pointers.add(p)
    assert pointers.file and [p for block in pointers.backwards() for p in block] == told[::-1]
