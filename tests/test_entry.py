"""The driver contract: what is registered runs, and equals its SQL on the smallest tables."""

import math
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lodestone.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One of each kind here; the driver runs all.
SOME = ["tokenize_documents", "bm25_topk", "dense_int8_topk", "rrf_fuse", "ablation_table", "fixed_windows", "claim_status", "citation_metrics_macro", "parse_verdicts", "rate_limit"]


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(value, 6) if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_equals_sql(spark, con, name):
    got = registry.queries()[name](spark, DATA)
    expected = con.sql(registry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    a = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    b = sorted((tuple(plain(v) for v in r) for r in expected.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()), key=repr)
    assert a == b


def test_registry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(registry.queries()) > 50


def test_stream_equals_table(spark, tmp_path):
    from lodestone.streaming import stateless

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = stateless.tokenized(stateless.read_documents(spark, str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("tokens").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(repr, spark.table("tokens").collect())) == sorted(map(repr, stateless.tokenized(docs).collect()))
