"""The latest result of each key, over a stream that is stopped and begun again, equals the table's."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lodestone.streaming import stateful, stateless

SCHEMA = "user long, ts timestamp, n long, note string"


def begin(minute, second=0, micro=0):
    return dt.datetime(2024, 1, 1, 12) + dt.timedelta(minutes=minute, seconds=second, microseconds=micro)


def run(spark, where, keep_ms=3_600_000):
    """What comes out of the files that are there, from the checkpoint on."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
    out = stateful.latest(stream, "user", "ts", "n", delay="5 minutes", keep_ms=keep_ms)
    write = lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{where}/out")
    q = out.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.read.parquet(f"{where}/out")


def add(spark, where, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{where}/in")


def test_stream_equals_table_after_a_restart(spark, tmp_path):
    r, where, rows = random.Random(1), str(tmp_path), []
    for part in range(4):
        own = [(r.choice([1, 2, 3, (1 << 60) + 1]), begin(part * 3 + r.randrange(3), r.randrange(60), r.randrange(10**6)), r.choice([None, 5, (1 << 60) + 7]), r.choice(["a", None])) for _ in range(30)]
        own += [(9, begin(1), None, "no number"), (9, begin(1), 1, "number")]
        rows += own
        add(spark, where, own)
        if part == 1:
            run(spark, where)
    got = stateless.latest(run(spark, where), "user", "ts", "n", "batch").select("user", "ts", "n")
    want = stateless.latest(spark.createDataFrame(rows, SCHEMA), "user", "ts", "n").select("user", "ts", "n")
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 5


def test_late_results_and_older_ones_are_dropped(spark, tmp_path):
    where = str(tmp_path)
    add(spark, where, [(1, begin(30), 1, "first"), (2, begin(30), 1, "other")])
    run(spark, where)
    add(spark, where, [(1, begin(29), 2, "older"), (3, begin(10), 1, "too late"), (4, None, 1, "no time")])
    run(spark, where)
    add(spark, where, [(1, begin(31), 0, "newer")])
    assert sorted(r["note"] for r in run(spark, where).collect()) == ["first", "newer", "other"]


def test_state_goes_and_late_results_stay_dropped(spark, tmp_path):
    where = str(tmp_path)
    for minute, user in ((0, 1), (30, 2), (60, 2), (61, 2)):
        add(spark, where, [(user, begin(minute), 1, f"{user} at {minute}")])
        run(spark, where, keep_ms=60_000)
    add(spark, where, [(1, begin(0), 9, "late"), (1, begin(70), 0, "again")])
    assert {r["note"] for r in run(spark, where, keep_ms=60_000).where("user = 1").collect()} == {"1 at 0", "again"}
