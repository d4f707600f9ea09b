import random

from pyspark.sql import functions as F

from lodestone.operators import rounds as R
from lodestone.streaming import limiter
from lodestone.streaming import rounds as S
from lodestone.streaming import windows as W
from lodestone.streaming.state import drained

SCHEMA = "cluster_id bigint, ts timestamp, event_id bigint, kind string, client_id bigint, lag bigint, num_examples bigint"


def events(spark):
    i = F.col("id")
    kind = F.when(i % 9 == 8, "aggregate").when(i % 23 == 0, "move").when(i % 17 == 0, "peek").otherwise("upload")
    df = spark.range(400).select((i % 3).alias("cluster_id"), F.timestamp_seconds(1_700_000_000 + F.floor(i / 5)).alias("ts"), i.alias("event_id"), kind.alias("kind"), (i % 7).alias("client_id"), (i % 10 == 0).cast("bigint").alias("lag"), (i % 4).alias("num_examples"))
    return df.select(*[c.split()[0] for c in SCHEMA.split(", ")])


def test_stream_equals_replay(spark, tmp_path):
    df = events(spark)
    for n in range(4):  # four files, in order of time
        df.where((F.col("event_id") >= 100 * n) & (F.col("event_id") < 100 * n + 100)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = S.stream(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == sorted(map(tuple, S.replay(df).collect())) and len(got) == 400
    assert {r[3] for r in got} >= {200, 201, 404, 409}


def test_rules():
    c = S.Cluster()
    assert [c.handle("upload", i, 0, 1) for i in (1, 2)] == [201, 201]
    assert c.handle("aggregate", 0, 0, 0) == 409 and len(c.uploads) == 2
    assert c.handle("upload", 2, 0, 5) == 201 and len(c.uploads) == 2
    assert c.handle("upload", 3, 1, 1) == 409 and c.handle("upload", 3, 0, 1) == 201
    assert c.handle("peek", 0, 0, 0) == 200 and c.round_id == 0
    assert c.handle("aggregate", 0, 0, 0) == 200 and (c.round_id, c.uploads) == (1, {})
    for i in range(S.CAPACITY):
        assert c.handle("upload", i, 1, 1) == 201
    assert c.handle("upload", 999, 1, 1) == 429 and c.handle("upload", 3, 1, 2) == 201


def test_windows(spark):
    rows = spark.createDataFrame([(f"2024-01-01 00:{m:02d}:00", "a") for m in (0, 5, 10, 40)], "t string, k string").withColumn("t", F.to_timestamp("t"))
    assert sorted(r.n for r in W.windowed_counts(rows, "t", ["k"], "30 minutes", "1 minute").collect()) == [1, 3]
    assert sorted(r.n for r in W.sessions(rows, "t", ["k"], "6 minutes", "1 minute").collect()) == [1, 3]


def requests(spark):
    r = random.Random(1)
    rows = [(r.choice("xxxy"), float(t), i) for i, t in enumerate(sorted(r.choice([r.randint(0, 200), r.randint(500, 600)]) for _ in range(300)))]
    return rows, spark.createDataFrame(rows, "c string, t double, i int").withColumn("t", F.timestamp_seconds("t"))


def test_limiter_over_restarts_equals_the_batch(spark, tmp_path):
    rows, df = requests(spark)
    cuts = [0, 90, 170, 300]
    cuts = [next(i for i in range(c, 301) if i in (0, 300) or rows[i][1] != rows[i - 1][1]) for c in cuts]
    for a, b in zip(cuts, cuts[1:], strict=False):
        df.where((F.col("i") >= a) & (F.col("i") < b)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        arriving = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        drained(limiter.token_buckets(arriving, "c", "t", "i", 4.0, 0.2, 60.0), f"{tmp_path}/out", f"{tmp_path}/ck")
    got = {x.i: x.allowed for x in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {x.i: x.allowed for x in R.token_buckets(df, "c", "t", "i", 4.0, 0.2, ttl_s=60.0).collect()}
    assert got == want and len(got) == 300 and set(got.values()) == {True, False}


def test_idle_buckets_are_cleared(spark, tmp_path):
    df = spark.createDataFrame([("old", 0.0, 1), ("new", 1000.0, 2), ("new", 1001.0, 3)], "c string, t double, i int").withColumn("t", F.timestamp_seconds("t"))
    for i in (1, 2, 3):
        df.where(F.col("i") == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    arriving = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    drained(limiter.token_buckets(arriving, "c", "t", "i", 2.0, 0.1, 60.0), f"{tmp_path}/out", f"{tmp_path}/ck")
    state = spark.read.format("statestore").option("stateVarName", "bucket").load(f"{tmp_path}/ck")
    assert [r.key.c for r in state.select("key").collect()] == ["new"]


def test_a_client_takes_one_row_and_few_calls(monkeypatch):
    """What a batch's client costs besides its requests: four calls to the state store and a row for the result."""
    from datetime import UTC, datetime
    from unittest.mock import MagicMock

    from pyspark.sql import Row

    handle = MagicMock()
    bucket = handle.getValueState.return_value
    bucket.get.return_value = (1.5, 1000.0)
    p = limiter.Buckets("c", "t", "i", 2.0, 0.5, 60.0)
    p.init(handle)
    rows = [Row(c="a", t=datetime.fromtimestamp(1000 + s, UTC), i=n) for n, s in enumerate([3, 1, 2, 2])]
    out = [tuple(r) for r in p.handleInputRows(("a",), iter(rows), None)]
    assert out == [("a", [1, 2, 3, 0], [True, True, False, True])]
    assert [c[0] for c in bucket.method_calls] == ["get", "update"] and bucket.update.call_args[0][0][1] == 1003.0
    assert [c.args for c in handle.deleteTimer.mock_calls + handle.registerTimer.mock_calls] == [(1_060_000,), (1_063_000,)] and not handle.listTimers.called
    monkeypatch.setattr(limiter, "PACK", 3)
    assert [len(r[1]) for r in p.handleInputRows(("a",), iter(rows), None)] == [3, 1]
