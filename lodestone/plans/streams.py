"""Queries over ``events`` as streams (batch form; tests hold the streams against them)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.plans.registry import query
from lodestone.sources.tables import load
from lodestone.streaming import rounds as S
from lodestone.streaming import windows as W


def control_events(spark, d):
    i = F.col("event_id")
    kind = F.when(i % 83 == 0, "restore").when(i % 29 == 0, "aggregate").when(i % 61 == 0, "peek").when(i % 53 == 0, "move").otherwise("upload")
    return load(spark, d, "events").select((F.col("user_id") % 4).alias("cluster_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", kind.alias("kind"), F.col("user_id").alias("client_id"), (i % 10 == 0).cast("long").alias("lag"), F.when(kind == "restore", F.floor("value") % 4).otherwise(F.floor("value")).alias("num_examples"))


ALIVE = "len(list_filter(u, lambda x: x.n > 0)) >= 3"
IS_MEMBER = "len(list_filter(u, lambda x: x.c = k.client)) > 0"


@query(f"""WITH RECURSIVE k AS (
        SELECT user_id % 4 AS cluster_id, event_id, user_id AS client, (event_id % 10 = 0)::INT AS lag,
               CASE WHEN event_id % 83 = 0 THEN 'restore' WHEN event_id % 29 = 0 THEN 'aggregate' WHEN event_id % 61 = 0 THEN 'peek' WHEN event_id % 53 = 0 THEN 'move' ELSE 'upload' END AS kind,
               CASE WHEN event_id % 83 = 0 THEN floor(value)::BIGINT % 4 ELSE floor(value)::BIGINT END AS n, row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) AS i FROM events
    ), s AS (
        SELECT user_id % 4 AS cluster_id, 0::BIGINT AS i, 0::BIGINT AS event_id, 0::BIGINT AS round_id, 0::BIGINT AS active, 0 AS status, []::STRUCT(c BIGINT, n BIGINT, b BIGINT)[] AS u FROM events GROUP BY 1
        UNION ALL
        SELECT cluster_id, i, event_id, CASE WHEN kind = 'aggregate' AND status = 200 THEN round_id + 1 ELSE round_id END,
               CASE WHEN kind = 'aggregate' AND status = 200 THEN round_id + 1 WHEN kind = 'restore' AND status = 200 THEN n ELSE active END, status,
               CASE WHEN status = 201 THEN list_append(list_filter(u, lambda x: x.c <> client), {{'c': client, 'n': n, 'b': active}}) WHEN status <> 200 OR kind = 'peek' THEN u
                    WHEN kind = 'move' THEN list_filter(u, lambda x: x.c <> client) WHEN kind = 'restore' THEN list_filter(u, lambda x: x.b = n) ELSE [] END
        FROM (SELECT k.*, s.round_id, s.active, s.u,
                     CASE WHEN kind = 'upload' THEN CASE WHEN lag <> 0 THEN 409 WHEN NOT ({IS_MEMBER}) AND len(u) >= 64 THEN 429 ELSE 201 END WHEN kind = 'move' THEN CASE WHEN {IS_MEMBER} THEN 200 ELSE 404 END
                          WHEN kind = 'restore' THEN CASE WHEN k.n <= s.round_id THEN 200 ELSE 404 END WHEN {ALIVE} THEN 200 ELSE 409 END AS status
              FROM s JOIN k ON s.cluster_id = k.cluster_id AND k.i = s.i + 1)
    ) SELECT cluster_id, event_id, round_id, status, len(u) AS pending FROM s WHERE i > 0""")
def stream_rounds(spark, d):
    return S.replay(control_events(spark, d))


@query("""SELECT time_bucket(INTERVAL 6 HOURS, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def window_counts(spark, d):
    out = W.windowed_counts(load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "6 hours", "1 hour")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOURS AS "end", count(*) AS n FROM s GROUP BY user_id, sid""")
def event_sessions(spark, d):
    out = W.sessions(load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["user_id"], "2 hours", "1 hour")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))
