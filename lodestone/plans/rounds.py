"""Queries over ``events`` as uploads of federated rounds: client = user, cluster = user % 4, round = day."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import rounds as R
from lodestone.plans.registry import query
from lodestone.sources.scratch import scratch_path
from lodestone.sources.tables import load
from lodestone.streaming import limiter
from lodestone.streaming.state import drained

START = "2024-01-01"
UP = """up AS (SELECT event_id, ts, user_id AS client_id, user_id % 4 AS cluster_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS round_id,
    CAST(floor(value) AS BIGINT) - 3 AS num_examples, event_type, value FROM events)"""


def uploads(spark, d):
    day = F.date_diff(F.to_date("ts"), F.to_date(F.lit(START)))
    return load(spark, d, "events").select(
        "event_id", "ts", F.col("user_id").alias("client_id"), (F.col("user_id") % 4).alias("cluster_id"), day.alias("round_id"), (F.floor("value") - 3).alias("num_examples"), "event_type", "value"
    )


@query(f"""WITH {UP}, l AS (SELECT * FROM up QUALIFY row_number() OVER (PARTITION BY cluster_id, round_id, client_id ORDER BY ts DESC, event_id DESC) = 1),
    o AS (SELECT *, (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY cluster_id, round_id))) / 1e6::DOUBLE AS dur FROM l),
    m AS (SELECT cluster_id, count(DISTINCT client_id) AS e FROM up GROUP BY 1),
    r AS (SELECT o.*, e, CASE WHEN num_examples <= 0 THEN 'no_examples' WHEN dur > 72000 THEN 'timeout' END AS reason FROM o JOIN m USING (cluster_id)),
    a AS (SELECT cluster_id, round_id, count(*) AS arrived, count(*) FILTER (reason IS NULL) AS accepted, count(*) FILTER (reason = 'no_examples') AS no_examples, count(*) FILTER (reason = 'timeout') AS timeout,
          coalesce(sum(num_examples::DOUBLE) FILTER (reason IS NULL), 0.0) AS weight, greatest(2, CAST(ceil(greatest(max(e), count(*)) * 0.5::DOUBLE) AS INT)) AS required FROM r GROUP BY 1, 2)
    SELECT *, accepted > 0 AND accepted >= required AS quorum_met FROM a""")
def straggler_quorum(spark, d):
    up = uploads(spark, d)
    members = up.groupBy("cluster_id").agg(F.countDistinct("client_id").alias("expected"))
    latest = R.last_write(up, ["cluster_id", "round_id", "client_id"], ["ts", "event_id"])
    timed = R.arrival_offsets(latest, ["cluster_id", "round_id"], "ts").join(members, "cluster_id")
    return R.quorum(timed, ["cluster_id", "round_id"], F.col("expected"), 72_000.0, 2, 0.5)


@query(f"""WITH {UP}, c AS (SELECT *, coalesce(sum((event_id % 97 = 0)::INT) OVER (PARTITION BY cluster_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS current_round FROM up),
    j AS (SELECT *, current_round - (event_id % 10 = 0)::INT AS claimed, CASE WHEN client_id % 13 = 0 THEN 0 END AS owner, CASE WHEN event_id % 17 = 0 THEN 1 END AS base FROM c WHERE event_id % 97 <> 0),
    s AS (SELECT *, CASE WHEN owner IS NOT NULL AND owner <> cluster_id THEN 403 WHEN base IS NOT NULL AND base <> cluster_id THEN 409 WHEN claimed <> current_round THEN 409 WHEN num_examples < 0 THEN 422 ELSE 201 END AS status FROM j)
    SELECT cluster_id, CAST(current_round AS BIGINT) AS current_round, count(*) AS n_uploads, count(*) FILTER (status = 201) AS accepted, count(*) FILTER (status = 403) AS forbidden, count(*) FILTER (status = 409) AS stale,
           count(*) FILTER (status = 422) AS invalid, count(DISTINCT client_id) FILTER (status = 201) AS buffered FROM s GROUP BY 1, 2""")
def late_uploads(spark, d):
    """A control event of the cluster (every 97th) closes its round; every tenth upload claims the round before."""
    fires = F.col("event_id") % 97 == 0
    c = R.current_rounds(uploads(spark, d), "cluster_id", ["ts", "event_id"], fires).where(~fires)
    claimed = F.col("current_round") - (F.col("event_id") % 10 == 0).cast("int")
    owner, base = F.when(F.col("client_id") % 13 == 0, 0), F.when(F.col("event_id") % 17 == 0, 1)
    s = c.withColumn("status", R.admission(owner, F.col("cluster_id"), base, claimed, F.col("current_round"), F.col("num_examples") >= 0))
    ok = F.col("status") == 201
    return s.groupBy("cluster_id", "current_round").agg(
        F.count("*").alias("n_uploads"), F.count_if(ok).alias("accepted"), F.count_if(F.col("status") == 403).alias("forbidden"), F.count_if(F.col("status") == 409).alias("stale"),
        F.count_if(F.col("status") == 422).alias("invalid"), F.countDistinct(F.when(ok, F.col("client_id"))).alias("buffered"),
    )


@query(f"""WITH {UP}, e AS (SELECT cluster_id, round_id, CASE WHEN event_id % 400 <> 0 THEN value / 100 END AS eps FROM up), m AS (SELECT cluster_id, round_id, CASE WHEN count(*) = count(eps) THEN max(eps) END AS epsilon FROM e GROUP BY 1, 2)
    SELECT cluster_id, round_id, round_even(epsilon, 9) AS epsilon, round_even(CASE WHEN count(*) OVER w = count(epsilon) OVER w THEN sum(epsilon) OVER w END, 9) AS cumulative_epsilon FROM m WINDOW w AS (PARTITION BY cluster_id ORDER BY round_id)""")
def epsilon_max_null(spark, d):
    e = uploads(spark, d).withColumn("eps", F.when(F.col("event_id") % 400 != 0, F.col("value") / 100))
    m = e.groupBy("cluster_id", "round_id").agg(R.max_or_null("eps").alias("epsilon"))
    w = Window.partitionBy("cluster_id").orderBy("round_id")
    return m.select("cluster_id", "round_id", F.bround("epsilon", 9).alias("epsilon"), F.bround(R.running_sum_or_null("epsilon", w), 9).alias("cumulative_epsilon"))


ROUND = f"""{UP}, s AS (SELECT cluster_id, round_id, CASE WHEN count(*) FILTER (event_type = 'purchase') >= 5 THEN round_even(avg(value) FILTER (event_type = 'purchase') / 100, 6) END AS sim FROM up GROUP BY 1, 2)"""


def similarity_by_round(spark, d):
    buys = F.col("event_type") == "purchase"
    return uploads(spark, d).groupBy("cluster_id", "round_id").agg(F.when(F.count_if(buys) >= 5, F.bround(F.avg(F.when(buys, F.col("value"))) / 100, 6)).alias("sim"))


@query(f"""WITH {ROUND}, p AS (SELECT *, last_value(sim IGNORE NULLS) OVER (PARTITION BY cluster_id ORDER BY round_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s)
    SELECT cluster_id, round_id, before, sim AS current, sim < before AS dropped FROM p WHERE sim IS NOT NULL AND before IS NOT NULL""")
def round_over_round(spark, d):
    s = similarity_by_round(spark, d).withColumn("before", R.previous_measured("sim", "cluster_id", "round_id"))
    return s.where("sim IS NOT NULL AND before IS NOT NULL").select("cluster_id", "round_id", "before", F.col("sim").alias("current"), (F.col("sim") < F.col("before")).alias("dropped"))


@query(f"""WITH {UP}, c AS (SELECT round_id, client_id, round_even(avg(value), 6) AS ppl FROM up GROUP BY 1, 2), r AS (SELECT *, dense_rank() OVER (ORDER BY round_id) AS i FROM (SELECT DISTINCT round_id FROM c)),
    x AS (SELECT c.*, i FROM c JOIN r USING (round_id))
    SELECT a.round_id AS from_round, b.round_id AS to_round, count(*) AS n_clients, count(*) FILTER (b.ppl < a.ppl) AS n_better, round_even(avg(b.ppl - a.ppl), 4) AS mean_change FROM x a JOIN x b ON a.client_id = b.client_id AND b.i = a.i + 1 GROUP BY 1, 2""")
def compare_rounds(spark, d):
    c = uploads(spark, d).groupBy("round_id", "client_id").agg(F.bround(F.avg("value"), 6).alias("ppl"))
    index = c.select("round_id").distinct().withColumn("i", F.dense_rank().over(Window.orderBy("round_id")))  # one row a round
    x = c.join(index, "round_id")
    b = x.select("client_id", (F.col("i") - 1).alias("i"), F.col("round_id").alias("to_round"), F.col("ppl").alias("after"))
    return x.join(b, ["client_id", "i"]).groupBy(F.col("round_id").alias("from_round"), "to_round").agg(
        F.count("*").alias("n_clients"), F.count_if(F.col("after") < F.col("ppl")).alias("n_better"), F.bround(F.avg(F.col("after") - F.col("ppl")), 4).alias("mean_change")
    )


DECIDE = f"""{ROUND}, g AS (SELECT cluster_id, round_id, avg((event_type <> 'error')::INT::DOUBLE) AS cand, CASE WHEN round_id % 6 <> 0 THEN 0.8::DOUBLE END AS base FROM up GROUP BY 1, 2),
    v AS (SELECT s.*, round_even(sim - 0.2::DOUBLE, 6) AS delta, cand, base FROM s JOIN g USING (cluster_id, round_id)),
    k AS (SELECT *, CASE WHEN delta IS NULL THEN 'in_project_unmeasured' WHEN delta <= 0.01 THEN 'in_project_not_improved' END AS k1, CASE WHEN base IS NULL THEN 'guard_unavailable' WHEN base - cand > 0.02 THEN 'guard_regression' END AS k2 FROM v)"""


def decisions(spark, d):
    g = uploads(spark, d).groupBy("cluster_id", "round_id").agg(F.avg((F.col("event_type") != "error").cast("double")).alias("cand")).withColumn("base", F.when(F.col("round_id") % 6 != 0, 0.8))
    v = similarity_by_round(spark, d).join(g, ["cluster_id", "round_id"]).withColumn("delta", F.bround(F.col("sim") - 0.2, 6))
    return v.withColumn("reasons", R.promotion_reasons(F.col("delta"), F.lit(0.01), F.col("base"), F.col("cand"), 0.02))


@query(f"""WITH {DECIDE}, a AS (SELECT *, CASE WHEN k1 IS NULL AND k2 IS NULL THEN 'promote' ELSE 'rollback' END AS predicted, CASE WHEN round_id % 5 = 0 THEN 'rollback' WHEN k1 IS NULL AND k2 IS NULL THEN 'promote' ELSE 'rollback' END AS actual FROM k)
    SELECT cluster_id, round_id, kind FROM (SELECT cluster_id, round_id, k1 AS kind FROM a UNION ALL SELECT cluster_id, round_id, k2 FROM a UNION ALL SELECT cluster_id, round_id, CASE WHEN predicted <> actual THEN 'decision_mismatch' END FROM a) WHERE kind IS NOT NULL""")
def d5_decision_alerts(spark, d):
    predicted = F.when(F.size("reasons") == 0, "promote").otherwise("rollback")
    actual = F.when(F.col("round_id") % 5 == 0, "rollback").otherwise(predicted)
    extra = F.when(predicted != actual, F.array(F.lit("decision_mismatch"))).otherwise(F.array().cast("array<string>"))
    return decisions(spark, d).select("cluster_id", "round_id", F.explode(F.concat("reasons", extra)).alias("kind"))


@query(f"""WITH {DECIDE} SELECT cluster_id, round_id, CASE WHEN k1 IS NULL AND k2 IS NULL THEN 'promote' ELSE 'rollback' END AS action,
    CASE WHEN delta IS NULL THEN 'no baseline' ELSE printf('delta %.6f, band 0.0100', delta) END AS reason FROM k""")
def promotion_rule(spark, d):
    action = F.when(F.size("reasons") == 0, "promote").otherwise("rollback")
    reason = F.when(F.col("delta").isNull(), "no baseline").otherwise(F.format_string("delta %.6f, band 0.0100", "delta"))
    return decisions(spark, d).select("cluster_id", "round_id", action.alias("action"), reason.alias("reason"))


@query(f"""WITH {UP}, m AS (SELECT DISTINCT client_id, client_id % 4 AS owner FROM up WHERE client_id % 11 <> 0), x AS (SELECT client_id, CASE WHEN event_id % 50 = 0 THEN (cluster_id + 1) % 4 ELSE cluster_id END AS held FROM up)
    SELECT x.client_id, held, count(*) AS n, CASE WHEN owner IS NULL THEN 'not_a_member' ELSE 'foreign_adapter' END AS problem FROM x LEFT JOIN m USING (client_id) WHERE owner IS NULL OR owner <> held GROUP BY 1, 2, 4""")
def isolation_audit(spark, d):
    up = uploads(spark, d)
    members = up.where("client_id % 11 <> 0").select("client_id", F.col("cluster_id").alias("owner")).distinct()
    held = up.select("client_id", F.when(F.col("event_id") % 50 == 0, (F.col("cluster_id") + 1) % 4).otherwise(F.col("cluster_id")).alias("held"))
    problem = F.when(F.col("owner").isNull(), "not_a_member").otherwise("foreign_adapter")
    return held.join(members, "client_id", "left").where("owner IS NULL OR owner <> held").groupBy("client_id", "held", problem.alias("problem")).agg(F.count("*").alias("n"))


@query(f"""WITH {UP}, m AS (SELECT cluster_id, count(DISTINCT client_id) AS members, max(round_id) AS round_id FROM up GROUP BY 1),
    p AS (SELECT up.cluster_id, count(DISTINCT client_id) AS pending, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (num_examples < 0) AS malformed FROM up JOIN m ON up.cluster_id = m.cluster_id AND up.round_id = m.round_id GROUP BY 1)
    SELECT m.cluster_id, members, m.round_id, pending, failed, malformed FROM m JOIN p USING (cluster_id)""")
def cluster_status(spark, d):
    up = uploads(spark, d)
    m = up.groupBy("cluster_id").agg(F.countDistinct("client_id").alias("members"), F.max("round_id").alias("round_id"))
    p = up.join(m, ["cluster_id", "round_id"]).groupBy("cluster_id", "round_id", "members").agg(
        F.countDistinct("client_id").alias("pending"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("num_examples") < 0).alias("malformed")
    )
    return p


@query(f"""WITH {UP}, m AS (SELECT client_id, max_by(cluster_id, event_id) AS owner FROM up WHERE client_id % 5 <> 4 GROUP BY 1),
    q AS (SELECT event_id, client_id AS caller, event_id % 4 AS wanted FROM up)
    SELECT event_id, caller, wanted, CASE WHEN owner <> wanted THEN 403 ELSE 200 END AS status FROM q LEFT JOIN m ON caller = client_id""")
def read_isolation(spark, d):
    """Every event asks for the adapter of a cluster. Each fifth client has no membership and may read all;
    the others may read their own cluster's only."""
    up = uploads(spark, d)
    members = up.where("client_id % 5 <> 4").groupBy("client_id").agg(F.max_by("cluster_id", "event_id").alias("cluster_id"))
    requests = up.select("event_id", F.col("client_id").alias("caller"), (F.col("event_id") % 4).alias("wanted"))
    return R.read_access(requests, members, "caller", "wanted")


@query(f"""WITH {UP} SELECT cluster_id, event_id, ts FROM up WHERE event_type IN ('purchase', 'error')""")
def decision_log(spark, d):
    """The log's decisions (promote and rollback, here two event types); other events are no decisions."""
    return uploads(spark, d).where(F.col("event_type").isin("purchase", "error")).select("cluster_id", "event_id", "ts")


@query(f"""WITH {UP}, b AS (SELECT cluster_id, max(value) AS v FROM up WHERE cluster_id <> 3 GROUP BY 1), n AS (SELECT client_id, cluster_id, round_id, max_by(value, event_id) FILTER (event_type = 'purchase') AS live, max_by(value, event_id) AS newest FROM up GROUP BY 1, 2, 3),
    l AS (SELECT client_id, cluster_id, max_by(coalesce(live, newest), round_id) AS evidence FROM n GROUP BY 1, 2)
    SELECT client_id, evidence, round_even(coalesce(b.v, (SELECT max(v) FROM b), 0), 4) AS band FROM l LEFT JOIN b USING (cluster_id)""")
def evidence_fallback(spark, d):
    up = uploads(spark, d)
    bands = up.where("cluster_id <> 3").groupBy("cluster_id").agg(F.max("value").alias("v"))
    overall = bands.agg(F.max("v").alias("any"))
    n = up.groupBy("client_id", "cluster_id", "round_id").agg(F.max_by(F.when(F.col("event_type") == "purchase", F.col("value")), F.when(F.col("event_type") == "purchase", F.col("event_id"))).alias("live"), F.max_by("value", "event_id").alias("newest"))
    latest = n.groupBy("client_id", "cluster_id").agg(F.max_by(F.coalesce("live", "newest"), "round_id").alias("evidence"))
    return latest.join(bands, "cluster_id", "left").join(F.broadcast(overall)).select("client_id", "evidence", F.bround(F.coalesce("v", "any", F.lit(0.0)), 4).alias("band"))


@query(f"""WITH {UP}, g AS (SELECT unnest([0.0::DOUBLE, 0.25::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE]) AS alpha, unnest([0, 1, 2, 3]) AS pos), c AS (SELECT client_id, round_even(avg(value), 4) AS base, round_even(avg(value) FILTER (event_type = 'view'), 4) AS other FROM up GROUP BY 1),
    x AS (SELECT client_id, alpha, pos, round_even((other - base) * alpha + 10 * alpha * alpha, 6) AS delta FROM c, g WHERE other IS NOT NULL)
    SELECT client_id, alpha AS best_alpha, delta FROM x QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY delta, pos) = 1""")
def best_alpha(spark, d):
    grid = F.array(*(F.struct(F.lit(a).alias("alpha"), F.lit(i).alias("pos")) for i, a in enumerate([0.0, 0.25, 0.5, 1.0])))
    c = uploads(spark, d).groupBy("client_id").agg(F.bround(F.avg("value"), 4).alias("base"), F.bround(F.avg(F.when(F.col("event_type") == "view", F.col("value"))), 4).alias("other")).where("other IS NOT NULL")
    x = c.select("client_id", "base", "other", F.explode(grid).alias("g")).select("client_id", "g.*", F.bround((F.col("other") - F.col("base")) * F.col("g.alpha") + 10 * F.col("g.alpha") * F.col("g.alpha"), 6).alias("delta"))
    best = x.groupBy("client_id").agg(F.min_by(F.struct("alpha", "delta"), F.struct("delta", "pos")).alias("b"))
    return best.select("client_id", F.col("b.alpha").alias("best_alpha"), F.col("b.delta").alias("delta"))


@query(f"""WITH {UP} SELECT round_id, round_even(avg(value) FILTER (cluster_id = 0), 6) AS c0, round_even(avg(value) FILTER (cluster_id = 1), 6) AS c1, round_even(avg(value) FILTER (cluster_id = 2), 6) AS c2, round_even(avg(value) FILTER (cluster_id = 3), 6) AS c3 FROM up GROUP BY 1""")
def feed_pivot(spark, d):
    wide = uploads(spark, d).groupBy("round_id").pivot("cluster_id", [0, 1, 2, 3]).agg(F.avg("value"))
    return wide.select("round_id", *(F.bround(str(i), 6).alias(f"c{i}") for i in range(4)))


@query(f"""WITH {UP}, k AS (SELECT client_id % 20 AS run_id, event_type AS benchmark, value, event_id FROM up), f AS (SELECT run_id, benchmark, min(event_id) AS first_seen, max_by(value, event_id) AS value FROM k GROUP BY 1, 2)
    SELECT run_id, benchmark, value, row_number() OVER (PARTITION BY run_id ORDER BY first_seen) AS position FROM f""")
def upsert_results(spark, d):
    k = uploads(spark, d).select((F.col("client_id") % 20).alias("run_id"), F.col("event_type").alias("benchmark"), "value", "event_id")
    return R.keyed_upserts(k, "run_id", "benchmark", "event_id").drop("event_id")


@query(f"""WITH {UP} SELECT event_type, value >= 10 AS success, count(*) AS n FROM up GROUP BY GROUPING SETS ((event_type, value >= 10), (event_type), ())""")
def audit_rollup(spark, d):
    return uploads(spark, d).withColumn("success", F.col("value") >= 10).rollup("event_type", "success").agg(F.count("*").alias("n"))


@query("""SELECT event_id, CAST(props->>'$.k' AS INT) AS k, coalesce(CAST(props->>'$.missing' AS INT), -1) AS missing FROM events""")
def json_props_scan(spark, d):
    """JSON with a fixed schema; what is absent gets its default."""
    p = F.from_json("props", "k INT, missing INT", {"mode": "FAILFAST"})
    return load(spark, d, "events").withColumn("p", p).select("event_id", "p.k", F.coalesce("p.missing", F.lit(-1)).alias("missing"))


@query(f"""WITH {UP}, c AS (SELECT round_id, client_id, round_even(avg(value) FILTER (event_type = 'view'), 4) AS composite, round_even(avg(value), 4) AS base FROM up GROUP BY 1, 2), x AS (SELECT *, round_even(composite - base, 4) AS delta FROM c WHERE composite IS NOT NULL)
    SELECT round_id, count(*) AS n_clients, count(*) FILTER (composite < base) AS n_improved, count(*) FILTER (delta < -0.5) AS n_improved_band, round_even(avg(delta), 4) AS mean_delta, min(delta) AS min_delta, max(delta) AS max_delta,
           CASE WHEN bool_and(delta < 0) THEN 'all' WHEN bool_or(delta < 0) THEN 'partial' ELSE 'none' END AS status FROM x GROUP BY 1""")
def personalization_summary(spark, d):
    v = F.col("value")
    c = uploads(spark, d).groupBy("round_id", "client_id").agg(F.bround(F.avg(F.when(F.col("event_type") == "view", v)), 4).alias("composite"), F.bround(F.avg(v), 4).alias("base")).where("composite IS NOT NULL")
    x = c.withColumn("delta", F.bround(F.col("composite") - F.col("base"), 4))
    helps = F.col("delta") < 0
    return x.groupBy("round_id").agg(
        F.count("*").alias("n_clients"), F.count_if(F.col("composite") < F.col("base")).alias("n_improved"), F.count_if(F.col("delta") < -0.5).alias("n_improved_band"), F.bround(F.avg("delta"), 4).alias("mean_delta"),
        F.min("delta").alias("min_delta"), F.max("delta").alias("max_delta"), F.when(F.bool_and(helps), "all").when(F.bool_or(helps), "partial").otherwise("none").alias("status"),
    )


@query(f"""WITH {UP}, b AS (SELECT client_id, max(ts) AS last_fill FROM up GROUP BY 1) SELECT client_id, last_fill FROM b ORDER BY last_fill, client_id LIMIT 10""")
def oldest_k(spark, d):
    """The ten longest idle clients; the limit is the feature."""
    return uploads(spark, d).groupBy("client_id").agg(F.max("ts").alias("last_fill")).orderBy("last_fill", "client_id").limit(10)


BUCKETS = """WITH RECURSIVE r AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    b AS (SELECT user_id, event_id, us, i, 3.0::DOUBLE AS t FROM r WHERE i = 1 UNION ALL
          SELECT r.user_id, r.event_id, r.us, r.i, CASE WHEN r.us - b.us >= 7200000000 THEN 3.0::DOUBLE ELSE least(3.0::DOUBLE, CASE WHEN b.t >= 1 THEN b.t - 1 ELSE b.t END + ((r.us / 1e6::DOUBLE) - (b.us / 1e6::DOUBLE)) * (1 / 7200.0::DOUBLE)) END
          FROM b JOIN r ON r.user_id = b.user_id AND r.i = b.i + 1)
    SELECT user_id, event_id, t >= 1 AS allowed FROM b"""


@query(BUCKETS)
def token_bucket(spark, d):
    """Three requests at once and one every two hours; a bucket idle for two hours is dropped and starts full."""
    return R.token_buckets(load(spark, d, "events"), "user_id", "ts", "event_id", 3.0, 1 / 7200, ttl_s=7200.0)


@query(BUCKETS)
def stream_token_bucket(spark, d):
    """The same from a stream over the stored events, stopped after the first half of the time and taken up again."""
    events = load(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    half = events.agg(F.percentile_approx("ts", 0.5)).first()[0]
    root = scratch_path(spark, "limiter")
    for part in (F.col("ts") < half, F.col("ts") >= half):
        events.where(part).write.mode("append").parquet(f"{root}/in")
        arriving = spark.readStream.schema(events.schema).parquet(f"{root}/in")
        drained(limiter.token_buckets(arriving, "user_id", "ts", "event_id", 3.0, 1 / 7200, ttl_s=7200.0), f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out")


@query(f"""WITH {UP}, m AS (SELECT cluster_id, round_id, max(value) / 100 AS epsilon FROM up GROUP BY 1, 2), c AS (SELECT *, sum(epsilon) OVER (PARTITION BY cluster_id ORDER BY round_id) AS spent FROM m)
    SELECT cluster_id, count(*) FILTER (spent <= 8) AS rounds_within, round_even(coalesce(max(spent) FILTER (spent <= 8), 0), 6) AS spent, min(round_id) FILTER (spent > 8) AS stops_at FROM c GROUP BY 1""")
def privacy_budget_stop(spark, d):
    """How many rounds a cluster's privacy budget of 8 allows, and the round it stops at."""
    m = uploads(spark, d).groupBy("cluster_id", "round_id").agg((F.max("value") / 100).alias("epsilon"))
    return R.budget_stop(m, "cluster_id", "round_id", "epsilon", 8.0)
