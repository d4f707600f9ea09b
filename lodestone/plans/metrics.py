"""Queries for evaluation statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import bootstrap as B
from lodestone.operators import scoring as S
from lodestone.plans.registry import query
from lodestone.sources.tables import load

Z = "1.959963984540054::DOUBLE"


@query("""WITH p AS (SELECT p_partkey, lower(p_name) AS a, lower(p_type) AS b FROM part)
    SELECT p_partkey, CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0 ELSE round_even(1.0::DOUBLE - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE, 9) END AS edit_similarity, a = b AS exact_match FROM p""")
def edit_similarity(spark, d):
    p = load(spark, d, "part").select("p_partkey", X.strip(F.lower("p_name")).alias("a"), X.strip(F.lower("p_type")).alias("b"))
    return p.select("p_partkey", F.bround(X.edit_similarity(F.col("a"), F.col("b")), 9).alias("edit_similarity"), (F.col("a") == F.col("b")).alias("exact_match"))


@query("""WITH p AS (SELECT lower(p_name) AS a, lower(p_type) AS b FROM part)
    SELECT round_even(avg(1.0::DOUBLE - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE), 6) AS edit_similarity, avg((a = b)::INT) AS exact_match, count(*) AS n_examples FROM p""")
def completion_score(spark, d):
    rows = edit_similarity(spark, d)
    return rows.agg(F.bround(F.avg("edit_similarity"), 6).alias("edit_similarity"), F.avg(F.col("exact_match").cast("int")).alias("exact_match"), F.count("*").alias("n_examples"))


@query("""WITH m AS (SELECT conv_id, turn, text, list_min(list_filter([strpos(text, chr(10)), strpos(text, '. '), strpos(text, '?')], lambda x: x > 0)) AS cut FROM conversations)
    SELECT conv_id, turn, CASE WHEN cut IS NULL THEN text ELSE left(text, CAST(cut AS INT) - 1) END AS stopped, split_part(text, chr(10), 1) AS first_line,
           CASE WHEN length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) <= 40 THEN trim(regexp_replace(text, '\\s+', ' ', 'g')) ELSE left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 39) || '…' END AS short FROM m""")
def stop_truncate(spark, d):
    t = F.col("text")
    return load(spark, d, "conversations").select("conv_id", "turn", X.before_first(t, "\n", ". ", "?").alias("stopped"), X.first_line(t).alias("first_line"), X.truncated(t, 40).alias("short"))


@query("""WITH t AS (SELECT user_id, count(*)::DOUBLE AS n, (count(*) FILTER (event_type <> 'error'))::DOUBLE AS c FROM events GROUP BY 1), k AS (SELECT unnest([1, 5, 10, 70]) AS k),
    p AS (SELECT k, CASE WHEN k <= n THEN 1.0 - list_product(list_transform(range(0, k), lambda i: greatest(n - c - i, 0) / (n - i))) END AS p FROM t, k)
    SELECT k, round_even(coalesce(avg(p), 0.0), 9) AS pass_at_k, count(p) AS tasks_included, count(*) - count(p) AS tasks_skipped FROM p GROUP BY k""")
def pass_at_k(spark, d):
    tasks = load(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") != "error").alias("c"))
    return S.mean_pass_at_k(tasks, [1, 5, 10, 70])


@query(f"""WITH x AS (SELECT count(*) AS n, sum((quality <> toxic)::INT) AS d, sum(quality) AS b, sum(toxic) AS c FROM labels)
    SELECT n AS n_shared_tasks, d::BIGINT AS discordant_tasks, round_even(d / n::DOUBLE, 4) AS measured_discordance, round_even((b - c) / n::DOUBLE, 4) AS pass_at_1_drop, round_even({Z} * sqrt(d / n::DOUBLE / n), 4) AS noise_floor,
           CASE WHEN (b - c) / n::DOUBLE <= 0.02 THEN 'pass' WHEN (b - c) / n::DOUBLE <= {Z} * sqrt(d / n::DOUBLE / n) THEN 'within_noise' ELSE 'regression' END AS verdict FROM x""")
def paired_guard(spark, d):
    labels = load(spark, d, "labels")
    return S.paired_guard(labels.select("doc_id", F.col("quality").alias("passed")), labels.select("doc_id", F.col("toxic").alias("passed")), "doc_id", 0.02)


@query("""WITH r AS (SELECT user_id, CAST(ts AS DATE) AS day, avg(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1, 2)
    SELECT user_id, count(*) AS n_repeats, CASE WHEN count(*) < 2 THEN 0.0 ELSE round_even(max(v) - min(v), 6) END AS band, CASE WHEN count(*) < 2 THEN 'placeholder' ELSE 'measured' END AS note FROM r GROUP BY 1""")
def noise_band(spark, d):
    daily = load(spark, d, "events").where("event_type = 'click'").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    return S.noise_bands(daily, "user_id", "v")


@query(f"""WITH x AS (SELECT count(*) AS n, avg(quality::DOUBLE) AS p FROM labels), g AS (SELECT unnest([0.05::DOUBLE, 0.1::DOUBLE, 0.2::DOUBLE]) AS d)
    SELECT n AS n_tasks, round_even(p, 4) AS pass_at_1, round_even(sqrt(p * (1 - p) / n), 4) AS standard_error, round_even({Z} * sqrt(2.0::DOUBLE) * sqrt(p * (1 - p) / n), 4) AS unpaired_floor, d AS discordance,
           round_even({Z} * sqrt(d / n), 4) AS paired_floor, round_even({Z} * sqrt(d / 164), 4) AS paired_floor_full, CAST(ceil({Z} * {Z} * d / (0.02::DOUBLE * 0.02::DOUBLE)) AS BIGINT) AS items_needed FROM x, g""")
def guard_noise_report(spark, d):
    return S.guard_noise(load(spark, d, "labels"), "quality", 0.02, 164, [0.05, 0.1, 0.2])


NORMAL = """abs(lo - (mean - 1.96 * se)) <= 0.4 * se AND abs(hi - (mean + 1.96 * se)) <= 0.4 * se"""


def against_normal(intervals, deviations):
    """Whether both bounds lie within 0.4 standard errors of the normal interval, which they come near to for large groups."""
    met = intervals.join(deviations, "what").withColumn("se", F.col("sd") / F.sqrt("n"))
    return met.select("what", "n", F.bround("mean", 6).alias("mean"), F.expr(NORMAL).alias("near_normal"))


@query("""SELECT event_type AS what, count(*) AS n, round_even(avg(value), 6) AS mean, true AS near_normal FROM events GROUP BY 1""")
def bootstrap_ci(spark, d):
    """Bootstrap intervals of the mean of each kind of event, held against the closed form."""
    v = load(spark, d, "events").select(F.col("event_type").alias("what"), "value")
    return against_normal(B.bootstrap_ci(v, "what", "value"), v.groupBy("what").agg(F.stddev_pop("value").alias("sd")))


@query("""SELECT p_partkey % 2 AS what, count(*) AS n, round_even(avg(p_retailprice / 100 - p_size), 6) AS mean, true AS near_normal FROM part GROUP BY 1""")
def paired_bootstrap_ci(spark, d):
    """The same of paired differences: two scores of every part."""
    p = load(spark, d, "part").select((F.col("p_partkey") % 2).alias("what"), F.col("p_partkey").alias("item"), F.col("p_size").cast("double").alias("b"), (F.col("p_retailprice") / 100).alias("c"))
    side = lambda c: p.select("what", "item", F.col(c).alias("score"))
    return against_normal(B.paired_bootstrap_ci(side("b"), side("c"), "what", "item", "score"), p.groupBy("what").agg(F.stddev_pop(F.col("c") - F.col("b")).alias("sd")))


def day():
    """Ranges of events: the day."""
    return F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000)


@query("""WITH s AS (SELECT user_id, value AS y, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::DOUBLE AS x, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    w AS (SELECT *, greatest(1, CAST(ceil(n * 0.2::DOUBLE) AS INT)) AS w FROM s),
    a AS (SELECT user_id, count(*) AS n_steps, any_value(w) AS window_steps, avg(y) FILTER (x < w) AS f, avg(y) FILTER (x >= n - w) AS l, coalesce(regr_slope(y, x), 0.0) AS b FROM w GROUP BY 1)
    SELECT user_id, n_steps, window_steps, round_even(f, 4) AS first_window, round_even(l, 4) AS last_window, round_even(b, 6) AS loss_slope, l < f AND b < 0 AS loss_decreased FROM a""")
def loss_curve(spark, d):
    return S.loss_curves(load(spark, d, "events"), "user_id", ["ts", "event_id"], "value", day())


@query("""SELECT event_id, user_id, round_even(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS rolling_mean FROM events""")
def rolling_loss(spark, d):
    return S.rolling_mean(load(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 10, day()).select("event_id", "user_id", F.bround("rolling_mean", 6).alias("rolling_mean"))


@query("""WITH s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, greatest(1, CAST(ceil(count(*) OVER (PARTITION BY user_id) * 0.2::DOUBLE) AS INT)) AS w FROM events),
    r AS (SELECT *, avg(value) FILTER (i <= w) OVER (PARTITION BY user_id) AS ref FROM s)
    SELECT event_id, user_id, value FROM r WHERE value > 150 OR (i > w AND value > ref * 3)""")
def diverging_steps(spark, d):
    return S.diverging(load(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 3.0, 150.0, day()).select("event_id", "user_id", "value")


@query("""WITH s AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, count(*) AS n, round_even(median(v), 6) AS median, round_even(max(v) FILTER (i = least(n - 1, CAST(floor(n * 0.95::DOUBLE) AS BIGINT))), 6) AS p95, round_even(min(v), 6) AS min, round_even(max(v), 6) AS max,
           round_even(coalesce(stddev_samp(v), 0.0), 6) AS stdev FROM s GROUP BY 1""")
def latency_stats(spark, d):
    return S.latency_stats(load(spark, d, "events"), "event_type", "value", places=6)


@query("""WITH p AS (SELECT user_id, ln(1 + value) AS loss, 1 + event_id % 50 AS n FROM events), m AS (SELECT user_id, sum(n) AS t, sum(loss * n) / greatest(sum(n), 1) AS m FROM p GROUP BY 1)
    SELECT user_id, CAST(t AS BIGINT) AS n_tokens, round_even(m, 6) AS mean_loss, round_even(exp(least(m, 20.0)), 4) AS perplexity FROM m""")
def weighted_perplexity(spark, d):
    parts = load(spark, d, "events").select("user_id", F.ln(1 + F.col("value")).alias("loss"), (1 + F.col("event_id") % 50).alias("n"))
    return S.weighted_perplexity(parts, "user_id", "loss", "n")


RUNS = """runs AS (SELECT event_id, user_id % 10 AS client, event_type AS lr, hour(ts) % 2 AS grad_accum, value, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value - 20 END AS ppl_delta, event_type <> 'error' AND value < 100 AS stable FROM events)"""


def runs(spark, d):
    v = F.col("value")
    return load(spark, d, "events").select(
        "event_id", (F.col("user_id") % 10).alias("client"), F.col("event_type").alias("lr"), (F.hour("ts") % 2).alias("grad_accum"), "value",
        F.when(F.col("event_id") % 11 != 0, v - 20).alias("ppl_delta"), ((F.col("event_type") != "error") & (v < 100)).alias("stable"),
    )


@query(f"""WITH {RUNS} SELECT client, lr, CAST(grad_accum AS INT) AS grad_accum, count(*) AS n, round_even(max(value) - min(value), 5) AS spread, min(value) = max(value) AS identical FROM runs GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def repeatability(spark, d):
    return S.repeatability(runs(spark, d), ["client", "lr", "grad_accum"], "value")


@query(f"""WITH {RUNS} SELECT client, lr, event_id, ppl_delta FROM (SELECT *, row_number() OVER (PARTITION BY client ORDER BY coalesce(ppl_delta, 0), event_id) AS i FROM runs WHERE stable) WHERE i = 1""")
def sweep_winner(spark, d):
    return S.winners(runs(spark, d), "client", "stable", "ppl_delta", "event_id", ["lr", "event_id"])


@query("""WITH s AS (SELECT p_brand, round_even(avg(0.5::DOUBLE * p_size / 50.0 + 0.3::DOUBLE * p_retailprice / 2000.0 + 0.2::DOUBLE * length(p_name) / 50.0), 4) AS score FROM part GROUP BY 1)
    SELECT p_brand, score, row_number() OVER (ORDER BY score DESC, p_brand) AS rank FROM s""")
def survey_rank(spark, d):
    weights = {"size": 0.5, "price": 0.3, "name": 0.2}
    rows = load(spark, d, "part").select("p_partkey", "p_brand", F.create_map(F.lit("size"), F.col("p_size") / 50.0, F.lit("price"), F.col("p_retailprice") / 2000.0, F.lit("name"), F.length("p_name") / 50.0).alias("criteria"))
    return S.criteria_scores(rows, "p_brand", "criteria", weights)


@query("""SELECT item_id, CAST(('0x' || left(sha256('20260616|' || item_id), 8))::BIGINT & 2147483647 AS BIGINT) AS seed FROM benchmark""")
def task_seed(spark, d):
    return load(spark, d, "benchmark").select("item_id", X.task_seed(20260616, F.col("item_id").cast("string")).alias("seed"))


@query("""SELECT page_id, length(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS n_text, contains(html, chr(0)) AS is_binary,
        'solve: ' || left(sha256('7|' || page_id), 12) AS mock, sha256(html || CASE WHEN ends_with(html, chr(10)) THEN '' ELSE chr(10) END) AS program_sha256 FROM pages""")
def text_normalise(spark, d):
    h = F.col("html")
    flat = F.trim(F.regexp_replace(F.regexp_replace(h, "<[^>]*>", " "), r"\s+", " "))
    mock = F.concat(F.lit("solve: "), F.substring(X.sha256(F.concat(F.lit("7|"), F.col("page_id").cast("string"))), 1, 12))
    program = F.concat(h, F.when(h.endswith("\n"), "").otherwise("\n"))
    return load(spark, d, "pages").select("page_id", F.length(flat).alias("n_text"), X.looks_binary(h.cast("binary")).alias("is_binary"), mock.alias("mock"), X.sha256(program).alias("program_sha256"))


@query("""WITH t AS (SELECT item_id, 'HE/' || CASE WHEN item_id % 9 = 0 THEN 'x' ELSE CAST((item_id * 37) % 101 AS VARCHAR) END AS task_id, text FROM benchmark)
    SELECT task_id, item_id, row_number() OVER (ORDER BY coalesce(TRY_CAST(split_part(task_id, '/', 2) AS INT), 1 << 30), task_id, item_id) AS pos, left(text, 20) AS head FROM t QUALIFY pos <= 15""")
def task_scan_limited(spark, d):
    """The first fifteen tasks by numeric suffix; the limit is the feature."""
    task = F.concat(F.lit("HE/"), F.when(F.col("item_id") % 9 == 0, "x").otherwise(((F.col("item_id") * 37) % 101).cast("string")))
    t = load(spark, d, "benchmark").select(task.alias("task_id"), "item_id", F.substring("text", 1, 20).alias("head"))
    suffix = F.coalesce(F.element_at(F.split("task_id", "/"), -1).try_cast("int"), F.lit(1 << 30))
    top = t.orderBy(suffix, "task_id", "item_id").limit(15)
    return top.withColumn("pos", F.row_number().over(Window.orderBy(suffix, "task_id", "item_id")))
