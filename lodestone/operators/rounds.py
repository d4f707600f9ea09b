"""Round protocol over event tables: admission, stragglers, quorum, epsilon, feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.ordering import previous, running


def last_write(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows of a key the last in ``order``; an aggregation, so a hot key combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def keyed_upserts(rows: DataFrame, by: str, key: str, seq: str) -> DataFrame:
    """The last row of every (``by``, ``key``) with ``position``, the place (from 1) at which the key first came (W16). A
    window holds the keys of one ``by``, not their rows."""
    rest = [c for c in rows.columns if c not in (by, key)]
    last = rows.groupBy(by, key).agg(F.min(seq).alias("_first"), F.max_by(F.struct(*rest), seq).alias("_r"))
    return last.select(by, key, "_r.*", F.row_number().over(Window.partitionBy(by).orderBy("_first", key)).alias("position"))


def arrival_offsets(uploads: DataFrame, by: list[str], ts: str) -> DataFrame:
    """Seconds since the first arrival of the round."""
    first = uploads.groupBy(*by).agg(F.min(ts).alias("_first"))
    seconds = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_first").cast("timestamp"))) / 1e6
    return uploads.join(first, by).withColumn("duration_s", seconds).drop("_first")


def straggler_reasons(n: Column, duration: Column, timeout_s: float | None) -> Column:
    """Why an update is left out; a missing duration is never late."""
    reason = F.when(n <= 0, "no_examples")
    return reason if timeout_s is None else reason.when(duration > timeout_s, "timeout")


def quorum(updates: DataFrame, by: list[str], expected: Column, timeout_s: float, min_clients: int, min_fraction: float, weighting: str = "samples") -> DataFrame:
    """A row for each round: arrived, accepted, skipped by reason, weight, required and whether the quorum is met.

    ``expected`` never counts below what arrived.
    """
    r = updates.withColumn("_reason", straggler_reasons(F.col("num_examples"), F.col("duration_s"), timeout_s))
    weight = F.col("num_examples").cast("double") if weighting == "samples" else F.lit(1.0)
    ok = F.col("_reason").isNull()
    per = r.groupBy(*by).agg(
        F.count("*").alias("arrived"), F.count_if(ok).alias("accepted"), F.count_if(F.col("_reason") == "no_examples").alias("no_examples"), F.count_if(F.col("_reason") == "timeout").alias("timeout"),
        F.coalesce(F.sum(F.when(ok, weight)), F.lit(0.0)).alias("weight"), F.max(expected).alias("_e"),
    )
    per = per.withColumn("required", F.greatest(F.lit(min_clients), F.ceil(F.greatest("_e", "arrived") * F.lit(min_fraction)).cast("int")))
    return per.withColumn("quorum_met", (F.col("accepted") > 0) & (F.col("accepted") >= F.col("required"))).drop("_e")


def current_rounds(events: DataFrame, cluster: str, order: list[str], fires: Column, span_s: int = 3600) -> DataFrame:
    """``current_round`` of each event: how many rounds of its cluster were closed before it.

    ``order`` starts with a time; events are counted in ranges of ``span_s`` seconds, so the few
    clusters there are don't bound the number of tasks.
    """
    at = F.floor(F.unix_micros(F.col(order[0]).cast("timestamp")) / (span_s * 1_000_000))
    return running(events, [cluster], order, at, fires.cast("int"), at="current_round").drop("_n")


def read_access(requests: DataFrame, members: DataFrame, caller: str, wanted: str) -> DataFrame:
    """``requests`` with ``status``: 403 if the caller is a member of another cluster than it wants to read,
    else 200. Callers without a membership, and unknown ones, aren't restricted.

    ``members``: client_id, cluster_id, one row a client.
    """
    m = members.select(F.col("client_id").alias("_who"), F.col("cluster_id").alias("_owner"))
    met = requests.join(m, F.col(caller) == F.col("_who"), "left")
    return met.withColumn("status", F.when(F.col("_owner") != F.col(wanted), 403).otherwise(200)).drop("_who", "_owner")


def admission(owner: Column, cluster: Column, base: Column, claimed: Column, current: Column, valid: Column) -> Column:
    """The first rule that refuses an upload, as its code; 201 if none does."""
    return (
        F.when(owner.isNotNull() & (owner != cluster), 403).when(base.isNotNull() & (base != cluster), 409).when(claimed != current, 409).when(~valid, 422).otherwise(201)
    )


def max_or_null(value: str) -> Column:
    """The greatest value, but null if any is null or there is none."""
    return F.when((F.count("*") > 0) & (F.count("*") == F.count(value)), F.max(value))


def running_sum_or_null(value: str, w) -> Column:
    return F.when(F.count("*").over(w) == F.count(value).over(w), F.sum(value).over(w))


def budget_stop(rounds: DataFrame, by: str, order: str, spend: str, budget: float) -> DataFrame:
    """A row a key: rounds within the budget, what they spend, and the first round beyond it (null: none).
    ``rounds`` has one row a round, so a window holds a key's rounds only."""
    spent = rounds.withColumn("_spent", F.sum(spend).over(Window.partitionBy(by).orderBy(order)))
    ok = F.col("_spent") <= budget
    return spent.groupBy(by).agg(F.count_if(ok).alias("rounds_within"), F.bround(F.coalesce(F.max(F.when(ok, F.col("_spent"))), F.lit(0.0)), 6).alias("spent"), F.min(F.when(~ok, F.col(order))).alias("stops_at"))


def previous_measured(value: str, by: str, order: str) -> Column:
    """The last value before this row that isn't null."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(value, ignorenulls=True).over(w)


def promotion_reasons(delta: Column, band: Column, base_guard: Column, cand_guard: Column, tolerance: float) -> Column:
    """What speaks against a promotion; an empty array means promote. Compared on raw doubles."""
    return F.array_compact(
        F.array(
            F.when(delta.isNull(), "in_project_unmeasured").when(delta <= band, "in_project_not_improved"),
            F.when(base_guard.isNull() | cand_guard.isNull(), "guard_unavailable").when(base_guard - cand_guard > tolerance, "guard_regression"),
        )
    )


def token_buckets(requests: DataFrame, client: str, ts: str, order: str, capacity: float, rate: float, ttl_s: float | None = None, span_s: int = 86_400) -> DataFrame:
    """``allowed`` for each request of a client, by a token bucket that starts full.

    A bucket that is idle for capacity / rate seconds is full again, and one that is idle for ``ttl_s``
    is dropped and starts anew, full. So a client's requests fall into runs, cut at such pauses, that
    don't depend on each other; runs, not clients, are dealt to tasks, which walk them in order. Pauses are found
    and runs numbered in ranges of ``span_s`` seconds, so a client's requests aren't gathered for that either.
    """
    cols = requests.select(client, ts, order)
    pause = min(capacity / rate, ttl_s if ttl_s is not None else float("inf")) * 1e6

    def run(pdfs):
        who, tokens, last = None, capacity, 0.0
        for pdf in pdfs:
            out = []
            for c, k, now in zip(pdf[client], pdf["_run"], pdf[ts].to_numpy() / 1e6, strict=True):
                tokens = min(capacity, tokens + (now - last) * rate) if (c, k) == who else capacity
                who, last = (c, k), now
                out.append(tokens >= 1)
                tokens -= tokens >= 1
            yield pdf.assign(allowed=out)[[client, order, "allowed"]]

    micros = cols.withColumn(ts, F.unix_micros(F.col(ts).cast("timestamp")))
    span = F.floor(F.col(ts) / (span_s * 1_000_000))
    looked = previous(micros, [client], [ts, order], span, ts, "_before")
    fresh = F.coalesce((F.col(ts) - F.col("_before") >= pause).cast("int"), F.lit(0))
    marked = looked.withColumn("_fresh", fresh)
    runs = running(marked, [client], [ts, order], span, F.col("_fresh")).withColumn("_run", F.col("_at") + F.col("_fresh"))
    kinds = {f.name: f.dataType.simpleString() for f in cols.schema}
    dealt = runs.repartition(client, "_run").sortWithinPartitions(client, "_run", ts, order)
    return dealt.mapInPandas(run, f"`{client}` {kinds[client]}, `{order}` {kinds[order]}, allowed boolean")
