import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import bootstrap as B
from lodestone.operators import ordering as O
from lodestone.operators import rounds as R
from lodestone.operators import scoring as S


def steps(spark, n=400, seed=1):
    r = random.Random(seed)
    rows = [(r.choice(["hot"] * 5 + ["a", None]), r.randint(0, 90), i, r.choice([None, *[float(r.randint(1, 50))] * 9])) for i in range(n)]
    return rows, spark.createDataFrame([(*x, 7) for x in rows], "k string, t int, i int, y double, _n int").drop("_n").repartition(3)


def grouped(rows):
    out = {}
    for k, t, i, y in rows:
        out.setdefault(k, []).append((t, i, y))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("span", [1, 7, 1000])
def test_previous_value_crosses_ranges(spark, span):
    rows, df = steps(spark)
    got = {x.i: x.last for x in O.previous(df, ["k"], ["t", "i"], F.floor(F.col("t") / span), "y", "last").collect()}
    assert got == {b[1]: a[2] if a else None for v in grouped(rows).values() for a, b in zip([None, *v], v, strict=False)}


@pytest.mark.parametrize("span, block, n", [(1, 3, 10), (9, 64, 10), (1000, 4096, 1), (5, 7, 7)])
def test_rolling_mean_crosses_blocks(spark, span, block, n):
    rows, df = steps(spark)
    got = {x.i: x.rolling_mean for x in S.rolling_mean(df, "k", ["t", "i"], "y", n, F.floor(F.col("t") / span), block).collect()}
    for v in grouped(rows).values():
        for at, (_, i, _) in enumerate(v):
            seen = [y for _, _, y in v[max(0, at - n + 1) : at + 1] if y is not None]
            assert got.pop(i) == (pytest.approx(sum(seen) / len(seen)) if seen else None)
    assert not got


def test_curves_and_divergence_match_plain_sums(spark):
    rows, df = steps(spark)
    rows, df = [r for r in rows if r[3] is not None], df.where("y IS NOT NULL")
    curves = {x.k: x for x in S.loss_curves(df, "k", ["t", "i"], "y", F.floor(F.col("t") / 4)).collect()}
    bad = {x.i for x in S.diverging(df, "k", ["t", "i"], "y", 1.5, 48.0, F.floor(F.col("t") / 4)).collect()}
    want = set()
    for k, v in grouped(rows).items():
        y = np.array([x[2] for x in v])
        w = max(1, -(-len(y) // 5))
        assert (curves[k].n_steps, curves[k].window_steps) == (len(y), w)
        assert curves[k].first_window == pytest.approx(y[:w].mean(), abs=1e-4) and curves[k].last_window == pytest.approx(y[-w:].mean(), abs=1e-4)
        assert curves[k].loss_slope == pytest.approx(np.polyfit(np.arange(len(y)), y, 1)[0], abs=1e-6)
        want |= {v[i][1] for i in range(len(y)) if y[i] > 48 or i >= w and y[i] > 1.5 * y[:w].mean()}
    assert bad == want


@pytest.mark.parametrize("span", [2, 10_000])
def test_token_buckets_over_ranges(spark, span):
    r = random.Random(4)
    rows = [(r.choice("xxxxy"), float(r.choice([r.randint(0, 40), r.randint(300, 320)])), i) for i in range(200)]
    df = spark.createDataFrame(rows, "c string, t double, i int").withColumn("t", F.timestamp_seconds("t"))
    got = {x.i: x.allowed for x in R.token_buckets(df, "c", "t", "i", 4.0, 0.5, ttl_s=100.0, span_s=span).collect()}
    want, state = {}, {}
    for c, t, i in sorted(rows, key=lambda x: (x[1], x[2])):
        tokens, last = state.get(c, (4.0, t))
        tokens = 4.0 if t - last >= 100 else min(4.0, tokens + (t - last) * 0.5)
        want[i] = tokens >= 1
        state[c] = (tokens - want[i], t)
    assert got == want


def test_digest_is_fed_from_small_batches(spark):
    rows = [("hot" if i % 3 else None, i % 500, f"v{i}" if i % 11 else None) for i in range(2000)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame(rows, "g string, o int, p string").repartition(5)
        got = {x.g: (x.n, x.digest) for x in O.streamed_digest(df, ["g"], ["o", "p"], F.col("p").cast("binary"), b"|").collect()}
        one = O.streamed_digest(df, [], ["o", "p"], F.col("p").cast("binary")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    plain = lambda some, sep: hashlib.sha256(sep.join(x[2] for x in sorted(some, key=lambda x: (x[1], x[2] or "")) if x[2]).encode()).hexdigest()
    assert got == {g: (sum(r[0] == g for r in rows), plain([r for r in rows if r[0] == g], "|")) for g in ("hot", None)}
    assert [(x.n, x.digest) for x in one] == [(2000, plain(rows, ""))]
    assert O.streamed_digest(df.limit(0), ["g"], ["o"], F.col("p").cast("binary")).count() == 0


@pytest.mark.parametrize("part", [20_000, 50, 3])
def test_bootstrap_is_near_the_closed_form(spark, part):
    r = np.random.default_rng(part)
    x = {"a": r.normal(3, 2, 1500), "b": r.exponential(1, 900), None: r.integers(0, 2, 4000).astype(float)}
    df = spark.createDataFrame([(k, float(v)) for k, xs in x.items() for v in xs] + [("a", None), ("none", None)], "g string, v double")
    got = {q.g: q for q in B.bootstrap_ci(df, "g", "v", resamples=4000, part=part).collect()}
    assert got.keys() == x.keys()
    for k, xs in x.items():
        se = xs.std() / np.sqrt(len(xs))
        assert got[k].n == len(xs) and got[k].mean == pytest.approx(xs.mean())
        assert abs(got[k].lo - (xs.mean() - 1.96 * se)) < 0.25 * se and abs(got[k].hi - (xs.mean() + 1.96 * se)) < 0.25 * se


def test_bootstrap_of_constant_and_small_groups(spark):
    df = spark.createDataFrame([("c", 2.5)] * 20 + [("one", 7.0)], "g string, v double")
    got = {q.g: (q.n, q.mean, q.lo, q.hi) for q in B.bootstrap_ci(df, "g", "v", resamples=50).collect()}
    assert got == {"c": (20, 2.5, 2.5, 2.5), "one": (1, 7.0, 7.0, 7.0)}
    again = [tuple(q) for q in B.bootstrap_ci(df, "g", "v", resamples=50).collect()]
    assert sorted(again) == sorted((k, *v) for k, v in got.items())


def test_paired_bootstrap_wants_the_same_items(spark):
    rows = [("g", i, float(i % 5)) for i in range(300)]
    base = spark.createDataFrame(rows, "g string, k int, v double")
    cand = base.withColumn("v", F.col("v") + 1 + F.col("k") % 2)
    q = B.paired_bootstrap_ci(base, cand, "g", "k", "v").first()
    assert q.n == 300 and q.mean == 1.5 and 1.4 < q.lo < 1.5 < q.hi < 1.6
    for other in (cand.where("k > 0"), cand.unionByName(cand.where("k = 1")), cand.withColumn("v", F.when(F.col("k") > 0, F.col("v"))), cand.unionByName(spark.createDataFrame([("g", 999, 1.0)], cand.schema))):
        with pytest.raises(Exception, match="same items on both sides"):
            B.paired_bootstrap_ci(base, other, "g", "k", "v").collect()


def test_anchor_wants_the_frozen_tasks(spark):
    out = spark.createDataFrame([("t/10", True), ("t/9", False), ("t/9", True), ("odd", False)], "task string, passed boolean")
    frozen = out.select("task").distinct()
    got = [tuple(x) for x in S.anchor_tasks(out, frozen, "task", "passed").orderBy("place").collect()]
    assert got == [(0, "t/9", 2, 1, 0.5, True), (1, "t/10", 1, 1, 1.0, True), (2, "odd", 1, 0, 0.0, False)]
    for wrong in (frozen.where("task <> 'odd'"), frozen.unionByName(spark.createDataFrame([("t/11",)], "task string"))):
        with pytest.raises(Exception, match="do not match the frozen tasks"):
            S.anchor_tasks(out, wrong, "task", "passed").collect()
