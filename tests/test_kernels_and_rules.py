import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import kernels as K
from lodestone.operators import lowrank as L
from lodestone.operators import registry_rules as G
from lodestone.operators import rounds as R
from lodestone.operators import scoring as S
from lodestone.operators import similarity as M

RNG = np.random.default_rng(5)


def factors(n, rank=3, out=8, inside=6):
    return [(RNG.normal(size=(rank, inside)), RNG.normal(size=(out, rank))) for _ in range(n)]


def test_low_rank_sum_is_the_best_truncation():
    f, c = factors(3), [0.5, 0.3, 0.2]
    exact = sum(x * b @ a for x, (a, b) in zip(c, f, strict=True))
    u, s, vt = np.linalg.svd(exact)
    for rank in (1, 3, 6):
        a, b, error = L.low_rank_sum(f, c, rank)
        assert np.allclose(b @ a, (u[:, :rank] * s[:rank]) @ vt[:rank])
        assert math.isclose(error, math.sqrt((s[rank:] ** 2).sum() / (s**2).sum()), abs_tol=1e-12)
    with pytest.raises(ValueError):
        L.low_rank_sum(f, c, 7)


def test_accumulation_and_composition():
    start, *rest = factors(3, rank=2)
    a, b, _ = L.accumulate(start, rest, [1.0, 3.0], 0.5, 6)
    want = start[1] @ start[0] + (rest[0][1] @ rest[0][0] / 4 + rest[1][1] @ rest[1][0] * 3 / 4) / 0.5
    assert np.allclose(b @ a, want)
    a, b = K.composed([(*start, 0.0), (*rest[0], 1.0)])
    assert (a == rest[0][0]).all() and (b == rest[0][1]).all()
    a, b = K.composed([(*start, 0.25), (*rest[0], 1.0)])
    assert np.allclose(b @ a, 0.25 * start[1] @ start[0] + rest[0][1] @ rest[0][0])


def test_kmeans_finds_planted_groups_and_alignment():
    centre = RNG.normal(size=(2, 16))
    x = np.repeat(centre, 5, 0) + 0.01 * RNG.normal(size=(10, 16))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    labels, inertia = K.kmeans(u @ u.T, 2)
    assert labels.tolist() == [0] * 5 + [1] * 5 and inertia < 0.1
    assert K.aligned(labels, 1 - labels, 2).tolist() == (1 - labels).tolist()


def test_norm_outliers_need_three_and_both_tests(spark):
    rows = [("two", 1, 1.0), ("two", 2, 1000.0)] + [("three", i, x) for i, x in enumerate([1.0, 1.1, 1000.0])] + [("low", i, x) for i, x in enumerate([1.0, 1.0, 1.0, 0.001])]
    got = M.norm_outliers(spark.createDataFrame(rows, "g string, i int, n double"), "g", "i", "n").collect()
    assert sorted((r.g, r.i) for r in got) == [("low", 3), ("three", 2)]


def test_cohesion_equals_pairs(spark):
    x = RNG.normal(size=(12, 4))
    x[3] = 0
    label = [0, 0, 1, 1, 1, 2, 0, 1, 2, 2, 2, 3]
    got = M.cohesion(spark.createDataFrame([(i, v.tolist()) for i, v in zip(label, x, strict=True)], "l int, v array<double>"), "l", "v").first()
    n = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.divide(x, n, where=n > 0, out=np.zeros_like(x))
    sim, same, off = u @ u.T, np.equal.outer(label, label), ~np.eye(12, dtype=bool)
    assert np.isclose(got.cohesion, sim[same & off].mean()) and np.isclose(got.separation, sim[~same].mean())


def test_pass_at_k(spark):
    rows = [(n, c, k) for n in range(6) for c in range(n + 1) for k in range(1, 7)]
    got = spark.createDataFrame(rows, "n int, c int, k int").select("n", "c", "k", S.pass_at_k(F.col("n"), F.col("c"), F.col("k")).alias("p")).collect()
    for r in got:
        want = 1 - math.comb(r.n - r.c, r.k) / math.comb(r.n, r.k) if 1 <= r.k <= r.n else None
        assert (r.p is None) == (want is None) and (want is None or math.isclose(r.p, want, abs_tol=1e-12))


def test_promotion_rule_on_raw_doubles(spark):
    rows = [(0.1, 0.30, 0.28), (0.1, 0.50, 0.48), (0.0, 0.3, 0.3), (None, 0.3, 0.3), (0.1, None, 0.3)]
    df = spark.createDataFrame(rows, "d double, b double, c double")
    got = [r.r for r in df.select(R.promotion_reasons(F.col("d"), F.lit(0.0), F.col("b"), F.col("c"), 0.02).alias("r")).collect()]
    assert got == [[], ["guard_regression"], ["in_project_not_improved"], ["in_project_unmeasured"], ["guard_unavailable"]]


def test_retention_reasons(spark):
    versions = spark.createDataFrame([("a", v) for v in range(1, 9)], "name string, version int")
    decisions = spark.createDataFrame([("a", "promote", 2), ("a", "rollback", 3)], "name string, action string, active_version_after int")
    active = spark.createDataFrame([("a", 5)], "name string, active int")
    plan = G.retention(versions, decisions, active, spark.createDataFrame([("a", 4)], "name string, version int"), 2)
    assert {r.version: r.reasons for r in plan.collect()} == {1: [], 2: ["promoted"], 3: ["restored"], 4: ["composite"], 5: ["active"], 6: [], 7: ["recent"], 8: ["recent"]}
    with pytest.raises(ValueError):
        G.retention(versions, decisions, active, versions, 0)


def test_null_epsilon_poisons(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", None)], "g string, e double")
    assert dict(df.groupBy("g").agg(R.max_or_null("e").alias("e")).collect()) == {"a": 2.0, "b": None}


def test_token_bucket(spark):
    rows = [("c", f"2024-01-01 00:00:0{s}", i) for i, s in enumerate([0, 0, 0, 1, 5, 5, 5])]
    df = spark.createDataFrame(rows, "c string, t string, i int").withColumn("t", F.to_timestamp("t"))
    got = [r.allowed for r in sorted(R.token_buckets(df, "c", "t", "i", 2.0, 1.0).collect(), key=lambda r: r.i)]
    assert got == [True, True, False, True, True, True, False]
