"""Means that are rounded or compared are added up in the order of the steps."""

import random

from pyspark.sql import functions as F

from lodestone.operators import scoring as S
from lodestone.operators.ordering import ordered_means


def test_ordered_means_add_one_after_the_other(spark):
    rows = [("a", i, v) for i, v in enumerate([1e16, 1.0, -1e16, 3.0])] + [(None, 0, 2.0), (None, 1, None), ("b", 0, None)]
    got = ordered_means(spark.createDataFrame(rows, "g string, i int, v double").repartition(3), ["g"], ["i"], "v", "m").collect()
    assert {r.g: r.m for r in got} == {"a": (1e16 + 1.0 - 1e16 + 3.0) / 4, None: 2.0}


def test_curves_round_and_diverge_as_sums_in_order_do(spark):
    r = random.Random(5)
    losses = {u: [r.randrange(20_000) / 100 for _ in range(80)] for u in range(1500)}
    rows = [(u, i, v) for u, vs in losses.items() for i, v in enumerate(vs)]
    steps = spark.createDataFrame(rows, "u int, i int, v double").repartition(6)

    def mean(vs):
        total = 0.0
        for v in vs:
            total += v
        return total / len(vs)

    got = {x.u: (x.first_window, x.last_window) for x in S.loss_curves(steps, "u", ["i"], "v", F.floor(F.col("i") / 7)).collect()}
    assert got == {u: (round(mean(vs[:16]) * 1e4) / 1e4, round(mean(vs[-16:]) * 1e4) / 1e4) for u, vs in losses.items()}
    bad = {(x.u, x.i) for x in S.diverging(steps, "u", ["i"], "v", 1.0, 190.0, F.floor(F.col("i") / 7)).collect()}
    assert bad == {(u, i) for u, vs in losses.items() for i, v in enumerate(vs) if v > 190 or (i >= 16 and v > mean(vs[:16]))}
