"""Percentile bootstrap intervals of groups of any size.

A resample of n values draws how often each value occurs, which is multinomial. The values of a group are
first counted, then dealt to parts; how many of the n draws fall into each part is multinomial as well. So one
task draws the parts' shares, a row a part, and each part draws its own values. Nothing is approximated.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct values of a part, and cells of draws that a task holds at once.
PART, CELLS = 20_000, 4_000_000


def _generator(seed: int, *what) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(repr(what).encode())])


def bootstrap_ci(values: DataFrame, by: str, value: str, resamples: int = 1000, seed: int = 0, alpha: float = 0.05, part: int = PART) -> DataFrame:
    """``by``, n, mean and the bounds lo and hi of the percentile interval of each group's mean.

    The bounds are the resampled means at places floor(alpha / 2 * (resamples - 1)) and ceil((1 - alpha / 2) *
    (resamples - 1)). One seed gives the same bounds for the same values and ``part``. Null values don't count; a
    group without values has no row; a null group is one.
    """
    if not 0 < alpha < 1 or resamples < 1:
        raise ValueError(f"alpha = {alpha}, resamples = {resamples}")
    counts = values.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("g"), F.col(value).cast("double").alias("x")).agg(F.count("*").alias("c"))
    sizes = counts.groupBy(F.col("g").alias("h")).agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    dealt = counts.join(sizes, F.col("g").eqNullSafe(F.col("h"))).select("g", "x", "c", F.pmod(F.xxhash64("x"), F.col("parts")).cast("int").alias("p"))
    kind = values.schema[by].dataType.simpleString()

    def share(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("p")
        n = int(pdf["c"].sum())
        draws = _generator(seed, key, "parts").multinomial(n, pdf["c"].to_numpy() / n, resamples)
        return pd.DataFrame({"g": pdf["g"], "p": pdf["p"], "draws": [d.tolist() for d in draws.T]})

    def draw(key: tuple, pdf: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        x, weight = pdf["x"].to_numpy(float), pdf["c"].to_numpy(float)
        n = np.asarray(drawn["draws"].iloc[0], np.int64)
        rng, sums, step = _generator(seed, key), np.zeros(resamples), max(1, CELLS // len(x))
        for at in range(0, resamples, step):
            sums[at : at + step] = rng.multinomial(n[at : at + step], weight / weight.sum()) @ x
        return pd.DataFrame({"g": [key[0]], "sums": [sums.tolist()]})

    shares = dealt.groupBy("g", "p").agg(F.sum("c").alias("c")).groupBy("g").applyInPandas(share, f"g {kind}, p int, draws array<bigint>")
    sums = dealt.groupBy("g", "p").cogroup(shares.groupBy("g", "p")).applyInPandas(draw, f"g {kind}, sums array<double>")
    whole = counts.groupBy(F.col("g").alias("h")).agg(F.sum("c").alias("n"), (F.sum(F.col("x") * F.col("c")) / F.sum("c")).alias("mean"))
    means = sums.select("g", F.posexplode("sums").alias("i", "s")).groupBy("g", "i").agg(F.sum("s").alias("s"))
    ordered = means.groupBy("g").agg(F.array_sort(F.collect_list("s")).alias("s"))  # one number a resample
    lo, hi = math.floor(alpha / 2 * (resamples - 1)), math.ceil((1 - alpha / 2) * (resamples - 1))
    met = ordered.join(whole, F.col("g").eqNullSafe(F.col("h")))
    return met.select(F.col("g").alias(by), "n", "mean", (F.get("s", F.lit(lo)) / F.col("n")).alias("lo"), (F.get("s", F.lit(hi)) / F.col("n")).alias("hi"))


def paired_bootstrap_ci(baseline: DataFrame, candidate: DataFrame, by: str, key: str, value: str, **how) -> DataFrame:
    """As ``bootstrap_ci``, for candidate minus baseline over the same items.

    Both tables hold ``by``, ``key`` and ``value``. An item that only one side has, that a side has twice or whose
    value is null is an error: the runs don't hold the same items.
    """
    one = lambda df, name: df.groupBy(F.col(by).alias("g"), F.col(key).alias("k")).agg(F.count("*").alias(f"n{name}"), F.max(value).cast("double").alias(name))
    b = one(baseline, "b")
    c = one(candidate, "c").withColumnsRenamed({"g": "h", "k": "l"})
    both = b.join(c, F.col("g").eqNullSafe(F.col("h")) & F.col("k").eqNullSafe(F.col("l")), "full_outer")
    same = (F.col("nb") == 1) & (F.col("nc") == 1) & F.col("b").isNotNull() & F.col("c").isNotNull()
    wrong = F.raise_error(F.concat(F.lit("a paired bootstrap needs the same items on both sides: "), F.coalesce(F.col("k"), F.col("l")).cast("string")))
    rows = both.select(F.coalesce("g", "h").alias(by), F.when(F.coalesce(same, F.lit(False)), F.col("c") - F.col("b")).otherwise(wrong).alias("difference"))
    return bootstrap_ci(rows, by, "difference", **how)
