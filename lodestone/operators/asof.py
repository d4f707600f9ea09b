"""Backward as-of join (J16): for every probe the last version before it, without gathering a key in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(probes: DataFrame, versions: DataFrame, by: list[str], at: str, bucket: Callable[[Column], Column], strict: bool = True, found: str = "found") -> DataFrame:
    """``probes`` with ``found``, a struct of the other columns of the version with the greatest ``at`` below the
    probe's (not above it, unless ``strict``) under the same ``by``; null if there is none.

    Both tables hold ``by`` and ``at``; a probe need not be one of the versions. Of versions with one ``at`` the
    greatest struct counts. Null keys and null places match nothing, and their probes stay. Repeated probes stay
    repeated.

    Both tables are stacked and cut into ranges by ``bucket``, which must not fall while ``at`` rises. A range
    takes the last version before each probe from its own rows, and what the ranges before it end with, one row a
    range, is carried over. So a key with a third of all rows is sorted by as many tasks as it has ranges.
    """
    rest = [c for c in versions.columns if c not in by]
    usable = F.col(at).isNotNull()
    for c in by:
        usable = usable & F.col(c).isNotNull()
    keys = [*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), F.col(at).alias("_at")]
    names = [f"_k{i}" for i in range(len(by))]
    v = versions.where(usable).select(*keys, F.struct(at, *(c for c in rest if c != at)).alias("_v"), F.lit(int(strict)).alias("_late"))
    p = probes.select(*keys, F.struct(*probes.columns).alias("_p"), F.lit(int(not strict)).alias("_late"))
    both = p.unionByName(v, allowMissingColumns=True).withColumn("_b", bucket(F.col("_at")))
    inside = Window.partitionBy(*names, "_b").orderBy("_at", "_late", F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("_in", F.last("_v", ignorenulls=True).over(inside)).where("_p IS NOT NULL")
    before = Window.partitionBy(*names).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = both.groupBy(*names, "_b").agg(F.max("_v").alias("_end"))
    carried = ends.select(*(F.col(c).alias(f"{c}c") for c in names), F.col("_b").alias("_bc"), F.last("_end", ignorenulls=True).over(before).alias("_carried")).where("_carried IS NOT NULL")
    on = F.col("_b") == F.col("_bc")
    for c in names:
        on = on & (F.col(c) == F.col(f"{c}c"))
    whole = F.col("_at").isNotNull()
    for c in names:
        whole = whole & F.col(c).isNotNull()
    return near.join(carried, on, "left").select("_p.*", F.when(whole, F.coalesce("_in", "_carried")).alias(found))
