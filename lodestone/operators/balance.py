"""Checks and balance figures of a partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def balance(shards: DataFrame, name: str, n: str) -> DataFrame:
    """One row: counts, gini, coefficient of variation, imbalance ratio and the first smallest and largest shard.

    ``shards`` has one row a shard, so its single window holds only shards. Ties go to the
    first shard by name. No shards give no row.
    """
    x = F.col(n).cast("double")
    ranked = shards.select(F.col(name).alias("_s"), x.alias("_x"), F.row_number().over(Window.orderBy(x, F.col(name))).alias("_i"))
    mean, total, count = F.avg("_x"), F.sum("_x"), F.count("*")
    gini = F.when(total <= 0, 0.0).otherwise(2.0 * F.sum(F.col("_i") * F.col("_x")) / (count * total) - (count + 1) / count)
    cv = F.when((count < 2) | (mean == 0), 0.0).otherwise(F.stddev_pop("_x") / mean)
    ratio = F.when(F.min("_x") <= 0, F.lit(float("inf"))).otherwise(F.max("_x") / F.min("_x"))
    row = ranked.agg(
        count.alias("num_shards"), F.min("_x").cast("bigint").alias("min_files"), F.max("_x").cast("bigint").alias("max_files"), F.bround(mean, 4).alias("mean_files"),
        F.median("_x").alias("median_files"), F.bround(ratio, 6).alias("imbalance_ratio"), F.bround(gini, 6).alias("gini"), F.bround(cv, 6).alias("coefficient_of_variation"),
        F.min_by("_s", F.struct("_x", "_s")).alias("min_client"), F.max_by("_s", F.struct("_x", -F.col("_i"))).alias("max_client"),
    )
    return row.where("num_shards > 0")


def coverage(corpus: DataFrame, assigned: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: ``unassigned`` or ``unknown``."""
    a, b = corpus.select(key).distinct(), assigned.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("problem", F.lit("unassigned")).unionByName(b.join(a, key, "left_anti").withColumn("problem", F.lit("unknown")))


def compare_manifest(manifest: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer comparison: missing, extra or changed keys."""
    m, a = manifest.select(key, F.col(value).alias("expected")), actual.select(key, F.col(value).alias("found"))
    status = F.when(F.col("a_there").isNull(), "missing").when(F.col("m_there").isNull(), "extra").when(~F.col("expected").eqNullSafe(F.col("found")), "changed")
    both = m.withColumn("m_there", F.lit(1)).join(a.withColumn("a_there", F.lit(1)), key, "full_outer")
    return both.withColumn("status", status).where("status IS NOT NULL").select(key, "expected", "found", "status")


def content_leaks(records: DataFrame, digest: str, shard: str) -> DataFrame:
    """Digests in several shards: the owner (first shard by name), and how many rows leak into others."""
    groups = records.groupBy(digest).agg(F.min(shard).alias("owner"), F.countDistinct(shard).alias("n_shards")).where("n_shards > 1")
    return records.join(groups, digest).where(F.col(shard) != F.col("owner")).groupBy(digest, "owner", "n_shards").agg(F.count("*").alias("n_leaks"))


def id_collisions(records: DataFrame, key: str, shard: str) -> DataFrame:
    return records.groupBy(key).agg(F.countDistinct(shard).alias("n_shards")).where("n_shards > 1")


def purity(records: DataFrame, shard: str, shard_cluster: str, cluster: str) -> DataFrame:
    """Mean over a cluster's shards of the share of their records that belong to the cluster."""
    per = records.groupBy(shard, shard_cluster).agg(F.avg((F.col(cluster) == F.col(shard_cluster)).cast("double")).alias("_p"))
    return per.groupBy(shard_cluster).agg(F.bround(F.avg("_p"), 6).alias("purity"), F.count("*").alias("n_shards"))
