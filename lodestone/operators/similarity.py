"""Similarity, clustering figures and norm screens over vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAD_TO_SIGMA = 1.4826


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def weighted_mean(rows: DataFrame, by: list[str], vector: str, weight: str) -> DataFrame:
    """Weighted mean of the vectors of a group, element by element. Weights must be positive.

    Elements are exploded and summed, so partial sums combine before the shuffle.
    """
    w = F.when(F.col(weight) > 0, F.col(weight)).otherwise(F.raise_error(F.lit("weights must be positive")))
    long = rows.select(*by, w.cast("double").alias("_w"), F.posexplode(vector).alias("pos", "x"))
    return long.groupBy(*by, "pos").agg((F.sum(F.col("_w") * F.col("x")) / F.sum("_w")).alias("mean"))


def cohesion(units: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean cosine of distinct pairs within labels and between labels (NaN if there is none).

    From sums instead of pairs: the cosines of a set of unit vectors add up to the squared length of
    their sum. So the cost grows with the rows, not with their square.
    """
    norm = F.sqrt(dot(F.col(vector), F.col(vector)))
    unit = units.withColumn("_n", norm).select(F.col(label).alias("l"), (F.col("_n") > 1e-12).cast("int").alias("_ok"), F.when(F.col("_n") > 1e-12, F.transform(vector, lambda x: x / F.col("_n"))).otherwise(F.transform(vector, lambda x: x * 0.0)).alias("u"))
    sizes = unit.groupBy("l").agg(F.count("*").alias("n"), F.sum("_ok").alias("ok"))
    sums = unit.select("l", F.posexplode("u").alias("p", "x")).groupBy("l", "p").agg(F.sum("x").alias("s"))
    per = sums.groupBy("l").agg(F.sum(F.col("s") * F.col("s")).alias("sq"))
    total = sums.groupBy("p").agg(F.sum("s").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("all"))
    one = sizes.join(per, "l").agg(F.sum("n").alias("n"), F.sum("ok").alias("ok"), F.sum("sq").alias("sq"), F.sum(F.col("n") * (F.col("n") - 1)).alias("w"))
    b = F.col("n") * F.col("n") - F.col("w") - F.col("n")
    nan = F.lit(float("nan"))
    return one.join(F.broadcast(total)).select(
        F.when(F.col("w") > 0, (F.col("sq") - F.col("ok")) / F.col("w")).otherwise(nan).alias("cohesion"), F.when(b > 0, (F.col("all") - F.col("sq")) / b).otherwise(nan).alias("separation")
    )


def adjusted_rand(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings, from their contingency table; 1 for fewer than two rows."""
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2.0)
    table = rows.groupBy(a, b).agg(F.count("*").alias("n"))
    ij = table.agg(F.coalesce(pairs("n"), F.lit(0.0)).alias("ij"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    sa = table.groupBy(a).agg(F.sum("n").alias("m")).agg(F.coalesce(pairs("m"), F.lit(0.0)).alias("sa"))
    sb = table.groupBy(b).agg(F.sum("n").alias("m")).agg(F.coalesce(pairs("m"), F.lit(0.0)).alias("sb"))
    one = ij.join(F.broadcast(sa)).join(F.broadcast(sb))  # one row each
    whole = F.when(F.col("n") < 2, 1.0).otherwise(F.col("n") * (F.col("n") - 1) / 2.0)
    expected, most = F.col("sa") * F.col("sb") / whole, (F.col("sa") + F.col("sb")) / 2.0
    return one.select(F.when((F.col("n") < 2) | (most == expected), 1.0).otherwise((F.col("ij") - expected) / F.nullif(most - expected, F.lit(0.0))).alias("ari"), F.col("n").alias("n_rows"))


def norm_outliers(rows: DataFrame, by: str, key: str, norm: str, ratio: float = 3.0, sigma: float = 3.0) -> DataFrame:
    """Rows whose norm is a robust outlier of its group of at least three: far from the median by
    ``ratio`` and by ``sigma`` robust deviations (any distance if the deviation is zero)."""
    med = rows.groupBy(by).agg(F.median(norm).alias("median"), F.count("*").alias("_n")).where("_n >= 3")
    near = rows.join(med, by)
    mad = near.groupBy(by).agg(F.median(F.abs(F.col(norm) - F.col("median"))).alias("mad"))
    r = F.col(norm) / F.nullif(F.col("median"), F.lit(0.0))
    far = F.when(F.col("median") > 0, (r > ratio) | (r < 1.0 / ratio)).otherwise(F.col(norm) > 0)
    z = F.abs(F.col(norm) - F.col("median")) / F.nullif(MAD_TO_SIGMA * F.col("mad"), F.lit(0.0))
    return near.join(mad, by).where(far & F.coalesce(z > sigma, F.lit(True))).select(by, key, norm, "median", "mad")


def canonical_labels(rows: DataFrame, key: str, label: str) -> DataFrame:
    """Labels renumbered from 0 by the first key that bears them."""
    first = rows.groupBy(label).agg(F.min(key).alias("_first"))
    number = first.withColumn("canonical", F.row_number().over(Window.orderBy("_first")) - 1)  # one row a label
    return rows.join(number.drop("_first"), label)


def cluster_vectors(rows: DataFrame, key: str, vector: str, k: int, seed: int = 0) -> DataFrame:
    """(key, cluster) for every row: k-means on unit vectors, so near means a high cosine. Clusters are
    numbered by the least key in them. A zero vector stays at the origin. Data stay distributed; the driver
    holds the centres only."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    norm = F.sqrt(dot(F.col(vector), F.col(vector)))
    unit = rows.select(F.col(key).alias("key"), F.transform(vector, lambda x: x.cast("double")).alias("v"), norm.alias("n"))
    points = unit.select("key", array_to_vector(F.transform("v", lambda x: F.when(F.col("n") > 1e-12, x / F.col("n")).otherwise(0.0))).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=50).fit(points)
    found = model.transform(points).select(F.col("key").alias(key), F.col("prediction").alias("cluster"))
    return canonical_labels(found, key, "cluster").select(key, F.col("canonical").alias("cluster"))


def agreement(rows: DataFrame, a: str, b: str, k: int) -> DataFrame:
    """One row: the greatest share of rows with equal labels (0 .. k - 1) over all renamings of ``a``; k <= 8.
    Rows count once, in a table of k * k cells; the renamings are tried on that table."""
    if not 1 <= k <= 8:
        raise ValueError(f"k = {k}")
    table = rows.groupBy(a, b).agg(F.count("*").alias("n"))
    each = table.select(a, b, "n", F.posexplode(_renamings(k)).alias("p", "to"))
    hits = F.sum(F.when(F.element_at("to", (F.col(a) + 1).cast("int")) == F.col(b), F.col("n")).otherwise(0))
    return each.groupBy("p").agg((hits / F.sum("n")).alias("s"), F.sum("n").alias("n")).agg(F.max("s").alias("agreement"), F.max("n").alias("n_rows"))


def _renamings(k: int) -> Column:
    """All permutations of 0 .. k - 1: each shorter one with the next number put in at every place."""

    def longer(shorter: Column, n: int) -> Column:
        put = lambda p, i: F.concat(F.slice(p, F.lit(1), i), F.array(F.lit(n)), F.slice(p, i + 1, F.lit(n)))
        return F.flatten(F.transform(shorter, lambda p: F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: put(p, i))))

    out = F.array(F.array(F.lit(0)))
    for n in range(1, k):
        out = longer(out, n)
    return out


def align_labels(rows: DataFrame, label: str, reference: str, k: int) -> DataFrame:
    """``rows`` with ``aligned``: ``label`` (0 .. k - 1, k <= 8) under the renaming that agrees with ``reference`` on most rows, the
    first in order on ties (A35). Renamings are tried on the table of k * k counts, and one row, the best, is joined."""
    if not 1 <= k <= 8:
        raise ValueError(f"k = {k}")
    table = rows.groupBy(F.col(label).alias("_a"), F.col(reference).alias("_b")).agg(F.count("*").alias("_n"))
    each = table.select("_a", "_b", "_n", F.explode(_renamings(k)).alias("_to"))
    hits = each.groupBy("_to").agg(F.sum(F.when(F.get("_to", F.col("_a").cast("int")) == F.col("_b"), F.col("_n")).otherwise(0)).alias("_hits"))
    best = hits.agg(F.min_by("_to", F.struct((-F.col("_hits")).alias("h"), "_to")).alias("_best"))
    return rows.join(F.broadcast(best)).withColumn("aligned", F.get("_best", F.col(label).cast("int"))).drop("_best")


def compare_partitions(rows: DataFrame, vector: str, dynamic: str, warm: str) -> DataFrame:
    """One row comparing two labelings of the same vectors (A34): ``agreement`` (the share with the same id in both, no renaming),
    ``ari``, and cohesion and separation of each (NaN if there is no such pair)."""
    same = rows.agg(F.avg(F.col(dynamic).eqNullSafe(F.col(warm)).cast("double")).alias("agreement"))
    of = lambda label, name: cohesion(rows, label, vector).select(F.col("cohesion").alias(f"{name}_cohesion"), F.col("separation").alias(f"{name}_separation"))
    # one row each
    return same.join(F.broadcast(adjusted_rand(rows, dynamic, warm))).join(F.broadcast(of(dynamic, "dynamic"))).join(F.broadcast(of(warm, "warm_start")))
