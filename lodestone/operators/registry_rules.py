"""Version registry rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def retention(versions: DataFrame, decisions: DataFrame, active: DataFrame, referenced: DataFrame, keep_last: int) -> DataFrame:
    """``versions`` (name, version) with ``reasons`` to keep each; an empty list means delete.

    decisions: name, action, active_version_after. active: name, active. referenced: name, version.
    Memberships are joins on (name, version); the most recent ones come from a window per name.
    """
    if keep_last < 1:
        raise ValueError(f"keep_last must be at least 1, not {keep_last}")

    def mark(df: DataFrame, name: str) -> DataFrame:
        return df.distinct().withColumn(name, F.lit(True))

    went = decisions.select("name", F.col("active_version_after").alias("version"), "action")
    out = versions.withColumn("_recent", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("version"))) <= keep_last)
    for name, df in (
        ("_active", active.select("name", F.col("active").alias("version"))),
        ("_promoted", went.where("action = 'promote'").select("name", "version")),
        ("_restored", went.where("action = 'rollback'").select("name", "version")),
        ("_composite", referenced.select("name", "version")),
    ):
        out = out.join(mark(df, name), ["name", "version"], "left")
    labels = [F.when(F.coalesce("_" + x, F.lit(False)), x) for x in ("active", "recent", "promoted", "restored", "composite")]
    return out.select("name", "version", F.array_compact(F.array(*labels)).alias("reasons"))


def previous_versions(versions: DataFrame, name: str, version: str) -> DataFrame:
    """The greatest version below each one."""
    return versions.withColumn("previous_version", F.lag(version).over(Window.partitionBy(name).orderBy(version)))


def active_pointers(events: DataFrame, name: str, target: str, seq: str) -> DataFrame:
    """Where each name points after all its events."""
    return events.groupBy(name).agg(F.max_by(target, seq).alias("active_version"), F.max(seq).alias("as_of"))


def restore_action(current: Column, to: Column) -> Column:
    return F.when(to < current, "rollback").otherwise("promote")


def swap_part(prov: Column, part: Column, before: Column, after: Column) -> Column:
    """Provenance with the version of a part moved; null if the part doesn't occur."""
    cluster = (prov["cluster_name"] == part) & (prov["cluster_version"] == before)
    client = (prov["client_name"] == part) & (prov["client_version"] == before)
    return F.when(cluster, prov.withField("cluster_version", after)).when(client, prov.withField("client_version", after))


def cascade(active: DataFrame, stored: DataFrame, moves: DataFrame) -> DataFrame:
    """Composites to move when parts move: name, from_version, target provenance, reuse_version (null: build).

    active and stored: name, version, prov. moves: part, before, after. Each composite joins the
    moves on its cluster part and on its client part, never on both at once.
    """
    keyed = active.select("*", F.explode(F.array(F.struct(F.col("prov.cluster_name").alias("part"), F.col("prov.cluster_version").alias("before")), F.struct(F.col("prov.client_name").alias("part"), F.col("prov.client_version").alias("before")))).alias("k"))
    met = keyed.select("name", "version", "prov", "k.part", "k.before").join(moves, ["part", "before"])
    target = met.withColumn("target", swap_part(F.col("prov"), F.col("part"), F.col("before"), F.col("after")))
    have = stored.groupBy("name", F.col("prov").alias("target")).agg(F.max("version").alias("reuse_version"))
    return target.join(have, ["name", "target"], "left").select("name", F.col("version").alias("from_version"), "part", "target", "reuse_version")


def merged_nodes(nodes: DataFrame, key: str, seq: str, attrs: list[str]) -> DataFrame:
    """One node a key; of each attribute the last value that isn't null."""
    return nodes.groupBy(key).agg(*(F.max_by(a, F.when(F.col(a).isNotNull(), F.col(seq))).alias(a) for a in attrs))


def sweep_points(params: DataFrame, axes: list[str], done: DataFrame) -> DataFrame:
    """The product of the distinct values of ``axes`` without the points in ``done``.

    Axes are sets of parameter values, which configuration bounds.
    """
    points = None
    for a in axes:
        values = params.select(a).distinct()
        points = values if points is None else points.crossJoin(values)
    return points.join(done, axes, "left_anti")


#: Paths to a node up to which its grandparents are gathered.
PATHS = 10_000


def grandparents(up: DataFrame, down: DataFrame, most: int = PATHS) -> DataFrame:
    """(node, n_grandparents, n_paths) over the edges ``up`` (grandparent, mid) and ``down`` (mid, node); repeated edges count once.

    A mid's grandparents travel as one set to each of its nodes, so what moves is a row an edge and not a row a path. A
    node with over ``most`` paths counts its distinct pairs instead, so no set or node is gathered beyond that. A null
    grandparent is a path, but no grandparent.
    """
    up, down = up.select("grandparent", "mid").where("mid is not null"), down.select("mid", "node").where("mid is not null")
    highest = lambda edges, key: edges.groupBy(key).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    edges = down.distinct()

    def gathered(up: DataFrame, edges: DataFrame) -> DataFrame:
        sets = up.groupBy("mid").agg(F.collect_set("grandparent").alias("_set"), F.max(F.col("grandparent").isNull().cast("int")).alias("_none"))
        met = edges.join(sets, "mid").groupBy("node").agg(F.collect_list("_set").alias("_sets"), F.sum(F.size("_set") + F.col("_none")).alias("n_paths"))
        return met.select("node", F.size(F.array_distinct(F.flatten("_sets"))).cast("bigint").alias("n_grandparents"), "n_paths")

    if highest(up, "mid") * highest(down, "node") <= most:  # a bound on all nodes' paths
        return gathered(up, edges)
    up = up.distinct()
    degree = up.groupBy("mid").agg(F.count("*").alias("n"))
    paths = edges.join(degree, "mid").groupBy(F.col("node").alias("_node")).agg(F.sum("n").alias("n_paths"))
    known = lambda side: edges.join(paths.where(side), F.col("node").eqNullSafe(F.col("_node"))).drop("_node")
    light = gathered(up.join(degree.where(F.col("n") <= most), "mid", "left_semi"), known(F.col("n_paths") <= most).drop("n_paths"))
    pairs = known(F.col("n_paths") > most).join(up, "mid").select("node", "n_paths", "grandparent").distinct()
    return light.unionByName(pairs.groupBy("node", "n_paths").agg(F.count("grandparent").alias("n_grandparents")))
