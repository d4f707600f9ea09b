"""Queries over ``embeddings`` as update vectors and adapter factors."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import compose as C
from lodestone.operators import kernels as K
from lodestone.operators import lowrank as L
from lodestone.operators import similarity as M
from lodestone.plans.registry import query
from lodestone.sources.tables import load

VEC = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"


@query(f"""WITH {VEC}, p AS (SELECT a.label AS block, a.vec_id AS i, b.vec_id AS j, CASE WHEN a.vec_id = b.vec_id THEN 1.0::DOUBLE ELSE greatest(-1.0, least(1.0, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))))) END AS c
    FROM v a JOIN v b ON a.label = b.label AND a.vec_id <= b.vec_id) SELECT block, i, j, round_even(c, 6) AS cosine FROM p""")
def cosine_pairs(spark, d):
    """Cosines inside a label; the blocks stand for a (layer, module)."""
    return L.cosine_tiles(load(spark, d, "embeddings"), "vec_id", "embedding", "label").withColumn("cosine", F.bround("cosine", 6))


@query(f"""WITH {VEC}, p AS (SELECT a.label = b.label AS same, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS c FROM v a JOIN v b ON a.vec_id <> b.vec_id)
    SELECT round_even(avg(c) FILTER (same), 6) AS cohesion, round_even(avg(c) FILTER (NOT same), 6) AS separation FROM p""")
def cohesion_separation(spark, d):
    return M.cohesion(load(spark, d, "embeddings"), "label", "embedding").select(F.bround("cohesion", 6).alias("cohesion"), F.bround("separation", 6).alias("separation"))


@query("""WITH r AS (SELECT label AS a, vec_id % 7 AS b FROM embeddings), t AS (SELECT a, b, count(*)::DOUBLE AS n FROM r GROUP BY 1, 2), s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM t) AS ij, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM t GROUP BY a)) AS sa,
    (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM t GROUP BY b)) AS sb, (SELECT sum(n) FROM t) AS n) SELECT round_even((ij - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)), 9) AS ari, CAST(n AS BIGINT) AS n_rows FROM s""")
def adjusted_rand(spark, d):
    return M.adjusted_rand(load(spark, d, "embeddings").withColumn("b", F.col("vec_id") % 7), "label", "b").withColumn("ari", F.bround("ari", 9))


@query(f"""WITH {VEC}, x AS (SELECT label, 1 + vec_id % 5 AS w, unnest(e) AS x, unnest(range(0, len(e))) AS pos FROM v) SELECT label, CAST(pos AS INT) AS pos, round_even(sum(w * x) / sum(w), 6) AS mean FROM x GROUP BY 1, 2""")
def weighted_centroid(spark, d):
    rows = load(spark, d, "embeddings").withColumn("w", 1 + F.col("vec_id") % 5)
    return M.weighted_mean(rows, ["label"], "embedding", "w").withColumn("mean", F.bround("mean", 6))


NORMS = f"""{VEC}, n AS (SELECT label, vec_id, round_even(sqrt(list_dot_product(e, e)) * CASE WHEN vec_id % 50 = 3 THEN 40 WHEN vec_id % 70 = 5 THEN 0.01 ELSE 1 + (vec_id % 10) / 10 END, 6) AS norm FROM v)"""


def norms(spark, d):
    scale = F.when(F.col("vec_id") % 50 == 3, 40.0).when(F.col("vec_id") % 70 == 5, 0.01).otherwise(1 + (F.col("vec_id") % 10) / 10)
    return load(spark, d, "embeddings").select("label", "vec_id", F.bround(F.sqrt(M.dot(F.col("embedding"), F.col("embedding"))) * scale, 6).alias("norm"))


@query(f"""WITH {NORMS}, m AS (SELECT label, median(norm) AS med, count(*) AS k FROM n GROUP BY 1), d AS (SELECT label, median(abs(norm - med)) AS mad FROM n JOIN m USING (label) GROUP BY 1)
    SELECT label, vec_id, norm, round_even(med, 6) AS median, round_even(mad, 6) AS mad FROM n JOIN m USING (label) JOIN d USING (label) WHERE k >= 3 AND (norm / med > 3 OR norm / med < 1 / 3.0::DOUBLE) AND (mad = 0 OR abs(norm - med) / (1.4826::DOUBLE * mad) > 3)""")
def norm_outliers(spark, d):
    return M.norm_outliers(norms(spark, d), "label", "vec_id", "norm").select("label", "vec_id", "norm", F.bround("median", 6).alias("median"), F.bround("mad", 6).alias("mad"))


@query(f"""WITH {NORMS} SELECT label, vec_id, array_to_string(list_filter([CASE WHEN norm > 8 THEN 'norm_error' WHEN norm > 5 THEN 'norm_warning' END, CASE WHEN label > 8 THEN 'rank_cap' END], lambda x: x IS NOT NULL), ',') AS problems FROM n""")
def integrity_screen(spark, d):
    problems = F.array(F.when(F.isnan("norm"), "nan").when(F.col("norm") > 8, "norm_error").when(F.col("norm") > 5, "norm_warning"), F.when(F.col("label") > 8, "rank_cap"))
    return norms(spark, d).select("label", "vec_id", F.array_join(F.array_compact(problems), ",").alias("problems"))


TENSOR = """t AS (SELECT vec_id, label, 'model.layers.' || (vec_id // 10) || '.self_attn.' || CASE WHEN vec_id % 2 = 0 THEN 'q_proj' ELSE 'v_proj' END || '.lora_' || CASE WHEN vec_id % 4 < 2 THEN 'A' ELSE 'B' END || '.weight' AS name, len(embedding) AS n, (vec_id % 10) * 256 AS begin, (vec_id % 10 + 1) * 256 + CASE WHEN vec_id = 37 THEN 4 ELSE 0 END AS stop FROM embeddings)"""


@query(f"""WITH {TENSOR}, p AS (SELECT *, CAST(regexp_extract(name, 'layers\\.(\\d+)\\.', 1) AS INT) AS layer, regexp_extract(name, '\\.([a-z_]+)\\.lora_', 1) AS module, regexp_extract(name, 'lora_([AB])', 1) AS part, lag(stop) OVER (PARTITION BY vec_id // 10 ORDER BY vec_id) AS before FROM t)
    SELECT layer, count(DISTINCT module) AS n_modules, count(DISTINCT part) AS n_parts, count(*) AS n_tensors, count(*) FILTER (before IS NOT NULL AND before <> begin) AS gaps, count(*) FILTER (n * 4 <> stop - begin) AS bad_sizes FROM p GROUP BY 1""")
def tensor_manifest_checks(spark, d):
    """Names, sizes and gapless tiling of tensors in a file; names and offsets are derived from the ids."""
    from pyspark.sql import Window

    i = F.col("vec_id")
    name = F.concat(F.lit("model.layers."), F.floor(i / 10).cast("string"), F.lit(".self_attn."), F.when(i % 2 == 0, "q_proj").otherwise("v_proj"), F.lit(".lora_"), F.when(i % 4 < 2, "A").otherwise("B"), F.lit(".weight"))
    begin = (i % 10) * 256
    t = load(spark, d, "embeddings").select("vec_id", name.alias("name"), F.size("embedding").alias("n"), begin.alias("begin"), (begin + 256 + F.when(i == 37, 4).otherwise(0)).alias("stop"))
    layer = F.regexp_extract("name", r"layers\.(\d+)\.", 1).cast("int")
    p = t.withColumn("layer", layer).withColumn("module", F.regexp_extract("name", r"\.([a-z_]+)\.lora_", 1)).withColumn("part", F.regexp_extract("name", "lora_([AB])", 1))
    p = p.withColumn("before", F.lag("stop").over(Window.partitionBy("layer").orderBy("vec_id")))
    return p.groupBy("layer").agg(
        F.countDistinct("module").alias("n_modules"), F.countDistinct("part").alias("n_parts"), F.count("*").alias("n_tensors"), F.count_if(F.col("before") != F.col("begin")).alias("gaps"), F.count_if(F.col("n") * 4 != F.col("stop") - F.col("begin")).alias("bad_sizes")
    )


def adapters(spark, d):
    """Each vector of 64 as factors of rank 4: a is 4 x 8, b is 8 x 4; label is the cluster, tens of ids the module."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    return load(spark, d, "embeddings").select("label", F.floor(F.col("vec_id") / 100).cast("int").alias("module"), F.col("vec_id").alias("adapter"), (1.0 + F.col("vec_id") % 3).alias("weight"), F.lit(4).alias("rank"), F.slice(e, 1, 32).alias("a"), F.slice(e, 33, 32).alias("b"))


#: (vec_id, label, module, w, product): the 8 x 8 products B A as flat lists.
PRODUCTS = f"""{VEC}, prod AS (SELECT vec_id, label, vec_id // 100 AS module, (1 + vec_id % 3)::DOUBLE AS w, list_transform(range(0, 64), lambda p: list_sum(list_transform(range(0, 4), lambda r: e[33 + (p // 8) * 4 + r] * e[1 + r * 8 + p % 8]))) AS m FROM v)"""


@query()
def lowrank_svd(spark, d):
    return L.low_rank_average(adapters(spark, d), ["label", "module"], 4)


@query(f"""WITH {PRODUCTS}, x AS (SELECT label, module, w, e.p, m[e.p] AS x, ff.a, ff.b FROM prod, (SELECT unnest(range(1, 65)) AS p) e, (SELECT 0 AS a, 0 AS b) ff),
    exact AS (SELECT label, module, p, sum(w * x) / sum(w) AS x FROM x GROUP BY 1, 2, 3),
    fa AS (SELECT label, vec_id // 100 AS module, i, sum((1 + vec_id % 3) * e[i]) / sum(1 + vec_id % 3) AS f FROM v, (SELECT unnest(range(1, 65)) AS i) t GROUP BY 1, 2, 3),
    fl AS (SELECT label, module, list(f ORDER BY i) AS f FROM fa GROUP BY 1, 2),
    naive AS (SELECT label, module, p, list_sum(list_transform(range(0, 4), lambda r: f[33 + ((p - 1) // 8) * 4 + r] * f[1 + r * 8 + (p - 1) % 8])) AS y FROM fl, (SELECT unnest(range(1, 65)) AS p) t),
    err AS (SELECT label, module, round_even(sqrt(sum((x - y) * (x - y)) / sum(x * x)), 6) AS e FROM exact JOIN naive USING (label, module, p) GROUP BY 1, 2)
    SELECT label, count(*) AS n_modules, max(e) AS max_naive_error, round_even(avg(e), 5) AS mean_naive_error FROM err GROUP BY 1""")
def aggregation_errors(spark, d):
    """Relative errors of the naive average against the exact one: greatest, mean and number of modules."""
    per = L.low_rank_average(adapters(spark, d), ["label", "module"], 4)
    return per.groupBy("label").agg(F.count("*").alias("n_modules"), F.max("naive_error").alias("max_naive_error"), F.bround(F.avg("naive_error"), 5).alias("mean_naive_error"))


CASES = "(SELECT unnest([4, 8]) AS rank_out) r"


@query(f"""WITH {PRODUCTS}, x AS (SELECT label, module, p, sum(w * m[p]) / sum(w) AS x FROM prod, (SELECT unnest(range(1, 65)) AS p) e GROUP BY 1, 2, 3)
    SELECT label, module, CAST(r.rank_out AS INT) AS rank_out, (8.0::DOUBLE + label) * r.rank_out / 4 AS alpha, round_even((8.0::DOUBLE + label) / 4 * sqrt(sum(x * x)), 4) AS update_norm FROM x, {CASES} GROUP BY label, module, r.rank_out""")
def svd_rank_change(spark, d):
    """Averages refactored to the adapters' rank and to another one: alpha follows the rank, so that the update
    (alpha / rank) b a keeps its size. Its norm is put together from what was kept and the truncation error."""
    rows = adapters(spark, d).withColumn("alpha", 8.0 + F.col("label"))
    both = [L.low_rank_average(rows, ["label", "module"], rank, rescale=True) for rank in (4, 8)]
    out = both[0].unionByName(both[1])
    # rows of a are orthogonal, and their squared lengths are the singular values
    values = F.transform(F.sequence(F.lit(0), F.col("rank") - 1), lambda r: F.aggregate(F.slice("a", r * 8 + 1, 8), F.lit(0.0), lambda s, x: s + x * x))
    square = F.aggregate(values, F.lit(0.0), lambda s, x: s + x * x)
    whole = F.col("alpha") / F.col("rank") * F.sqrt(square / (1 - F.col("truncation_error") * F.col("truncation_error")))
    return out.select("label", "module", F.col("rank").alias("rank_out"), "alpha", F.bround(whole, 4).alias("update_norm"))


@query()
def residual_accumulate(spark, d):
    """Per module: the start adapter (least id) plus the weighted residuals of the others over alpha = 0.5."""
    return L.accumulated(adapters(spark, d), ["label", "module"], 0.5, 4)


CLIENTS = 24


def client_factors(spark, d):
    """24 clients, each with one adapter a module; every third module has no start adapter."""
    rows = adapters(spark, d).withColumn("module", F.floor(F.col("adapter") / CLIENTS).cast("int"))
    starts = rows.where(f"adapter % {CLIENTS} = 0 AND module % 3 <> 0").select("module", F.col("rank").alias("start_rank"), F.col("a").alias("start_a"), F.col("b").alias("start_b"))
    return rows.withColumn("adapter", F.col("adapter") % CLIENTS).drop("label"), starts


def gram_sql(starts: bool) -> str:
    minus = "- CASE WHEN module % 3 <> 0 THEN s.m[p] ELSE 0 END" if starts else ""
    return f"""WITH {PRODUCTS}, c AS (SELECT vec_id % {CLIENTS} AS client, vec_id // {CLIENTS} AS module, m FROM prod), u AS (
        SELECT c.client, c.module, list_transform(range(1, 65), lambda p: c.m[p] {minus.replace("module", "c.module")}) AS m FROM c JOIN c s ON s.module = c.module AND s.client = 0)
        SELECT x.client AS i, y.client AS j, round_even(sum(list_dot_product(x.m, y.m)), 4) AS dot FROM u x JOIN u y ON x.module = y.module AND x.client <= y.client GROUP BY 1, 2"""


@query(gram_sql(False))
def factor_gram(spark, d):
    """Inner products of the clients' updates, from factors, summed over modules."""
    return L.factor_gram(client_factors(spark, d)[0], ["module"]).withColumn("dot", F.bround("dot", 4))


@query(gram_sql(True))
def update_gram(spark, d):
    """The same of updates: adapters less the module's start adapter, where there is one."""
    rows, starts = client_factors(spark, d)
    return L.factor_gram(rows, ["module"], starts).withColumn("dot", F.bround("dot", 4))


@query()
def kmeans_similarity(spark, d):
    """Clusters of the clients by the cosines of their updates; ids by first use."""
    rows, starts = client_factors(spark, d)
    return K.cluster_by_gram(L.factor_gram(rows, ["module"], starts), 3)


@query()
def kmeans_vectors(spark, d):
    """A cluster for every vector, by distributed k-means on unit vectors."""
    return M.cluster_vectors(load(spark, d, "embeddings"), "vec_id", "embedding", 10)


@query()
def client_apply(spark, d):
    """A row an adapter: stacked on its cluster's part (the label's least id), hashed, with the size of its schedule."""
    rows = adapters(spark, d)
    cluster = rows.groupBy("label").agg(F.min_by(F.struct("rank", "a", "b"), "adapter").alias("c"), F.count("*").alias("n"))

    def compose(row: dict) -> dict:
        part = row["c"] if isinstance(row["c"], dict) else row["c"].asDict()
        a, b = K.composed([(K.matrix(part, "a"), K.matrix(part, "b"), 0.5), (K.matrix(row, "a"), K.matrix(row, "b"), 1.0)])
        return {"adapter": row["adapter"], "label": row["label"], "rank": a.shape[0], "adapter_sha256": K.adapter_hash({"a": a, "b": b}), "n_batches": K.schedule_batches(row["n"], 2 * row["n"], 4, 7)}

    return K.apply_rows(rows.join(cluster, "label"), compose, "adapter bigint, label int, rank bigint, adapter_sha256 string, n_batches bigint")


@query()
def recluster_step(spark, d):
    """Clients reclustered by their updates against the assignment by id modulo 3; a dry run and its application."""
    rows, starts = client_factors(spark, d)
    gram = L.factor_gram(rows, ["module"], starts)
    before = rows.select("adapter", (F.col("adapter") % 3).cast("int").alias("before")).distinct()
    return K.recluster(gram, before, 3)


@query("""WITH r AS (SELECT label % 3 AS a, vec_id % 3 AS b FROM embeddings), p AS (SELECT unnest([[0,1,2],[0,2,1],[1,0,2],[1,2,0],[2,0,1],[2,1,0]]) AS q), s AS (SELECT q, avg((q[a + 1] = b)::INT) AS v FROM r, p GROUP BY 1)
    SELECT round_even(max(v), 9) AS agreement, (SELECT count(*) FROM r) AS n_rows FROM s""")
def partition_agreement(spark, d):
    """The share of rows on which two partitions agree after the best renaming of one."""
    rows = load(spark, d, "embeddings").select((F.col("label") % 3).alias("a"), (F.col("vec_id") % 3).alias("b"))
    return M.agreement(rows, "a", "b", 3).withColumn("agreement", F.bround("agreement", 9))


@query(f"""WITH {VEC}, l AS (SELECT *, label % 4 AS a, CASE WHEN vec_id % 5 = 0 THEN vec_id % 4 ELSE label % 4 END AS b FROM v), t AS (SELECT a, b, count(*)::DOUBLE AS n FROM l GROUP BY 1, 2),
    s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM t) AS ij, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM t GROUP BY a)) AS sa, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM t GROUP BY b)) AS sb, (SELECT sum(n) FROM t) AS n),
    p AS (SELECT x.a = y.a AS same_a, x.b = y.b AS same_b, list_dot_product(x.e, y.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))) AS c FROM l x JOIN l y ON x.vec_id <> y.vec_id)
    SELECT (SELECT round_even(avg((a = b)::INT), 9) FROM l) AS agreement, (SELECT round_even((ij - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)), 9) FROM s) AS ari,
           round_even(avg(c) FILTER (same_a), 6) AS dynamic_cohesion, round_even(avg(c) FILTER (NOT same_a), 6) AS dynamic_separation, round_even(avg(c) FILTER (same_b), 6) AS warm_start_cohesion, round_even(avg(c) FILTER (NOT same_b), 6) AS warm_start_separation FROM p""")
def warm_start_comparison(spark, d):
    """A clustering against the assignment it started from: the same ids, the adjusted Rand index, and how well each groups the vectors."""
    a = F.col("label") % 4
    rows = load(spark, d, "embeddings").select("embedding", a.alias("a"), F.when(F.col("vec_id") % 5 == 0, F.col("vec_id") % 4).otherwise(a).alias("b"))
    out = M.compare_partitions(rows, "embedding", "a", "b")
    names = ("dynamic_cohesion", "dynamic_separation", "warm_start_cohesion", "warm_start_separation")
    return out.select(F.bround("agreement", 9).alias("agreement"), F.bround("ari", 9).alias("ari"), *(F.bround(c, 6).alias(c) for c in names))


@query(f"""WITH {VEC}, p AS (SELECT vec_id // 10 AS key, vec_id % 2 AS part, 'm' || (vec_id % 10) // 2 AS module, CASE WHEN vec_id % 2 = 0 THEN CASE WHEN (vec_id // 10) % 5 = 0 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END ELSE 1.0::DOUBLE END AS c, CASE WHEN vec_id % 2 = 0 THEN 4 ELSE 2 END AS r, e FROM v WHERE vec_id % 7 <> 0),
    n AS (SELECT key, count(*) FILTER (c <> 0) AS live, min(part) AS first FROM p GROUP BY 1),
    k AS (SELECT p.*, coalesce(sum(r) OVER (PARTITION BY key, module ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(r) OVER (PARTITION BY key, module) AS rank FROM p JOIN n USING (key) WHERE c <> 0 OR (live = 0 AND part = first)),
    a AS (SELECT key, module, rank, sum((before * 8 + i) * e[i]) AS x FROM k, (SELECT unnest(range(1, 33)) AS i) WHERE i <= r * 8 GROUP BY 1, 2, 3),
    b AS (SELECT key, module, sum((((i - 1) // r) * rank + before + (i - 1) % r + 1) * e[32 + i] * c) AS x FROM k, (SELECT unnest(range(1, 33)) AS i) WHERE i <= r * 8 GROUP BY 1, 2)
    SELECT key, module, CAST(rank AS INT) AS rank, round_even(a.x, 4) AS a_sum, round_even(b.x, 4) AS b_sum FROM a JOIN b USING (key, module)""")
def compose_modules(spark, d):
    """A cluster's and a client's adapters put together, module by module; some modules have one part alone, and some
    clusters count nothing. Sums are weighted by place, so order shows."""
    i, e = F.col("vec_id"), F.transform("embedding", lambda x: x.cast("double"))
    key = F.floor(i / 10)
    even = i % 2 == 0
    rank = F.when(even, 4).otherwise(2)
    parts = load(spark, d, "embeddings").where("vec_id % 7 <> 0").select(
        key.alias("key"), (i % 2).alias("part"), F.concat(F.lit("m"), F.floor((i % 10) / 2)).alias("module"), F.when(~even, 1.0).when(key % 5 == 0, 0.0).otherwise(0.5).alias("coefficient"),
        rank.alias("rank"), F.slice(e, F.lit(1), rank * 8).alias("a"), F.slice(e, F.lit(33), rank * 8).alias("b"),
    )
    placed = lambda c: F.bround(F.aggregate(F.transform(c, lambda x, at: x * (at + 1)), F.lit(0.0), lambda s, x: s + x), 4)
    return C.compose(parts, ["key"]).select("key", "module", "rank", placed("a").alias("a_sum"), placed("b").alias("b_sum"))
