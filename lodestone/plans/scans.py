"""Queries that write documents of a kind to the shared folder and read them back under their fixed schemas."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.functions import text as X
from lodestone.operators import kernels as K
from lodestone.operators import lowrank as L
from lodestone.operators import similarity as M
from lodestone.operators import validators as V
from lodestone.plans.registry import query
from lodestone.plans.similarity import VEC, adapters
from lodestone.sources import files as S
from lodestone.sources import packs as P
from lodestone.sources import tensors as T
from lodestone.sources.scratch import scratch_path
from lodestone.sources.tables import load


@query("""SELECT 'by-' || lang AS strategy, source AS client_id, CAST(count(*) AS INT) AS num_files, CAST(sum(n_chars) AS BIGINT) AS total_bytes FROM documents GROUP BY 1, 2""")
def manifest_scan(spark, d):
    """A partition manifest a language, a document each; the scan gives a row a shard."""
    path = scratch_path(spark, "manifests")
    per = load(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").cast("int").alias("num_files"), F.sum("n_chars").alias("total_bytes"))
    shard = F.struct(F.col("source").alias("client_id"), F.col("lang").alias("cluster_id"), "num_files", "total_bytes")
    manifests = per.groupBy("lang").agg(F.collect_list(shard).alias("shards"))  # the few sources of a language
    manifests.select(F.lit("1.1.0").alias("manifest_version"), F.concat(F.lit("by-"), "lang").alias("strategy"), F.lit(7).alias("seed"), F.size("shards").alias("num_clients"), "shards").write.json(path)
    return S.shards(spark.read.schema(schemas.PARTITION_MANIFEST).option("mode", "FAILFAST").json(path)).select("strategy", "client_id", "num_files", "total_bytes")


@query("""SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS round, 'c' || user_id % 4 AS cluster, CAST(count(*) AS INT) AS n_uploads, round_even(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def round_manifest_scan(spark, d):
    """A manifest a day with a map of clusters; the scan gives a row a round and cluster."""
    path = scratch_path(spark, "rounds")
    day = F.date_diff(F.to_date("ts"), F.to_date(F.lit("2024-01-01")))
    per = load(spark, d, "events").groupBy(day.alias("round"), F.concat(F.lit("c"), F.col("user_id") % 4).alias("cluster")).agg(F.count("*").cast("int").alias("n_uploads"), F.bround(F.sum("value"), 4).alias("total"))
    rounds = per.groupBy("round").agg(F.map_from_entries(F.collect_list(F.struct("cluster", F.struct("n_uploads", "total")))).alias("clusters"))  # four clusters
    rounds.write.json(path)
    back = spark.read.schema("round int, clusters map<string,struct<n_uploads:int,total:double>>").option("mode", "FAILFAST").json(path)
    return S.nested(back, "clusters", "cluster")


@query("""SELECT 'conv/' || conv_id AS task_id, count(*) AS n_samples, count(*) FILTER (role = 'user') AS n_solutions, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations GROUP BY 1""")
def sample_scan(spark, d):
    """Turns as samples, some with a solution and some with a completion; either is the sample."""
    path = scratch_path(spark, "samples")
    user = F.col("role") == "user"
    rows = load(spark, d, "conversations").select(F.concat(F.lit("conv/"), "conv_id").alias("task_id"), F.when(user, F.col("text")).alias("solution"), F.when(~user, F.col("text")).alias("completion"))
    S.write_jsonl(rows, path)
    back = S.samples(S.read_jsonl(spark, path, schemas.SAMPLE, ["task_id"]))
    return back.groupBy("task_id").agg(F.count("*").alias("n_samples"), F.count("solution").alias("n_solutions"), F.sum(F.length("sample")).alias("n_chars"))


@query("""SELECT source || '/' || lang || '/' || item || '.py' AS path, sha256(replace(t, chr(13) || chr(10), chr(10))) AS text_sha256, place FROM (
    SELECT source, lang, doc_id AS item, text || chr(13) || chr(10) AS t, row_number() OVER (ORDER BY string_split(source || '/' || lang || '/' || doc_id || '.py', '/')) - 1 AS place FROM documents JOIN labels USING (doc_id))""")
def source_tree_texts(spark, d):
    """Labelled documents as files of a tree, read once with newlines normalised, and their places in path order."""
    root = scratch_path(spark, "tree")
    path = F.concat_ws("/", "source", "lang", F.concat("doc_id", F.lit(".py")))
    files = load(spark, d, "documents").join(load(spark, d, "labels").select("doc_id"), "doc_id").select(path.alias("path"), F.concat("text", F.lit("\r\n")).cast("binary").alias("content"))
    P.write_tree(files, root)
    texts = S.texts(spark, root).select("path", X.sha256(F.col("text")).alias("text_sha256"))
    return S.numbered_paths(texts, "path", "place")


@query(f"""WITH {VEC} SELECT vec_id, len(e) AS n, round_even(list_sum(e), 4) AS total, vec_id % 9 <> 4 AS fits FROM v""")
def tensor_text_codec(spark, d):
    """Vectors as base64 tensors and back; every ninth claims another shape."""
    e = load(spark, d, "embeddings").select("vec_id", F.lit("w").alias("name"), F.array(F.lit(8), F.when(F.col("vec_id") % 9 == 4, 9).otherwise(8)).alias("shape"), "embedding")
    text = T.encoded(e, "embedding")
    back = T.decoded(text.withColumn("fits", T.base64_fits(F.col("data"), F.col("shape"))), "data")
    return back.select("vec_id", F.size("data").cast("bigint").alias("n"), F.bround(F.aggregate("data", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), "fits")


@query("""WITH r AS (SELECT vec_id, label % 3 AS a, CASE WHEN vec_id % 4 = 0 THEN vec_id % 3 ELSE (label + 2) % 3 END AS b FROM embeddings), p AS (SELECT unnest([[0,1,2],[0,2,1],[1,0,2],[1,2,0],[2,0,1],[2,1,0]]) AS q),
    s AS (SELECT q, count(*) FILTER (q[a + 1] = b) AS n FROM r, p GROUP BY 1), best AS (SELECT q FROM s ORDER BY n DESC, q LIMIT 1) SELECT vec_id, CAST(q[a + 1] AS INT) AS aligned FROM r, best""")
def label_alignment(spark, d):
    """Clusters renamed to agree best with a reference; of equal renamings the first."""
    i = F.col("vec_id")
    rows = load(spark, d, "embeddings").select("vec_id", (F.col("label") % 3).alias("a"), F.when(i % 4 == 0, i % 3).otherwise((F.col("label") + 2) % 3).alias("b"))
    return M.align_labels(rows, "a", "b", 3).select("vec_id", "aligned")


@query(f"""WITH {VEC}, p AS (SELECT vec_id, label, vec_id // 100 AS module, (1 + vec_id % 3)::DOUBLE AS w, row_number() OVER (PARTITION BY label, vec_id // 100 ORDER BY vec_id) = 1 AS first, list_transform(range(0, 64), lambda p: list_sum(list_transform(range(0, 4), lambda r: e[33 + (p // 8) * 4 + r] * e[1 + r * 8 + p % 8]))) AS m FROM v),
    x AS (SELECT label, module, i, sum(m[i]) FILTER (first) + coalesce(2 * sum(w * m[i]) FILTER (NOT first) / sum(w) FILTER (NOT first), 0) AS x FROM p, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2, 3)
    SELECT label, module, round_even(sqrt(sum(x * x)), 4) AS update_norm FROM x GROUP BY 1, 2""")
def residual_sum(spark, d):
    """Start plus weighted residuals over alpha = 0.5, refactored to the modules' full rank, so that nothing is cut off."""
    out = L.accumulated(adapters(spark, d), ["label", "module"], 0.5, 8)
    values = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.aggregate(F.slice("a", r * 8 + 1, 8), F.lit(0.0), lambda s, x: s + x * x))
    return out.select("label", "module", F.bround(F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + x * x)), 4).alias("update_norm"))


@query("""SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN 1000 // (event_id % 10) END AS share, CASE WHEN event_id % 10 = 0 THEN 'ZeroDivisionError: integer division or modulo by zero' END AS error FROM events""")
def handled_rows(spark, d):
    """A call for every event; one that fails keeps its error and doesn't end the job."""
    rows = load(spark, d, "events").select("event_id", (F.col("event_id") % 10).alias("by"))
    out = K.apply_rows(rows.withColumnRenamed("event_id", "id"), lambda r: {"share": 1000 // int(r["by"])}, "share bigint", keep=["id"])
    return out.withColumnRenamed("id", "event_id")


@query("""WITH c AS (SELECT o_orderkey, '{"lr":"' || o_orderpriority || '","seed":"' || o_custkey % 5 || '","status":"' || o_orderstatus || '"}' AS whole, '{"lr":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}' AS kept FROM orders)
    SELECT o_orderkey, sha256(whole) AS config_sha256, left(sha256(kept), 10) AS run_id FROM c""")
def config_hashes(spark, d):
    """Digests of configurations, and run ids from those without the swept key."""
    config = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("seed"), (F.col("o_custkey") % 5).cast("string"), F.lit("lr"), F.col("o_orderpriority"))
    return load(spark, d, "orders").select("o_orderkey", S.config_digest(config).alias("config_sha256"), F.substring(S.config_digest(config, ("seed",)), 1, 10).alias("run_id"))


@query("""WITH t AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN 'w' || user_id END AS name, CASE WHEN event_id % 5 <> 0 THEN 'F32' END AS dtype, event_id % 11 <> 0 AS shaped, CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 68 ELSE 64 END AS chars FROM events)
    SELECT event_id, array_to_string(list_filter([CASE WHEN name IS NULL THEN 'missing name' END, CASE WHEN dtype IS NULL THEN 'missing dtype' END, CASE WHEN NOT shaped THEN 'missing shape' END, CASE WHEN chars IS NULL THEN 'missing data' END,
        CASE WHEN chars * 3 > 4 * 50 THEN 'too large' END], lambda x: x IS NOT NULL), ',') AS problems FROM t""")
def request_tensors(spark, d):
    """Tensors of requests that lack fields or hold more base64 text than 50 bytes make."""
    i = F.col("event_id")
    data = F.when(i % 13 == 0, None).when(i % 3 == 0, "A" * 68).otherwise("A" * 64)
    found = V.tensor_problems(F.when(i % 7 != 0, F.concat(F.lit("w"), "user_id")), F.when(i % 5 != 0, "F32"), F.when(i % 11 != 0, F.array(F.lit(4), F.lit(3))), data, most_bytes=50)
    return load(spark, d, "events").select("event_id", F.array_join(found, ",").alias("problems"))


@query("""WITH f AS (SELECT source, row_number() OVER (ORDER BY min(doc_id)) - 1 AS canonical FROM documents GROUP BY 1) SELECT doc_id, CAST(canonical AS INT) AS canonical FROM documents JOIN f USING (source)""")
def canonical_numbers(spark, d):
    """Sources numbered from 0 by the first document that bears them."""
    return M.canonical_labels(load(spark, d, "documents").select("doc_id", "source"), "doc_id", "source").select("doc_id", "canonical")
