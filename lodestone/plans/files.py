"""Queries that write files of a kind to the shared folder and scan them, and queries of the validators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import similarity as M
from lodestone.operators import validators as V
from lodestone.operators.schema_check import contract_report
from lodestone.plans.registry import query
from lodestone.sources import files as S
from lodestone.sources import packs as PK
from lodestone.sources import tensor_files as TF
from lodestone.sources import tensors as T
from lodestone.sources import versions as R
from lodestone.sources.scratch import scratch_path, stored
from lodestone.sources.tables import load


@query("""SELECT event_type, 2 * count(*) AS n, CAST(2 * sum(event_id) AS BIGINT) AS total, CAST(2 * sum(CAST(props->>'$.k' AS INT)) AS BIGINT) AS k FROM events GROUP BY 1""")
def jsonl_scan(spark, d):
    """Events as JSON lines, written once and appended once, read under a fixed schema."""
    path = scratch_path(spark, "jsonl")
    rows = load(spark, d, "events").select("event_id", "event_type", F.from_json("props", "k INT", {"mode": "FAILFAST"}).alias("props"))
    S.write_jsonl(rows, path)
    S.append_log(rows, path)
    back = S.read_corpus(spark, path, "event_id bigint, event_type string, props struct<k:int>", ["event_id", "event_type"])
    return back.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("total"), F.sum("props.k").alias("k"))


@query("""SELECT n_regionkey || '/' || n_nationkey AS path, n_nationkey AS key, n_nationkey % 3 = 0 AS done FROM nation WHERE n_nationkey % 5 <> 4""")
def run_record_scan(spark, d):
    """A record a run, one document in a folder of its experiment; the scan finds them by their place."""
    root = scratch_path(spark, "runs")
    known = load(spark, d, "nation").where("n_nationkey % 5 <> 4").collect()  # at most 25 rows
    for n in known:
        S.write_document(spark, f"{root}/{n.n_regionkey}/{n.n_nationkey}/run.json", {"key": n.n_nationkey, "done": n.n_nationkey % 3 == 0})
    return S.read_runs(spark, root, "key bigint, done boolean").select("path", "key", "done")


@query("""WITH v AS (SELECT n_regionkey AS name, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INT) AS version, n_name, n_nationkey FROM nation)
    SELECT 'region' || name AS name, max(version) AS version, sha256(max_by(n_name, version)) AS sha256, CAST(count(*) FILTER (n_nationkey % 11 = 3) AS BIGINT) AS broken FROM v GROUP BY 1""")
def version_store_scan(spark, d):
    """Payloads in folders by name and version; every eleventh has lost a byte."""
    root = scratch_path(spark, "versions")
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    payload = F.col("n_name").cast("binary")
    rows = load(spark, d, "nation").select(
        F.concat(F.lit("region"), F.col("n_regionkey").cast("string")).alias("name"), F.row_number().over(w).alias("version"), F.lit("composite").alias("kind"), F.lit(None).cast("string").alias("cluster_id"),
        F.sha2(payload, 256).alias("sha256"), F.octet_length(payload).cast("bigint").alias("num_bytes"), F.when(F.col("n_nationkey") % 11 == 3, F.substring("n_name", 2, 100)).otherwise(F.col("n_name")).cast("binary").alias("payload"),
    )
    rows.write.partitionBy("name", "version").parquet(root)
    there = R.scan(spark, root)
    bad = R.broken(there).groupBy(F.col("name").alias("_name")).agg(F.count("*").alias("broken"))
    out = R.latest(there).join(bad, F.col("name") == F.col("_name"), "left")
    return out.select("name", "version", "sha256", F.coalesce("broken", F.lit(0)).alias("broken"))


@query("""WITH m AS (SELECT doc_id FROM documents WHERE doc_id % 7 <> 0), f AS (SELECT doc_id, toxic = 1 AS edited FROM documents JOIN labels USING (doc_id))
    SELECT coalesce(m.doc_id, f.doc_id) || '.txt' AS path, CASE WHEN f.doc_id IS NULL THEN 'missing' WHEN m.doc_id IS NULL THEN 'extra' ELSE 'changed' END AS status
    FROM m FULL JOIN f ON m.doc_id = f.doc_id WHERE f.doc_id IS NULL OR m.doc_id IS NULL OR f.edited""")
def pack_verify(spark, d):
    """A pack's manifest (without every seventh file) against the files there are: labelled ones, toxic ones edited."""
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path")
    docs, labels = load(spark, d, "documents"), load(spark, d, "labels")
    manifest = R.pack_manifest(docs.where("doc_id % 7 <> 0").select(name, F.col("text").cast("binary").alias("content")))
    edited = F.concat("text", F.when(F.col("toxic") == 1, "!").otherwise("")).cast("binary")
    return R.verify_pack(manifest, docs.join(labels.select("doc_id", "toxic"), "doc_id").select(name, edited.alias("content")))


@query("""SELECT source || '/' || doc_id || '.txt' AS path, CAST(octet_length(encode(text)) AS BIGINT) AS num_bytes, sha256(text) AS sha256, 'whole' AS status FROM documents""")
def pack_archive(spark, d):
    """All documents packed into archives, read back from them and held against the manifest."""
    root = scratch_path(spark, "pack")
    files = load(spark, d, "documents").select(F.concat_ws("/", "source", F.concat("doc_id", F.lit(".txt"))).alias("path"), F.col("text").cast("binary").alias("content"))
    PK.write_pack(files, root, archives=4)
    back = R.pack_manifest(PK.read_pack(spark, root))
    return back.join(PK.verified_pack(spark, root), "path", "left").withColumn("status", F.coalesce("status", F.lit("whole")))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)
    SELECT vec_id AS file, CAST(vec_id % 12 AS INT) AS layer, 'q_proj' AS module, part, 32 AS n, round_even(list_sum(CASE WHEN part = 'A' THEN e[1:32] ELSE e[33:64] END), 4) AS total
    FROM v, (SELECT unnest(['A', 'B']) AS part) p""")
def tensor_file_scan(spark, d):
    """Vectors written as tensor files of two factors, then checked, read and named again."""
    path = scratch_path(spark, "tensors")

    def pack(pdfs):
        for pdf in pdfs:
            files = [T.to_file({f"layers.{i % 12}.q_proj.lora_A.weight": e[:32].reshape(4, 8), f"layers.{i % 12}.q_proj.lora_B.weight": e[32:].reshape(8, 4)}) for i, e in zip(pdf["vec_id"], pdf["embedding"], strict=True)]
            yield pd.DataFrame({"file": pdf["vec_id"], "content": files})

    load(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(pack, "file bigint, content binary").write.parquet(path)
    rows = T.tensor_rows(spark.read.schema("file bigint, content binary").parquet(path), "file", "content")
    layer, module, part = T.key_parts(F.col("name"))
    total = F.aggregate("data", F.lit(0.0), lambda a, x: a + x)
    return rows.select("file", layer.alias("layer"), module.alias("module"), part.alias("part"), F.size("data").alias("n"), F.bround(total, 4).alias("total"))


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)
    SELECT 'adapter-' || vec_id // 40 AS folder, CAST(vec_id % 40 AS INT) AS layer, part, 4 AS r, 32 AS n, round_even(list_sum(CASE WHEN part = 'lora_A' THEN e[1:32] ELSE e[33:64] END), 4) AS total
    FROM v, (SELECT unnest(['lora_A', 'lora_B']) AS part) p WHERE vec_id % 40 < 10 AND label % 2 = 0""")
def adapter_folder_scan(spark, d):
    """Vectors written as adapter folders, a layer each; of the folders only the first ten layers of one module are read."""
    root = scratch_path(spark, "adapters")
    v = load(spark, d, "embeddings").select(F.concat(F.lit("adapter-"), F.floor(F.col("vec_id") / 40)).alias("folder"), (F.col("vec_id") % 40).alias("layer"), F.when(F.col("label") % 2 == 0, "q_proj").otherwise("v_proj").alias("module"), "embedding")
    name = lambda part: F.concat(F.lit(f"{TF.PREFIX}.layers."), "layer", F.lit(f".{TF.SEGMENT}."), "module", F.lit(f".{part}.weight"))
    sides = F.array(F.struct(name("lora_A").alias("name"), F.array(F.lit(4), F.lit(8)).alias("shape"), F.slice("embedding", 1, 32).alias("data")), F.struct(name("lora_B").alias("name"), F.array(F.lit(8), F.lit(4)).alias("shape"), F.slice("embedding", 33, 32).alias("data")))
    tensors = v.select("folder", F.explode(sides).alias("t")).select("folder", "t.*")
    configs = v.select("folder", F.lit('{"r": 4, "lora_alpha": 8}').alias("config")).distinct()
    stored(TF.write_adapters(tensors, configs, root), "manifest")
    back = TF.read_adapters(spark, root, "r int, lora_alpha double").where("layer < 10 AND module = 'q_proj'")
    return back.select("folder", "layer", "part", F.col("config.r").alias("r"), F.size("data").alias("n"), F.bround(F.aggregate("data", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("""WITH t AS (SELECT vec_id // 20 AS file, CAST(vec_id % 20 // 4 + CASE WHEN vec_id // 20 % 3 = 1 AND vec_id % 20 >= 8 THEN 1 ELSE 0 END AS INT) AS layer, CASE WHEN vec_id % 2 = 0 THEN 'q_proj' ELSE 'v_proj' END AS module,
        vec_id % 4 < 2 AS first, CASE WHEN vec_id // 20 % 5 = 2 AND vec_id % 20 = 7 THEN 16 ELSE 8 END AS rank FROM embeddings WHERE NOT (vec_id // 20 % 4 = 3 AND vec_id % 20 = 5)),
    f AS (SELECT file, count(DISTINCT layer) AS n_layers, max(layer) AS last, count(DISTINCT module) AS m, list_sort(list(DISTINCT module)) AS modules, min(rank) AS rank, max(rank) AS most, count(*) AS n_tensors FROM t GROUP BY 1)
    SELECT file, n_layers, array_to_string(modules, ',') AS modules, rank, n_tensors, array_to_string(list_filter([CASE WHEN n_layers <= last THEN 'missing_layers' END, CASE WHEN rank <> most THEN 'mixed_rank' END, CASE WHEN n_tensors <> 2 * n_layers * m THEN 'count' END], lambda x: x IS NOT NULL), ',') AS problems FROM f""")
def adapter_structure(spark, d):
    """Twenty vectors name the tensors of a file; some files lack a layer or a tensor, or mix ranks."""
    i, file = F.col("vec_id") % 20, F.floor(F.col("vec_id") / 20)
    layer = F.floor(i / 4) + F.when((file % 3 == 1) & (i >= 8), 1).otherwise(0)
    part, rank = F.when(F.col("vec_id") % 4 < 2, "lora_A").otherwise("lora_B"), F.when((file % 5 == 2) & (i == 7), 16).otherwise(8)
    name = F.concat(F.lit("layers."), layer, F.lit("."), F.when(F.col("vec_id") % 2 == 0, "q_proj").otherwise("v_proj"), F.lit("."), part, F.lit(".weight"))
    shape = F.when(part == "lora_A", F.array(rank, F.lit(64))).otherwise(F.array(F.lit(64), rank))
    t = load(spark, d, "embeddings").where(~((file % 4 == 3) & (i == 5))).select(file.alias("file"), name.alias("name"), shape.alias("shape"))
    out = TF.described(TF.renamed(t, ["file"], "name", "long"), ["file"])
    return out.select("file", "n_layers", F.array_join("modules", ",").alias("modules"), "rank", "n_tensors", F.array_join("problems", ",").alias("problems"))


UPLOAD = """u AS (SELECT event_id, event_id % 2 = 0 AS nested, event_id % 7 <> 0 AS has_client, event_id % 11 <> 0 AS whole_rank, event_id % 13 <> 0 AS has_modules, event_id % 17 <> 0 AS is_object FROM events)"""


@query(f"""WITH {UPLOAD} SELECT event_id, CASE WHEN NOT is_object THEN 'not an object' ELSE array_to_string(list_filter([CASE WHEN NOT has_client THEN 'missing client_id' END,
    CASE WHEN NOT whole_rank THEN 'rank must be a integer' END, CASE WHEN NOT has_modules THEN 'missing target_modules' END], lambda x: x IS NOT NULL), ',') END AS problems FROM u""")
def upload_validators(spark, d):
    """Metadata of uploads as JSON in both shapes, with fields left out and of the wrong type."""
    i = F.col("event_id")
    text = lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    client = F.when(i % 7 != 0, F.concat(F.lit('"client_id": '), text(F.col("user_id")), F.lit(", "))).otherwise("")
    rank = F.when(i % 11 != 0, (i % 16).cast("string")).otherwise('"eight"')
    modules = F.when(i % 13 != 0, ', "target_modules": ["q_proj", "v_proj"]').otherwise("")
    inner = F.concat(F.lit('"rank": '), rank, modules)
    flat = F.concat(F.lit("{"), client, F.lit('"round_id": 3, '), inner, F.lit("}"))
    nested = F.concat(F.lit("{"), client, F.lit('"round": 3, "hparams": {'), inner, F.lit("}}"))
    doc = F.when(i % 17 == 0, "[1, 2]").when(i % 2 == 0, nested).otherwise(flat)
    return load(spark, d, "events").select("event_id", F.array_join(V.upload_problems(doc), ",").alias("problems"))


CONTRACT = {
    "type": "object",
    "required": ["client_id", "round", "hparams"],
    "properties": {
        "client_id": {"type": "string"},
        "round": {"type": "integer", "minimum": 0},
        "hparams": {"type": "object", "required": ["rank"], "properties": {"rank": {"type": "integer", "maximum": 16}}},
        "target_modules": {"type": "array", "minItems": 1, "items": {"enum": ["q_proj", "v_proj"]}},
    },
}


@query("""WITH e AS (SELECT event_id AS i, event_id % 4 = 0 AS note, event_id % 6 = 0 AS alpha, CASE WHEN event_id % 17 = 0 THEN ['document root must be an object, not array'] ELSE list_filter([
        CASE WHEN event_id % 7 = 0 THEN 'schema[<root>]: lacks client_id' END, CASE WHEN event_id % 5 = 0 THEN 'schema[round]: below 0' END,
        CASE WHEN event_id % 11 = 0 THEN 'schema[hparams/rank]: is string, not integer' WHEN event_id % 20 > 16 THEN 'schema[hparams/rank]: above 16' END,
        CASE WHEN event_id % 13 = 0 THEN 'schema[target_modules]: holds fewer than 1' WHEN event_id % 3 = 0 THEN 'schema[target_modules/1]: is none of ["q_proj", "v_proj"]' END], lambda x: x IS NOT NULL) END AS errors FROM events)
    SELECT i AS event_id, array_to_string(errors, '; ') AS errors, CASE WHEN len(errors) > 0 OR NOT (note OR alpha) THEN '' ELSE 're-serialisation drift on field(s): ' || CASE WHEN note AND alpha THEN 'alpha, note' WHEN alpha THEN 'alpha' ELSE 'note' END END AS warnings FROM e""")
def contract_documents(spark, d):
    """Documents against a JSON schema and a round trip: members that lack, have the wrong type or value, or get lost."""
    i = F.col("event_id")
    client = F.when(i % 7 != 0, F.concat(F.lit('"client_id": "'), F.col("user_id"), F.lit('", '))).otherwise("")
    rank = F.when(i % 11 == 0, '"eight"').otherwise((i % 20).cast("string"))
    modules = F.when(i % 13 == 0, "[]").when(i % 3 == 0, '["q_proj", "x"]').otherwise('["v_proj"]')
    more = F.concat(F.when(i % 4 == 0, ', "note": "x"').otherwise(""), F.when(i % 6 == 0, ', "alpha": 1.5').otherwise(', "alpha": 2'))
    document = F.concat(F.lit("{"), client, F.lit('"round": '), F.when(i % 5 == 0, -1).otherwise(i % 9), F.lit(', "hparams": {"rank": '), rank, F.lit('}, "target_modules": '), modules, more, F.lit("}"))
    rows = load(spark, d, "events").select("event_id", F.when(i % 17 == 0, "[1, 2]").otherwise(document).alias("document"))
    out = contract_report(rows, "document", CONTRACT, "client_id string, round int, hparams struct<rank:int>, target_modules array<string>, alpha int")
    return out.select("event_id", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"))


@query("""WITH p AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN '' WHEN 1 THEN '/etc/x' WHEN 2 THEN 'a/../b' WHEN 3 THEN 'C:\\x' ELSE 'a/b' || page_id END AS path FROM pages)
    SELECT page_id, CASE WHEN path = '' THEN 'empty' WHEN contains(path, '..') THEN 'traversal' WHEN starts_with(path, '/') OR starts_with(path, 'C:') THEN 'absolute' END AS problem FROM p""")
def request_paths(spark, d):
    k = F.col("page_id") % 6
    path = F.when(k == 0, "").when(k == 1, "/etc/x").when(k == 2, "a/../b").when(k == 3, "C:\\x").otherwise(F.concat(F.lit("a/b"), F.col("page_id").cast("string")))
    return load(spark, d, "pages").select("page_id", V.path_problem(path).alias("problem"))


@query("""WITH s AS (SELECT l_orderkey, l_suppkey % 6 AS client, l_quantity::BIGINT % 20 AS files FROM lineitem), g AS (SELECT l_orderkey, count(*) AS rows, count(DISTINCT client) AS clients, count(*) FILTER (files = 0) AS empty FROM s GROUP BY 1),
    e AS (SELECT l_orderkey, rows, list_filter([CASE WHEN rows < 2 THEN 'too_few_clients' END, CASE WHEN rows > 6 THEN 'too_many_clients' END, CASE WHEN clients < rows THEN 'duplicate_client' END, CASE WHEN empty > 0 THEN 'empty_shard' END], lambda x: x IS NOT NULL) AS errors FROM g)
    SELECT l_orderkey, array_to_string(errors, ',') AS errors, CASE WHEN rows <> 4 THEN 'count_mismatch' ELSE '' END AS warnings, len(errors) = 0 AS accepted FROM e""")
def plan_acceptance(spark, d):
    """An order is a plan, its lines are shards."""
    shards = load(spark, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 6).alias("client"), (F.col("l_quantity").cast("bigint") % 20).alias("files"))
    out = V.plan_acceptance(shards, "l_orderkey", "client", "files", None, 6, 4)
    return out.select("l_orderkey", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"), "accepted")


@query("""WITH m AS (SELECT DISTINCT l_orderkey, CASE WHEN l_linenumber % 2 = 0 THEN 'cluster' ELSE 'client' END AS part, l_returnflag AS module FROM lineitem),
    g AS (SELECT l_orderkey, list(module) FILTER (part = 'cluster') AS a, list(module) FILTER (part = 'client') AS b FROM m GROUP BY 1)
    SELECT l_orderkey, CASE WHEN a IS NULL OR b IS NULL THEN '' ELSE array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') END AS only_cluster,
           CASE WHEN a IS NULL OR b IS NULL THEN '' ELSE array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), ',') END AS only_client FROM g""")
def module_set_check(spark, d):
    """Even lines of an order are its cluster part, odd ones its client part; flags are modules."""
    parts = load(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") % 2 == 0, "cluster").otherwise("client").alias("part"), F.col("l_returnflag").alias("module"))
    out = V.module_differences(parts, ["l_orderkey"], "part", "module")
    return out.select("l_orderkey", F.array_join("only_cluster", ",").alias("only_cluster"), F.array_join("only_client", ",").alias("only_client"))


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), n AS (SELECT *, round_even(sqrt(list_dot_product(e, e)), 6) * CASE WHEN vec_id % 50 = 3 THEN 400 WHEN vec_id % 50 = 4 THEN 90 ELSE 1 END AS norm, len(e) * 4 * (1 + vec_id % 5) AS bytes FROM v)
    SELECT vec_id, array_to_string(list_filter([CASE WHEN label * 2 > 16 THEN 'rank_cap' END, CASE WHEN vec_id % 31 = 1 THEN 'nan' END, CASE WHEN vec_id % 37 = 2 THEN 'inf' END,
        CASE WHEN norm > 100 THEN 'norm_error' WHEN norm > 80 THEN 'norm_warning' END, CASE WHEN bytes > 1100 THEN 'too_many_bytes' END], lambda x: x IS NOT NULL), ',') AS problems FROM n""")
def adapter_integrity(spark, d):
    """Vectors as adapters, some with a NaN, an infinite value, a large norm or many bytes."""
    i = F.col("vec_id")
    e = F.transform("embedding", lambda x: x.cast("double"))
    extra = F.array_compact(F.array(F.when(i % 31 == 1, F.lit(float("nan"))), F.when(i % 37 == 2, F.lit(float("-inf")))))
    norm = F.bround(F.sqrt(M.dot(e, e)), 6) * F.when(i % 50 == 3, 400).when(i % 50 == 4, 90).otherwise(1)
    found = V.integrity_problems(F.concat(e, extra), norm, F.col("label") * 2, F.size(e) * 4 * (1 + i % 5), 1100)
    return load(spark, d, "embeddings").select("vec_id", F.array_join(found, ",").alias("problems"))


@query("""SELECT project, count(*) AS n, count(DISTINCT path) AS paths, min(sha256(content)) AS least FROM (
    SELECT 'demo' AS project, 'pkg' || (i % 7) || '/m' || i || '.py' AS path, string_agg('value_' || left(sha256('demo|' || i || '|' || j), 8) || ' = ' || j, chr(10) ORDER BY j) || chr(10) AS content
    FROM range(0, 200) t(i), range(1, 21) s(j) GROUP BY i) GROUP BY 1""")
def synthetic_corpus(spark, d):
    """Files of a made-up project; the same on every run."""
    files = S.synthetic_files(spark, 200, "demo")
    return files.groupBy("project").agg(F.count("*").alias("n"), F.countDistinct("path").alias("paths"), F.min(X.sha256(F.col("content"))).alias("least"))
