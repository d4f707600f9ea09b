"""Queries over ``documents`` as a corpus of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import balance as B
from lodestone.operators import corpus as C
from lodestone.operators import scoring as S
from lodestone.operators.compose import checked_lookup
from lodestone.plans.registry import query
from lodestone.sources.tables import load

SEED = 20260616


def files(spark: SparkSession, d: str) -> DataFrame:
    """``documents`` as corpus records."""
    docs = load(spark, d, "documents").select(
        F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("file_id"), F.col("source").alias("cluster_id"), F.col("lang").alias("language"),
        F.concat("lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.col("text").alias("content"), "doc_id",
    )
    return C.with_text_columns(docs)


FILES = r"""
    lined AS (
        SELECT lpad(CAST(doc_id AS VARCHAR), 9, '0') AS file_id, source AS cluster_id, lang AS language, doc_id,
               lang || '/' || source || '/' || doc_id || '.py' AS path, regexp_replace(text, '\r\n?', chr(10), 'g') AS content FROM documents
    ), files AS (
        SELECT *, CASE WHEN content = '' THEN 0 ELSE length(content) - length(replace(content, chr(10), '')) + CASE WHEN ends_with(content, chr(10)) THEN 0 ELSE 1 END END AS num_lines,
               len(list_filter(string_split(content, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '' AND NOT starts_with(trim(x, ' ' || chr(9) || chr(13)), '#'))) AS num_code_lines,
               octet_length(encode(content)) AS num_bytes, sha256(content) AS content_sha256 FROM lined
    )
"""
EXCLUDE = ["**/src3/**", "es/*/1*.py"]
JUDGED = FILES + r""", early AS (
        SELECT *, CASE WHEN cluster_id = 'src3' OR regexp_matches(path, '^es/[^/]*/1[^/]*\.py$') THEN 'excluded_glob' WHEN num_bytes = 0 THEN 'empty'
                       WHEN num_bytes > 20000 THEN 'too_large' WHEN num_code_lines < 3 THEN 'too_few_code_lines' END AS r0 FROM files
    ), judged AS (
        SELECT *, CASE WHEN r0 IS NOT NULL THEN r0 WHEN row_number() OVER (PARTITION BY r0 IS NULL, content_sha256 ORDER BY cluster_id, path) > 1 AND r0 IS NULL
                       THEN 'duplicate_content' END AS reason FROM early
    )
"""


def judged(spark, d):
    return C.filter_reasons(files(spark, d), EXCLUDE, ["cluster_id", "path"], min_code_lines=3, max_bytes=20_000)


@query(f"WITH {JUDGED} SELECT reason, cluster_id, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY GROUPING SETS ((reason, cluster_id), (reason))")
def corpus_filter_reasons(spark, d):
    return C.reason_counts(judged(spark, d), "cluster_id")


@query(f"WITH {FILES} SELECT content_sha256, arg_min(path, (cluster_id, path)) AS path, count(*) AS copies FROM files GROUP BY content_sha256")
def corpus_dedup_first_seen(spark, d):
    f = files(spark, d)
    kept = C.first_seen(f.select("content_sha256", "cluster_id", "path"), "content_sha256", ["cluster_id", "path"])
    return kept.join(f.groupBy("content_sha256").agg(F.count("*").alias("copies")), "content_sha256").select("content_sha256", "path", "copies")


@query(f"""WITH {JUDGED} SELECT cluster_id, count(*) AS num_files, sum(num_lines)::BIGINT AS num_lines, sum(num_code_lines)::BIGINT AS num_code_lines, sum(num_bytes)::BIGINT AS total_bytes
           FROM judged WHERE reason IS NULL GROUP BY cluster_id""")
def corpus_shard_rollup(spark, d):
    return C.roll_up(judged(spark, d).where("reason IS NULL"), ["cluster_id"])


@query("""WITH s AS (SELECT source AS c, count(*)::DOUBLE AS x FROM documents GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY x, c) AS i FROM s)
    SELECT count(*) AS num_shards, min(x)::BIGINT AS min_files, max(x)::BIGINT AS max_files, round_even(avg(x), 4) AS mean_files, median(x) AS median_files,
           round_even(max(x) / min(x), 6) AS imbalance_ratio, round_even(2.0 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1.0) / count(*), 6) AS gini,
           round_even(stddev_pop(x) / avg(x), 6) AS coefficient_of_variation, (SELECT c FROM s ORDER BY x, c LIMIT 1) AS min_client, (SELECT c FROM s ORDER BY x DESC, c LIMIT 1) AS max_client FROM r""")
def shard_balance(spark, d):
    return B.balance(load(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")), "source", "n")


@query(f"""WITH {FILES} SELECT cluster_id, count(*) AS num_files, sum(num_code_lines)::BIGINT AS num_code_lines, round_even(avg(num_code_lines), 3) AS mean_code_lines,
        median(num_code_lines) AS median_code_lines, max(num_code_lines) AS max_code_lines, array_to_string(list_sort(list(DISTINCT language)), ',') AS languages,
        round_even(count(*) / (SELECT count(*) FROM files), 6) AS corpus_share FROM files GROUP BY cluster_id""")
def cluster_metadata(spark, d):
    per = files(spark, d).groupBy("cluster_id").agg(
        F.count("*").alias("num_files"), F.sum("num_code_lines").alias("num_code_lines"), F.bround(F.avg("num_code_lines"), 3).alias("mean_code_lines"),
        F.median("num_code_lines").alias("median_code_lines"), F.max("num_code_lines").alias("max_code_lines"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"),
    )
    whole = per.agg(F.sum("num_files").alias("_all"))
    return per.join(F.broadcast(whole)).withColumn("corpus_share", F.bround(F.col("num_files") / F.col("_all"), 6)).drop("_all")


@query("""WITH g AS (SELECT sha256(text) AS content_sha256, min(source) AS owner, count(DISTINCT source) AS n_shards FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1)
    SELECT content_sha256, owner, n_shards, count(*) AS n_leaks FROM documents JOIN g ON sha256(text) = content_sha256 WHERE source <> owner GROUP BY 1, 2, 3""")
def shard_content_leaks(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "source", X.sha256(F.col("text")).alias("content_sha256"))
    return B.content_leaks(docs, "content_sha256", "source")


@query("""SELECT doc_id, 'unassigned' AS problem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT DISTINCT doc_id, 'unknown' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def coverage_antijoin(spark, d):
    return B.coverage(load(spark, d, "documents"), load(spark, d, "labels"), "doc_id")


@query("""WITH m AS (SELECT doc_id, n_chars FROM documents WHERE doc_id % 7 <> 0), a AS (SELECT doc_id, CASE WHEN toxic = 1 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents JOIN labels USING (doc_id))
    SELECT coalesce(m.doc_id, a.doc_id) AS doc_id, m.n_chars AS expected, a.n_chars AS found, CASE WHEN a.doc_id IS NULL THEN 'missing' WHEN m.doc_id IS NULL THEN 'extra' ELSE 'changed' END AS status
    FROM m FULL JOIN a ON m.doc_id = a.doc_id WHERE a.doc_id IS NULL OR m.doc_id IS NULL OR m.n_chars <> a.n_chars""")
def manifest_full_outer(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "n_chars")
    manifest = docs.where("doc_id % 7 <> 0")  # the manifest lacks every seventh file: the case under test
    actual = docs.join(load(spark, d, "labels").select("doc_id", "toxic"), "doc_id").select("doc_id", (F.col("n_chars") + F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("n_chars"))
    return B.compare_manifest(manifest, actual, "doc_id", "n_chars")


@query("""WITH r AS (SELECT source AS cluster_id, 'c' || (doc_id % 3) || '/' || CASE WHEN doc_id % 50 = 0 THEN 'src0' ELSE source END AS shard, CASE WHEN doc_id % 50 = 0 THEN 'src0' ELSE source END AS sc FROM documents),
    p AS (SELECT shard, sc, avg((cluster_id = sc)::INT) AS p FROM r GROUP BY 1, 2) SELECT sc AS shard_cluster, round_even(avg(p), 6) AS purity, count(*) AS n_shards FROM p GROUP BY 1""")
def purity(spark, d):
    sc = F.when(F.col("doc_id") % 50 == 0, "src0").otherwise(F.col("source"))
    rows = load(spark, d, "documents").select("source", sc.alias("shard_cluster"), F.concat(F.lit("c"), (F.col("doc_id") % 3).cast("string"), F.lit("/"), sc).alias("shard"))
    return B.purity(rows, "shard", "shard_cluster", "source")


HASHED = f"sha256('{SEED}:' || source || ':' || doc_id)"


@query(f"""SELECT doc_id, source, CAST((row_number() OVER (PARTITION BY source ORDER BY {HASHED}, doc_id) - 1) % greatest(1, count(*) OVER (PARTITION BY source) // 6) AS INT) AS chunk FROM documents""")
def hash_chunk_split(spark, d):
    return C.hash_chunks(load(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", SEED, 6)


@query(f"""SELECT doc_id, source, CASE WHEN n >= 2 THEN i <= greatest(1, least(CAST(round_even(n * 0.1, 0) AS INT), n - 1)) END AS held_out
    FROM (SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY {HASHED}, doc_id) AS i FROM documents)""")
def holdout_split(spark, d):
    return C.holdout(load(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", SEED, 0.1)


@query(f"""WITH b AS (SELECT doc_id, source, lang || '/' || source AS module, CAST((row_number() OVER (PARTITION BY source ORDER BY {HASHED}, doc_id) - 1) % greatest(1, count(*) OVER (PARTITION BY source) // 6) AS INT) AS chunk FROM documents),
    m AS (SELECT source, count(*) >= 2 AND min(n) >= 4 AS ok FROM (SELECT source, module, count(*) AS n FROM b GROUP BY 1, 2) GROUP BY 1),
    c AS (SELECT source, count(*) >= 2 AND min(n) >= 4 AS ok FROM (SELECT source, chunk, count(*) AS n FROM b GROUP BY 1, 2) GROUP BY 1),
    j AS (SELECT doc_id, b.source, CASE WHEN m.ok THEN 'module_path' WHEN c.ok THEN 'deterministic_hash_chunk' ELSE 'single_developer_whole_project' END AS basis,
                 CASE WHEN m.ok THEN module WHEN c.ok THEN lpad(CAST(chunk AS VARCHAR), 12, '0') ELSE '' END AS part FROM b JOIN m ON b.source = m.source JOIN c ON b.source = c.source)
    SELECT doc_id, source, basis, CAST(dense_rank() OVER (PARTITION BY source ORDER BY part) - 1 AS INT) AS dev_index FROM j""")
def module_group_fallback(spark, d):
    rows = load(spark, d, "documents").select("doc_id", "source", F.concat("lang", F.lit("/"), "source", F.lit("/x.py")).alias("path"))
    return C.developers(rows, "source", "doc_id", "path", SEED, 6, 4).select("doc_id", "source", "basis", "dev_index")


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents), n AS (SELECT doc_id, CASE WHEN w[-1] = '' THEN w[:-2] ELSE w END AS w FROM l),
    x AS (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM n), u AS (SELECT doc_id, w, i, w[i + 1] AS target FROM x WHERE i >= 3),
    v AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS s FROM u WHERE length(trim(target, ' ' || chr(9))) >= 4 AND NOT starts_with(trim(target, ' ' || chr(9)), '#')),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS q FROM v WHERE s % 7 = 0)
    SELECT doc_id AS file, CAST(i AS INT) AS line_no, sha256(array_to_string(w[:i], chr(10)) || chr(10)) AS prompt_sha256, target FROM k WHERE q <= 4""")
def next_line_examples(spark, d):
    out = C.next_line_examples(load(spark, d, "documents"), "doc_id", "text", per_file=4)
    return out.select("file", "line_no", X.sha256(F.col("prompt")).alias("prompt_sha256"), "target")


FIRST = 250


@query(f"""WITH f AS (SELECT source || '/' || lang || '/' || doc_id AS file, string_split(text, chr(10)) AS w FROM documents), n AS (SELECT file, CASE WHEN w[-1] = '' THEN w[:-2] ELSE w END AS w FROM f),
    x AS (SELECT file, w, unnest(range(0, len(w))) AS i FROM n), u AS (SELECT file, w, i, w[i + 1] AS target FROM x WHERE i >= 3),
    v AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY i) - 1 AS s FROM u WHERE length(trim(target, ' ' || chr(9))) >= 4 AND NOT starts_with(trim(target, ' ' || chr(9)), '#')),
    k AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY i) AS q FROM v WHERE s % 7 = 0),
    m AS (SELECT *, row_number() OVER (ORDER BY string_split(file, '/'), i) AS place FROM k WHERE q <= 2 * ceil({FIRST}.0 / (SELECT count(*) FROM documents)))
    SELECT file, CAST(i AS INT) AS line_no, sha256(array_to_string(w[:i], chr(10)) || chr(10)) AS prompt_sha256, target FROM m WHERE place <= {FIRST}""")
def first_examples(spark, d):
    """The first examples over all files in path order: a limit over the concatenation, with a quota a file."""
    files = load(spark, d, "documents").select(F.concat_ws("/", "source", "lang", "doc_id").alias("file"), "text")
    out = C.first_examples(files, "file", "text", FIRST)
    return out.select("file", "line_no", X.sha256(F.col("prompt")).alias("prompt_sha256"), "target")


@query("""SELECT source, count(*) AS num_files, sha256(string_agg(lpad(CAST(doc_id AS VARCHAR), 9, '0') || chr(0) || sha256(text) || chr(10), '' ORDER BY doc_id)) AS shard_sha256 FROM documents GROUP BY source""")
def shard_digest(spark, d):
    rows = load(spark, d, "documents").select("source", F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("k"), X.sha256(F.col("text")).alias("h"))
    return C.ordered_digest(rows, "source", "k", "h")


@query("""WITH t AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM documents),
    n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, line_no) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM t)
    SELECT source, i // 16 AS block, count(*) AS n_tokens, sum(length(line))::BIGINT AS n_chars FROM n WHERE (i // 16 + 1) * 16 <= n GROUP BY 1, 2""")
def fixed_chunks(spark, d):
    texts = load(spark, d, "documents").select("source", "doc_id", F.split("text", "\n").alias("lines"))
    chunks = C.fixed_chunks(texts, "source", "doc_id", "lines", 16, keep_tail=False)
    return chunks.groupBy("source", "block").agg(F.count("*").alias("n_tokens"), F.sum(F.length("token")).alias("n_chars"))


@query("""WITH c AS (SELECT source, sum(n_chars) // 1024 AS n FROM documents GROUP BY 1), w AS (SELECT *, 1200.0::DOUBLE * sqrt(n) / (SELECT sum(sqrt(n)) FROM c) AS raw FROM c),
    b AS (SELECT source, n, greatest(CAST(round_even(least(raw, greatest(n * 3.0::DOUBLE, 20.0::DOUBLE)), 0) AS BIGINT), least(20, n)) AS chunk_budget FROM w)
    SELECT source, CAST(n AS BIGINT) AS n_chunks, CAST(chunk_budget AS BIGINT) AS chunk_budget, round_even(chunk_budget / n, 3) AS epochs FROM b""")
def budget_allocation(spark, d):
    counts = load(spark, d, "documents").groupBy("source").agg(F.floor(F.sum("n_chars") / 1024).cast("bigint").alias("n_chunks"))
    return C.budgets(counts, "n_chunks", 1200)


@query("""WITH s AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) SELECT lang AS basis, count(*) AS n_groups, min(n) AS min_size, round_even(avg(n), 4) AS mean_size, max(n) AS max_size FROM s GROUP BY 1""")
def basis_breakdown(spark, d):
    sizes = load(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return sizes.groupBy(F.col("lang").alias("basis")).agg(F.count("*").alias("n_groups"), F.min("n").alias("min_size"), F.bround(F.avg("n"), 4).alias("mean_size"), F.max("n").alias("max_size"))


@query("""SELECT source, CAST(NULL AS VARCHAR) AS content, printf('%d files, %.1f%% of %d', count(*), 100.0 * count(*) / (SELECT count(*) FROM documents), (SELECT count(*) FROM documents)) AS headline,
    CASE WHEN count(*) FILTER (lang = 'es') = 0 THEN 'N/A' ELSE printf('%.1f%%', 100.0 * count(*) FILTER (lang = 'es') / count(*)) END AS es_share,
    CASE WHEN source = 'src0' THEN 'DP off' ELSE printf('epsilon=%.2f delta=1e-05', count(*) / 7.0) END AS privacy FROM documents GROUP BY source""")
def masked_summary(spark, d):
    per = load(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "es").alias("es"))
    whole = per.agg(F.sum("n").alias("all"))
    epsilon = F.when(F.col("source") != "src0", F.col("n") / 7.0)
    headline = F.format_string("%d files, %s of %d", "n", X.percent(F.col("n"), F.col("all")), "all")
    return per.join(F.broadcast(whole)).select("source", F.lit(None).cast("string").alias("content"), headline.alias("headline"), X.percent(F.col("es"), F.col("n")).alias("es_share"), X.privacy_label(epsilon).alias("privacy"))


@query("""WITH j AS (SELECT l.doc_id, d.source, l.quality FROM labels l JOIN documents d USING (doc_id)),
    bad AS (SELECT count(*) AS n FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))
    SELECT source, count(*) AS n_tasks, sum(quality)::BIGINT AS n_solved, round_even(avg(quality), 4) AS pass_at_1, (SELECT n FROM bad) AS unknown_ids FROM j GROUP BY 1""")
def fk_checked_scores(spark, d):
    labels, docs = load(spark, d, "labels"), load(spark, d, "documents").select("doc_id", "source")
    unknown = labels.join(docs, "doc_id", "left_anti").agg(F.count("*").alias("unknown_ids"))
    per = labels.join(docs, "doc_id").groupBy("source").agg(F.count("*").alias("n_tasks"), F.sum("quality").alias("n_solved"), F.bround(F.avg("quality"), 4).alias("pass_at_1"))
    return per.join(F.broadcast(unknown))


@query(f"""WITH {JUDGED} SELECT cluster_id, count(*) AS discovered, count(*) FILTER (reason IS NULL) AS kept, count(*) FILTER (reason IS NOT NULL) AS skipped, CAST(coalesce(sum(num_bytes) FILTER (reason IS NULL), 0) AS BIGINT) AS kept_bytes FROM judged GROUP BY 1""")
def source_stats(spark, d):
    """What was found and what was kept of each source."""
    kept = F.col("reason").isNull()
    return judged(spark, d).groupBy("cluster_id").agg(
        F.count("*").alias("discovered"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("skipped"), F.coalesce(F.sum(F.when(kept, F.col("num_bytes"))), F.lit(0)).cast("bigint").alias("kept_bytes")
    )


@query("""SELECT doc_id % 301 AS file_id, count(DISTINCT source) AS n_shards FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1""")
def id_collisions(spark, d):
    return B.id_collisions(load(spark, d, "documents").select((F.col("doc_id") % 301).alias("file_id"), "source"), "file_id", "source")


@query("""WITH r AS (SELECT * FROM labels WHERE doc_id % 9 <> 0), f AS (SELECT doc_id FROM labels WHERE doc_id % 10 <> 0)
    SELECT count(r.doc_id) AS n_tasks, count(*) FILTER (quality = 1) AS n_solved, round_even(avg(quality), 6) AS base_pass, round_even(avg(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END), 6) AS plus_pass,
           (SELECT count(*) FROM f WHERE doc_id NOT IN (SELECT doc_id FROM r)) AS missing, (SELECT count(*) FROM r WHERE doc_id NOT IN (SELECT doc_id FROM f)) AS extra,
           sha256(string_agg(CAST(r.doc_id AS VARCHAR), ',' ORDER BY r.doc_id) FILTER (quality = 1)) AS anchor_sha256 FROM r""")
def anchor_scores(spark, d):
    """A run's results against a frozen subset of tasks: pass rates of the plain and the extended tests, tasks on
    one side only, and the digest of the solved ids in order."""
    labels = load(spark, d, "labels")
    return S.anchor(labels.where("doc_id % 9 <> 0").select("doc_id", (F.col("quality") == 1).alias("base"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("plus")), labels.where("doc_id % 10 <> 0").select("doc_id"), "doc_id")


@query("""WITH t AS (SELECT 'suite-' || doc_id % 3 || '/' || (doc_id % 40) AS task, doc_id, n_chars % 3 = 0 AS passed FROM documents), p AS (SELECT task, count(*) AS n, count(*) FILTER (passed) AS c FROM t GROUP BY 1)
    SELECT row_number() OVER (ORDER BY CAST(string_split(task, '/')[2] AS BIGINT), task) - 1 AS place, task, n AS n_samples, c AS n_passed, round_even(c / n, 9) AS pass_at_1, c > 0 AS solved FROM p""")
def anchor_tasks(spark, d):
    """Every task of an anchor in its order, with the samples it was scored on."""
    task = F.concat(F.lit("suite-"), F.col("doc_id") % 3, F.lit("/"), F.col("doc_id") % 40)
    t = load(spark, d, "documents").select(task.alias("task"), (F.col("n_chars") % 3 == 0).alias("passed"))
    return S.anchor_tasks(t, t.select("task").distinct(), "task", "passed")


@query("""SELECT d.source, count(*) AS n_tasks, sum(quality)::BIGINT AS n_solved, round_even(avg(quality), 4) AS pass_at_1 FROM labels l JOIN documents d USING (doc_id) GROUP BY 1""")
def checked_scores(spark, d):
    """The same where every label must have its document: an unknown id would end the query with an error."""
    met = checked_lookup(load(spark, d, "labels"), load(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return met.groupBy("source").agg(F.count("*").alias("n_tasks"), F.sum("quality").alias("n_solved"), F.bround(F.avg("quality"), 4).alias("pass_at_1"), F.count("doc_id").alias("_n")).drop("_n")
