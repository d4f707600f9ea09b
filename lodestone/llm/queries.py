"""Registered queries of the training-data operators, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import decontaminate, embeddings, exact_dedup, langid, lexical, lm_score, packing, periodic, quality, simhash, substrings, token_rollup, url_filter
from lodestone.llm.common import held_out, load, materialised, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Where the public vocabularies lie on the driver.
TOKENIZERS = "/opt/tokenizers"


@query()
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger's whole life over all documents, whose texts are read and counted once, under both tokenizer versions:
    inserted, revised (moved to another source) and revised back, deleted, inserted again, and recounted from the first
    version to the second. Each batch is committed and replayed, and the ledger compacted in between. What the first
    version counted adds up to nothing."""
    old, new = (token_rollup.Tokenizer(TOKENIZERS, v) for v in ("byte_bpe_multi_50k", "byte_bpe_50k"))
    ledger = token_rollup.Ledger(spark, scratch_path(spark, "ledger"))
    counted = materialised(token_rollup.count_versions(load(spark, sf_dir, "documents"), [old, new], ["source", "lang"]), "counts")
    what = ("n_chars", "n_tokens")
    here = {"source": F.col("source"), "lang": F.col("lang")} | {c: F.col(c) for c in what}
    moved = here | {"source": F.concat(F.lit("moved/"), "source")}

    def change(op: str, before: dict, after: dict) -> DataFrame:
        rows = counted.select(F.lit(op).alias("op"), *(c.alias(n) for n, c in after.items()), *(c.alias(f"old_{n}") for n, c in before.items()))
        return token_rollup.summed(token_rollup.signed_rows(rows, what), {old.version: F.lit(1), new.version: F.lit(0)})

    recount = token_rollup.summed(counted.withColumn("sign", F.lit(1)), {old.version: F.lit(-1), new.version: F.lit(1)})
    batches = {"insert": change("insert", here, here), "move": change("revise", here, moved), "back": change("revise", moved, here), "delete": change("delete", here, here), "again": change("insert", here, here), "recount": recount}
    for batch, rows in batches.items():
        for _ in range(2):  # the replay finds the batch committed
            ledger.commit(batch, rows)
        if batch in ("back", "recount"):
            ledger.compact()
    return ledger.totals()


@query()
def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


@query(r"""
    SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
           doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
    FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
""")
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(load(spark, sf_dir, "documents"))


@query(r"""
    WITH cut AS (
        SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
    ), parts AS (
        SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
    ), rules AS (
        SELECT * FROM (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'),
                              ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')) AS t(rhost, rpath, rverdict)
    ), fits AS (
        SELECT page_id, host, path, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(rverdict, length(rhost || rpath)) AS rverdict
        FROM parts LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
        GROUP BY page_id, host, path
    )
    SELECT page_id, host, path, rule, coalesce(rverdict, CASE WHEN regexp_matches(host,
        '(^|\.)((cheap|buy|online)-pills|spam-[a-z0-9-]+|adult(-[a-z0-9-]+)?|casino(-[a-z0-9-]+)?|([a-z0-9-]+-)?bets|ads(-[a-z0-9-]+)?)\.')
        THEN 'block' ELSE 'allow' END) AS verdict
    FROM fits
""")
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(load(spark, sf_dir, "pages")).drop("by")


@query()
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = quality.train(docs, load(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query()
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query()
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), token_rollup.Tokenizer(TOKENIZERS, "byte_bpe_50k"))


@query(r"""
    WITH d AS (
        SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
    ), b AS (
        SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                          '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
    ), windows AS (
        SELECT DISTINCT item_id, least(10, len(w)) AS n, list_slice(w, i, i + least(10, len(w)) - 1) AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)
    ), sizes AS (SELECT DISTINCT n FROM windows),
    places AS (
        SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS g
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
    ), met AS (SELECT p.doc_id, p.i, p.n, x.item_id FROM places p JOIN windows x ON p.n = x.n AND p.g = x.g),
    hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM met) GROUP BY doc_id),
    found AS (
        SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM met) GROUP BY doc_id
    )
    SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)
""")
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query(corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


@query(r"""
    WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    places AS (
        SELECT doc_id, i, list_slice(w, i, i + 12) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
    ), owned AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS owner FROM places),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS pos FROM owned WHERE owner < doc_id),
    lists AS (SELECT doc_id, count(*) AS n, list(pos) AS p FROM gone GROUP BY doc_id),
    kept AS (
        SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t FROM (
            SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d) AS x
        WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = x.doc_id AND gone.pos = x.pos) GROUP BY doc_id
    )
    SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM d LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)
""")
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(load(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query()
def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigrams that occur once are no evidence: counts hold the scored texts themselves."""
    return lm_score.scores(load(spark, sf_dir, "documents"), min_count=2)


@query()
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, after loops are planted by the rule of its id, and the text without repetitions."""
    found = periodic.collapse_runs(periodic.with_loops(load(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    best = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), longest.alias("best"), lines.alias("lines"), "collapsed")
    return best.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), "best.length", (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query(r"""
    WITH split AS (
        SELECT 'd' AS kind, doc_id AS id, text, row_number() OVER () AS r FROM documents
        UNION ALL SELECT 'q', item_id, text, row_number() OVER () FROM benchmark
    ), lists AS (
        SELECT kind, id, r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                              '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM split
    ), counts AS (
        SELECT kind, id, r, n, term, count(*) AS tf FROM (SELECT kind, id, r, len(w) AS n, unnest(w) AS term FROM lists) GROUP BY kind, id, r, n, term
    ), totals AS (
        SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM lists WHERE kind = 'd' AND len(w) > 0
    ), weights AS (
        SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS weight
        FROM (SELECT term, count(*) AS df FROM counts WHERE kind = 'd' GROUP BY term), totals
    ), scores AS (
        SELECT q.id AS item_id, q.r AS item, d.id AS doc_id, CAST(sum(q.tf * weight * ((1000000000 * d.tf) // (1000 * d.tf + 12 * (75 + (25 * d.n * n_docs) // n_terms)))) AS BIGINT) AS score
        FROM counts AS q JOIN counts AS d ON q.term = d.term AND q.kind = 'q' AND d.kind = 'd' JOIN weights ON weights.term = q.term, totals
        GROUP BY q.id, q.r, d.id, d.r
    )
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
    FROM scores WHERE score > 0 QUALIFY rank <= 20
""")
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(materialised(lexical.build_index(load(spark, sf_dir, "documents")), "index"), load(spark, sf_dir, "benchmark"))


@query(r"""
    WITH RECURSIVE v AS (
        SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
        WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ), links AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93
    ), reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
    SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
    FROM embeddings JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) ON a = vec_id LEFT JOIN (SELECT a AS l, count(*) AS n FROM links GROUP BY a) ON l = vec_id
""")
def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(load(spark, sf_dir, "embeddings"))
