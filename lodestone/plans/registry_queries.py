"""Queries over ``orders`` and ``lineitem`` as versions, decisions and provenance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import asof
from lodestone.operators import compose as P
from lodestone.operators import registry_rules as G
from lodestone.operators import validators as V
from lodestone.operators.ordering import text_digest
from lodestone.plans.registry import query
from lodestone.sources.tables import load

VER = """ver AS (SELECT o_orderkey, o_custkey AS name, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS version, o_orderstatus AS st, o_totalprice AS price, o_orderdate AS ts FROM orders)"""


def versions(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return load(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("name"), F.row_number().over(w).alias("version"), F.col("o_orderstatus").alias("st"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("ts"))


@query(f"""WITH {VER}, act AS (SELECT name, max(version) FILTER (st <> 'P') AS active FROM ver GROUP BY 1),
    pro AS (SELECT DISTINCT name, version FROM ver WHERE st = 'F' AND price > 200000), res AS (SELECT DISTINCT name, version - 1 AS version FROM ver WHERE st = 'P' AND version > 1), cmp AS (SELECT DISTINCT name, version FROM ver WHERE o_orderkey % 40 = 0)
    SELECT ver.name, ver.version, array_to_string(list_filter([CASE WHEN ver.version = active THEN 'active' END, CASE WHEN row_number() OVER (PARTITION BY ver.name ORDER BY ver.version DESC) <= 5 THEN 'recent' END, CASE WHEN pro.version IS NOT NULL THEN 'promoted' END,
           CASE WHEN res.version IS NOT NULL THEN 'restored' END, CASE WHEN cmp.version IS NOT NULL THEN 'composite' END], lambda x: x IS NOT NULL), ',') AS reasons
    FROM ver LEFT JOIN act USING (name) LEFT JOIN pro ON ver.name = pro.name AND ver.version = pro.version LEFT JOIN res ON ver.name = res.name AND ver.version = res.version LEFT JOIN cmp ON ver.name = cmp.name AND ver.version = cmp.version""")
def retention_plan(spark, d):
    v = versions(spark, d)
    promoted = v.where("st = 'F' AND price > 200000").select("name", F.col("version").alias("active_version_after"), F.lit("promote").alias("action"))
    restored = v.where("st = 'P' AND version > 1").select("name", (F.col("version") - 1).alias("active_version_after"), F.lit("rollback").alias("action"))
    active = v.where("st <> 'P'").groupBy("name").agg(F.max("version").alias("active"))
    plan = G.retention(v.select("name", "version"), promoted.unionByName(restored), active, v.where("o_orderkey % 40 = 0"), 5)
    return plan.select("name", "version", F.array_join("reasons", ",").alias("reasons"))


@query(f"""WITH {VER} SELECT name, version, lag(version) OVER (PARTITION BY name ORDER BY version) AS previous_version, max(version) OVER (PARTITION BY name) AS latest FROM ver""")
def previous_version_asof(spark, d):
    v = versions(spark, d)
    latest = v.groupBy("name").agg(F.max("version").alias("latest"))
    return G.previous_versions(v.select("name", "version"), "name", "version").join(latest, "name")


DAYS = "CAST(date_diff('day', DATE '1970-01-01', CAST({} AS DATE)) AS INT)"


@query(f"""WITH ver AS (SELECT o_custkey AS name, {DAYS.format("o_orderdate")} AS version, max(o_orderkey) AS stored FROM orders GROUP BY 1, 2),
    probe AS (SELECT l_orderkey, l_linenumber, o_custkey AS name, {DAYS.format("l_shipdate")} AS version FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT l_orderkey, l_linenumber, probe.version AS asked, ver.version AS previous_version, ver.stored FROM probe ASOF LEFT JOIN ver ON probe.name = ver.name AND probe.version > ver.version""")
def asof_previous(spark, d):
    """The last version that a customer had before each day of shipping: the days are versions that mostly aren't stored."""
    day = lambda c: F.unix_date(F.to_date(c))
    orders = load(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("name"), day("o_orderdate").alias("version"))
    stored = orders.select("name", "version", F.col("o_orderkey").alias("stored"))
    probes = load(spark, d, "lineitem").join(orders.select("o_orderkey", "name"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "name", day("l_shipdate").alias("version"))
    out = asof.as_of(probes, stored, ["name"], "version", lambda at: F.floor(at / 64))
    return out.select("l_orderkey", "l_linenumber", F.col("version").alias("asked"), F.col("found.version").alias("previous_version"), F.col("found.stored").alias("stored"))


@query(f"""WITH {VER} SELECT name, max_by(CASE WHEN st = 'P' THEN greatest(version - 1, 1) ELSE version END, version) AS active_version, max(version) AS as_of, arg_max(o_orderkey, ts) FILTER (price > 100000) IS NOT NULL AS measured FROM ver GROUP BY 1""")
def active_pointer(spark, d):
    v = versions(spark, d).withColumn("target", F.when(F.col("st") == "P", F.greatest(F.col("version") - 1, F.lit(1))).otherwise(F.col("version")))
    measured = v.groupBy("name").agg((F.count_if(F.col("price") > 100000) > 0).alias("measured"))
    return G.active_pointers(v, "name", "target", "version").join(measured, "name")


@query(f"""WITH {VER} SELECT name, version, CASE WHEN to_version < version THEN 'rollback' ELSE 'promote' END AS action,
    'operator restore v' || version || ' -> v' || to_version || CASE WHEN to_version < version THEN '' ELSE ' — not a D5 decision' END AS reason
    FROM (SELECT name, version, CAST(greatest(1, version + (o_orderkey % 5) - 2) AS BIGINT) AS to_version FROM ver)""")
def restore_log(spark, d):
    v = versions(spark, d).withColumn("to_version", F.greatest(F.lit(1), F.col("version") + (F.col("o_orderkey") % 5) - 2))
    back = F.col("to_version") < F.col("version")
    reason = F.concat(F.lit("operator restore v"), F.col("version").cast("string"), F.lit(" -> v"), F.col("to_version").cast("string"), F.when(back, "").otherwise(" — not a D5 decision"))
    return v.select("name", "version", G.restore_action(F.col("version"), F.col("to_version")).alias("action"), reason.alias("reason"))


EDGE = """e AS (SELECT 'part:' || l_partkey AS source, 'order:' || l_orderkey AS target, 'aggregated_into' AS kind FROM lineitem UNION SELECT 'supplier:' || l_suppkey, 'part:' || l_partkey, 'trained_on' FROM lineitem)"""


def named(kind, c):
    """The name of a node; edges are told apart and moved by their keys, which name the same nodes."""
    return F.concat(F.lit(kind + ":"), c.cast("string"))


@query(f"""WITH {EDGE} SELECT target, kind, count(*) AS n_parents, min(source) AS first_parent, sha256(string_agg(source, ',' ORDER BY source)) AS parents_sha256 FROM e GROUP BY 1, 2""")
def lineage_graph(spark, d):
    """Parents of every node: how many, the first, and the digest of all in order; a node may have any number of them."""
    li = load(spark, d, "lineitem")

    def parents(source: str, source_kind: str, target: str, target_kind: str, kind: str):
        found = text_digest(li.select(target, source), [target], source, ",", text=lambda v: named(source_kind, v), distinct=True)
        return found.select(named(target_kind, F.col(target)).alias("target"), F.lit(kind).alias("kind"), F.col("n").alias("n_parents"), F.col("first").alias("first_parent"), F.col("digest").alias("parents_sha256"))

    return parents("l_partkey", "part", "l_orderkey", "order", "aggregated_into").unionByName(parents("l_suppkey", "supplier", "l_partkey", "part", "trained_on"))


@query("""WITH n AS (SELECT l_partkey AS id, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS flag, CASE WHEN l_quantity > 25 THEN l_quantity END AS qty FROM lineitem)
    SELECT id, max_by(flag, seq) FILTER (flag IS NOT NULL) AS flag, max_by(qty, seq) FILTER (qty IS NOT NULL) AS qty FROM n GROUP BY 1""")
def lineage_nodes(spark, d):
    n = load(spark, d, "lineitem").select(
        F.col("l_partkey").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"), F.when(F.col("l_quantity") > 25, F.col("l_quantity")).alias("qty")
    )
    return G.merged_nodes(n, "id", "seq", ["flag", "qty"])


@query(f"""WITH {EDGE} SELECT c.target AS node, count(DISTINCT p.source) AS n_grandparents, count(*) AS n_paths FROM e p JOIN e c ON p.target = c.source WHERE p.kind = 'trained_on' GROUP BY 1""")
def graph_parents(spark, d):
    """Suppliers are the grandparents of orders, over parts."""
    li = load(spark, d, "lineitem")
    found = G.grandparents(li.select(F.col("l_suppkey").alias("grandparent"), F.col("l_partkey").alias("mid")), li.select(F.col("l_partkey").alias("mid"), F.col("l_orderkey").alias("node")))
    return found.select(named("order", F.col("node")).alias("node"), "n_grandparents", "n_paths")


COMP = """comp AS (SELECT l_orderkey AS name, l_linenumber AS version, l_partkey % 50 AS cn, CAST(l_linenumber % 3 AS INT) AS cv, l_suppkey % 50 + 100 AS ln, CAST(l_quantity::INT % 4 AS INT) AS lv FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) = 1)"""


@query(f"""WITH {COMP}, act AS (SELECT * FROM comp QUALIFY row_number() OVER (PARTITION BY name ORDER BY version DESC) = 1),
    mv AS (SELECT i AS part, 1 AS before, 2 AS after FROM range(0, 150) t(i) WHERE i % 2 = 0),
    t AS (SELECT name, version, part, cn, CASE WHEN cn = part AND cv = before THEN after ELSE cv END AS cv, ln, CASE WHEN ln = part AND lv = before THEN after ELSE lv END AS lv FROM act JOIN mv ON cn = part AND cv = before OR ln = part AND lv = before)
    SELECT t.name, t.version AS from_version, t.part, t.cn || '.' || t.cv || '+' || t.ln || '.' || t.lv AS target, (SELECT max(c.version) FROM comp c WHERE c.name = t.name AND c.cn = t.cn AND c.cv = t.cv AND c.ln = t.ln AND c.lv = t.lv) AS reuse_version FROM t""")
def cascade_plan(spark, d):
    out, _ = cascade_steps(spark, d)
    return out.withColumn("target", provenance_text(F.col("target")))


def provenance_text(t):
    return F.concat(t["cluster_name"].cast("string"), F.lit("."), t["cluster_version"].cast("string"), F.lit("+"), t["client_name"].cast("string"), F.lit("."), t["client_version"].cast("string"))


def cascade_steps(spark, d):
    """(steps, stored composites) when every even part moves from its first to its second version."""
    prov = F.struct((F.col("l_partkey") % 50).alias("cluster_name"), (F.col("l_linenumber") % 3).cast("int").alias("cluster_version"), (F.col("l_suppkey") % 50 + 100).alias("client_name"), (F.col("l_quantity").cast("int") % 4).alias("client_version"))
    first = F.struct("l_partkey", "l_suppkey", "l_quantity")  # the table repeats some keys
    lines = load(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(first).alias("r")).select("l_orderkey", "l_linenumber", "r.*")
    comp = lines.select(F.col("l_orderkey").alias("name"), F.col("l_linenumber").alias("version"), prov.alias("prov"))
    active = comp.groupBy("name").agg(F.max_by(F.struct("version", "prov"), "version").alias("a")).select("name", "a.*")
    moves = spark.range(0, 150).where("id % 2 = 0").select(F.col("id").alias("part"), F.lit(1).alias("before"), F.lit(2).alias("after"))
    return G.cascade(active, comp, moves), comp


@query(f"""WITH {COMP}, act AS (SELECT * FROM comp QUALIFY row_number() OVER (PARTITION BY name ORDER BY version DESC) = 1),
    mv AS (SELECT i AS part, 1 AS before, 2 AS after FROM range(0, 150) t(i) WHERE i % 2 = 0),
    t AS (SELECT name, version, part, cn, CASE WHEN cn = part AND cv = before THEN after ELSE cv END AS cv, ln, CASE WHEN ln = part AND lv = before THEN after ELSE lv END AS lv FROM act JOIN mv ON cn = part AND cv = before OR ln = part AND lv = before),
    r AS (SELECT t.*, (SELECT max(c.version) FROM comp c WHERE c.name = t.name AND c.cn = t.cn AND c.cv = t.cv AND c.ln = t.ln AND c.lv = t.lv) AS reuse, (SELECT max(c.version) FROM comp c WHERE c.name = t.name) AS last FROM t),
    n AS (SELECT name, cn, cv, ln, lv, row_number() OVER (PARTITION BY name ORDER BY cn, cv, ln, lv) AS k FROM (SELECT DISTINCT name, cn, cv, ln, lv FROM r WHERE reuse IS NULL)),
    z AS (SELECT r.name, r.version AS from_version, coalesce(reuse, last + k) AS to_version, reuse IS NULL AS rebuilt, r.cn || '.' || r.cv || '+' || r.ln || '.' || r.lv AS target FROM r LEFT JOIN n ON r.name = n.name AND r.cn = n.cn AND r.cv = n.cv AND r.ln = n.ln AND r.lv = n.lv)
    SELECT *, 'promote' AS action, 'cascade v' || from_version || ' -> v' || to_version || ': part moved' AS reason FROM z""")
def cascade_apply(spark, d):
    """The log of a cascade: every composite that moves, to a version that is there or to a new one."""
    steps, stored = cascade_steps(spark, d)
    return P.apply_cascade(steps, stored, "promote", "part moved").withColumn("target", provenance_text(F.col("target")))


@query(f"""WITH {VER}, d AS (SELECT name, version - 1 AS version, o_orderkey AS seq, CASE WHEN st = 'F' THEN 'promote' ELSE 'rollback' END AS action FROM ver WHERE version > 1 AND st <> 'P'),
    a AS (SELECT name, max(version) FILTER (st = 'F') AS active FROM ver GROUP BY 1), g AS (SELECT name, version, string_agg(action || ':' || seq, ',' ORDER BY seq) AS made FROM d GROUP BY 1, 2)
    SELECT ver.name, ver.version, coalesce(ver.version = active, false) AS is_active, coalesce(made, '') AS decisions FROM ver LEFT JOIN a ON ver.name = a.name LEFT JOIN g ON ver.name = g.name AND ver.version = g.version""")
def version_history(spark, d):
    """Every version with the decisions about it, made when the next one came."""
    v = versions(spark, d)
    made = v.where("version > 1 AND st <> 'P'").select("name", (F.col("version") - 1).alias("version"), F.col("o_orderkey").alias("seq"), F.when(F.col("st") == "F", "promote").otherwise("rollback").alias("action"))
    active = v.groupBy("name").agg(F.max(F.when(F.col("st") == "F", F.col("version"))).alias("active"))
    out = P.version_history(v.select("name", "version"), made, active)
    return out.withColumn("decisions", F.array_join(F.transform("decisions", lambda x: F.concat(x["action"], F.lit(":"), x["seq"])), ","))


@query(f"""WITH {VER}, c AS (SELECT *, lag(version) OVER (PARTITION BY name ORDER BY version) AS previous_version, CASE WHEN o_orderkey % 13 <> 0 THEN floor(price / 100) / 10000.0::DOUBLE - 0.1 END AS delta, 0.05::DOUBLE AS band,
        CASE WHEN o_orderkey % 11 <> 0 THEN 0.5::DOUBLE END AS base, round_even(0.44 + (o_orderkey % 10) / 100, 2) AS cand FROM ver),
    k AS (SELECT *, coalesce(delta > band AND base - cand <= 0.02, false) AS good, CASE WHEN delta IS NULL THEN 'no baseline_in_project supplied — cannot confirm improvement' WHEN delta > band THEN printf('edit_similarity +%.4f clears noise band %.4f', delta, band) ELSE printf('edit_similarity delta %.4f does not clear noise band %.4f', delta, band) END
        || '; ' || CASE WHEN base IS NULL THEN 'HumanEval guard metrics missing on candidate or baseline' WHEN base - cand <= 0.02 THEN printf('HumanEval pass@1 drop %.4f within 0.02 tolerance', base - cand) ELSE printf('HumanEval pass@1 dropped %.4f, exceeds 0.02 tolerance', base - cand) END AS why FROM c)
    SELECT o_orderkey, CASE WHEN good THEN 'promote' WHEN previous_version IS NOT NULL THEN 'rollback' END AS action, CASE WHEN good THEN version ELSE previous_version END AS active_version_after,
           CASE WHEN good THEN 'promoted: ' || why WHEN previous_version IS NOT NULL THEN 'rolled back: ' || why ELSE 'rollback indicated (' || why || ') but there is no previous version to roll back to' END AS reason FROM k""")
def promotion_decisions(spark, d):
    """The promotion rule for every version as a candidate; first versions that fail have nothing to roll back to."""
    v = G.previous_versions(versions(spark, d), "name", "version")
    k = F.col("o_orderkey")
    c = v.select("o_orderkey", "version", "previous_version", F.when(k % 13 != 0, F.floor(F.col("price") / 100) / 10000.0 - 0.1).alias("delta"), F.lit(0.05).alias("band"), F.when(k % 11 != 0, 0.5).alias("base_guard"), F.bround(0.44 + (k % 10) / 100, 2).alias("cand_guard"))
    return P.decide(c, refuse=False).select("o_orderkey", "action", "active_version_after", "reason")


@query("""WITH r AS (SELECT o_custkey % 40 AS experiment, o_orderkey AS run, CASE o_orderstatus WHEN 'P' THEN 'running' ELSE CASE WHEN o_custkey % 40 < 20 OR o_orderkey % 50 > 0 THEN 'completed' ELSE 'failed' END END AS status FROM orders),
    e AS (SELECT experiment, count(*) AS n_runs, count(*) FILTER (status <> 'completed') AS n_unfinished, min(run) FILTER (status <> 'completed') AS first_unfinished FROM r GROUP BY 1) SELECT *, n_unfinished = 0 AS can_freeze FROM e""")
def sweep_freeze(spark, d):
    """Which experiments may be frozen: those without unfinished runs."""
    return P.freezable(sweep_runs(spark, d))


def sweep_runs(spark, d):
    o = F.col("o_orderstatus")
    done = (F.col("o_custkey") % 40 < 20) | (F.col("o_orderkey") % 50 > 0)
    return load(spark, d, "orders").select((F.col("o_custkey") % 40).alias("experiment"), F.col("o_orderkey").alias("run"), F.when(o == "P", "running").when(done, "completed").otherwise("failed").alias("status"))


@query("""WITH r AS (SELECT o_custkey % 40 AS experiment, o_orderkey AS run, CASE o_orderstatus WHEN 'P' THEN 'running' ELSE CASE WHEN o_custkey % 40 < 20 OR o_orderkey % 50 > 0 THEN 'completed' ELSE 'failed' END END AS status FROM orders),
    u AS (SELECT o_custkey % 40 AS experiment, o_orderkey + o_orderkey % 2 AS run FROM orders)
    SELECT u.experiment, u.run, CASE WHEN u.experiment % 3 = 0 THEN 'frozen' WHEN EXISTS (SELECT 1 FROM r WHERE r.experiment = u.experiment AND r.run = u.run AND status = 'completed') THEN 'completed' ELSE 'written' END AS verdict FROM u""")
def sweep_updates(spark, d):
    """Updates of runs: refused where the experiment is frozen or the run completed."""
    runs = sweep_runs(spark, d)
    updates = load(spark, d, "orders").select((F.col("o_custkey") % 40).alias("experiment"), (F.col("o_orderkey") + F.col("o_orderkey") % 2).alias("run"))
    return P.update_verdicts(runs, updates, runs.where("experiment % 3 = 0").select("experiment"))


@query("""SELECT r.r_name AS region, n.s AS seed FROM region r CROSS JOIN (SELECT DISTINCT n_nationkey % 7 AS s FROM nation) n WHERE NOT EXISTS (SELECT 1 FROM nation x JOIN region y ON x.n_regionkey = y.r_regionkey WHERE y.r_name = r.r_name AND x.n_nationkey % 7 = n.s)""")
def sweep_cross_antijoin(spark, d):
    both = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "right").select(F.col("r_name").alias("region"), (F.col("n_nationkey") % 7).alias("seed"))
    return G.sweep_points(both.where("seed IS NOT NULL"), ["region", "seed"], both.distinct())


@query("""SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size > 40 THEN 'cap' END, CASE WHEN p_size > 45 AND p_brand LIKE '%1%' THEN 'override_without_reason' END, CASE WHEN p_retailprice * p_size > 50000 THEN 'budget' END], lambda x: x IS NOT NULL), ',') AS violations FROM part""")
def sweep_caps(spark, d):
    found = V.sweep_problems(F.col("p_size"), F.col("p_brand").contains("1"), F.col("p_retailprice") * F.col("p_size"), cap=40, override=45, budget=50_000)
    return load(spark, d, "part").select("p_partkey", F.array_join(found, ",").alias("violations"))


@query("""SELECT o_orderkey, CAST(date_diff('day', TIMESTAMP '1997-01-01', o_orderdate) AS BIGINT) AS days_remaining, date_diff('day', TIMESTAMP '1997-01-01', o_orderdate) <= 30 AS needs_renewal, o_orderdate < TIMESTAMP '1997-01-01' AS expired FROM orders""")
def expiry_report(spark, d):
    left = F.date_diff(F.to_date("o_orderdate"), F.to_date(F.lit("1997-01-01"))).cast("bigint")
    return load(spark, d, "orders").select("o_orderkey", left.alias("days_remaining"), (left <= 30).alias("needs_renewal"), (F.col("o_orderdate") < F.to_timestamp_ntz(F.lit("1997-01-01 00:00:00"))).alias("expired"))


@query("""SELECT l_orderkey, l_linenumber, round_even(CASE WHEN l_linestatus = 'O' THEN l_quantity / l_linenumber ELSE l_quantity / sqrt(l_linenumber) END, 6) AS scaling FROM lineitem""")
def lora_scaling(spark, d):
    q, r = F.col("l_quantity"), F.col("l_linenumber")
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.bround(F.when(F.col("l_linestatus") == "O", q / r).otherwise(q / F.sqrt(r)), 6).alias("scaling"))


@query("""WITH g AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_returnflag) AS flags, count(DISTINCT l_linestatus) AS st, max(l_tax) - min(l_tax) <= 1e-8 + 1e-5 * abs(max(l_tax)) AS close, list_sort(list(DISTINCT l_returnflag)) AS f FROM lineitem GROUP BY 1)
    SELECT l_orderkey, array_to_string(list_filter([CASE WHEN flags > 1 THEN 'mixed_kind' END, CASE WHEN st > 1 THEN 'mixed_base' END, CASE WHEN NOT close THEN 'alpha' END], lambda x: x IS NOT NULL), ',') AS problems, len(list_filter(f, lambda x: x NOT IN ('A', 'R'))) = 0 AS subset, n >= 3 AND n % 2 = 1 AS due FROM g""")
def compat_groups(spark, d):
    g = V.group_compatibility(load(spark, d, "lineitem"), "l_orderkey", "l_returnflag", "l_linestatus", "l_tax", ["A", "R"])
    due = (F.col("n") >= 3) & (F.col("n") % 2 == 1)
    return g.select("l_orderkey", F.array_join("problems", ",").alias("problems"), "subset", due.alias("due"))


@query("""WITH s AS (SELECT *, CASE s_suppkey % 8 WHEN 0 THEN s_name WHEN 1 THEN '.hidden' WHEN 2 THEN 'web_' || s_suppkey || '.v1' WHEN 3 THEN '' WHEN 4 THEN repeat('n', 64) WHEN 5 THEN repeat('n', 65) WHEN 6 THEN 'a b' ELSE 'c-' || s_suppkey END AS name, CASE WHEN s_suppkey % 9 = 0 THEN s_acctbal + 0.5 WHEN s_suppkey % 5 <> 0 THEN s_acctbal END AS inner_epsilon FROM supplier)
    SELECT s_suppkey, regexp_matches(name, '^[A-Za-z0-9][A-Za-z0-9._-]{0,63}$') AS name_ok, regexp_matches(name, '^[a-zA-Z0-9-]+$') AND length(name) <= 64 AS id_ok,
    array_to_string(list_filter([CASE WHEN s_acctbal < 0 THEN 'negative' END, CASE WHEN s_acctbal / 10000 NOT BETWEEN 0 AND 1 THEN 'range' END, CASE WHEN inner_epsilon <> s_acctbal THEN 'epsilon_mismatch' END], lambda x: x IS NOT NULL), ',') AS problems FROM s""")
def contract_validators(spark, d):
    """Names of eight kinds, most of them invalid, and balances as epsilons, given at two places; every ninth differs, and some are given once."""
    b, k = F.col("s_acctbal"), F.col("s_suppkey")
    kinds = [F.col("s_name"), F.lit(".hidden"), F.concat(F.lit("web_"), k, F.lit(".v1")), F.lit(""), F.lit("n" * 64), F.lit("n" * 65), F.lit("a b"), F.concat(F.lit("c-"), k)]
    name = F.get(F.array(*kinds), (k % 8).cast("int"))
    inner = F.when(k % 9 == 0, b + 0.5).when(k % 5 != 0, b)
    found = V.problems(V.domain(b, 0, name="negative"), V.domain(b / 10000, 0, 1), V.reconciled(b, inner))
    return load(spark, d, "supplier").select("s_suppkey", name.rlike(V.NAME).alias("name_ok"), name.rlike(V.CLIENT).alias("id_ok"), F.array_join(found, ",").alias("problems"))


@query("""WITH o AS (SELECT 'orders' AS origin, o_orderkey AS id, o_custkey AS k FROM orders UNION ALL SELECT 'documents', doc_id, n_chars FROM documents) SELECT origin, count(*) AS n, min(id) AS first_id, max(id) AS last_id, CAST(sum(k) AS BIGINT) AS total FROM o GROUP BY 1""")
def versioned_scan(spark, d):
    """Two sources stacked; an empty one is an error."""
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"))
    t = load(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("k"))
    return V.union_of({"orders": o, "documents": t}).groupBy("origin").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.sum("k").alias("total"))


@query(f"""WITH {VER} SELECT name, max_by(o_orderkey, (ts, o_orderkey)) FILTER (price > 100000) AS newest_measured, max_by(o_orderkey, (ts, o_orderkey)) AS newest FROM ver GROUP BY 1""")
def newest_document(spark, d):
    """The newest document of each name, and the newest one that was measured (null: none was)."""
    when = F.struct("ts", "o_orderkey")
    return versions(spark, d).groupBy("name").agg(F.max_by("o_orderkey", F.when(F.col("price") > 100000, when)).alias("newest_measured"), F.max_by("o_orderkey", when).alias("newest"))
