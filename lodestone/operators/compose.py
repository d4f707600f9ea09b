"""Composites of adapters, cascades and sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compose(parts: DataFrame, key: list[str], same_modules: bool = False) -> DataFrame:
    """One adapter of several: key, module, rank, a, b, whose product is the sum of coefficient * b a over the parts.

    ``parts``: key columns, part (their order), module, coefficient, rank, a (rank x in) and b (out x rank), row-major. Rows of
    ``a`` are stacked; rows of ``b``, times the coefficient, are put side by side. Parts with coefficient 0 are left
    out. A module that one part has alone stays, unless ``same_modules``: then the live parts must have the same modules. A
    key whose coefficients are all 0 gives zeros of its first part's rank, or with ``same_modules`` is an error.
    """
    names = {c: f"_k{i}" for i, c in enumerate(key)}
    on = lambda: [F.col(c).eqNullSafe(F.col(k)) for c, k in names.items()]
    live = F.col("coefficient") != 0
    per = parts.groupBy(*(F.col(c).alias(k) for c, k in names.items())).agg(F.count_if(live).alias("_live"), F.min("part").alias("_first"), F.countDistinct(F.when(live, F.col("part"))).alias("_parts"))
    met = parts.join(per, on()).where(live | ((F.col("_live") == 0) & (F.col("part") == F.col("_first"))))
    if same_modules:
        met = met.withColumn("coefficient", F.when(F.col("_live") > 0, F.col("coefficient")).otherwise(F.raise_error(F.lit("all coefficients are 0, the composite would be empty"))))
    row = F.struct("part", "rank", "a", F.transform("b", lambda x: x * F.col("coefficient")).alias("b"))
    grouped = met.groupBy(*key, "module").agg(F.array_sort(F.collect_list(row)).alias("p"), F.max("_parts").alias("_parts"))  # the few parts of a module
    if same_modules:
        missing = F.raise_error(F.concat(F.lit("the parts have different modules: "), F.col("module").cast("string")))
        grouped = grouped.withColumn("p", F.when(F.size("p") == F.col("_parts"), F.col("p")).otherwise(missing))
    rank = F.aggregate("p", F.lit(0), lambda s, p: s + p["rank"].cast("int"))
    n = F.floor(F.size(F.col("p")[0]["b"]) / F.col("p")[0]["rank"]).cast("int")
    b = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.flatten(F.transform("p", lambda p: F.slice(p["b"], i * p["rank"].cast("int") + 1, p["rank"].cast("int"))))))
    return grouped.select(*key, "module", rank.alias("rank"), F.flatten(F.transform("p", lambda p: p["a"])).alias("a"), b.alias("b"))


def apply_cascade(steps: DataFrame, stored: DataFrame, action: str, reason: str) -> DataFrame:
    """What the steps of a cascade do, as the rows of the log: name, from_version, to_version, rebuilt, target, action, reason.

    ``steps``: name, from_version, target, reuse_version, as ``registry_rules.cascade`` plans them; ``stored``: name, version. A
    step reuses the version that holds its target, or builds the next free one of its name; several steps to one
    target build it once. The name's active version is then ``to_version``.
    """
    last = stored.groupBy("name").agg(F.max("version").alias("_last"))
    new = steps.where("reuse_version IS NULL").select("name", "target").distinct()
    numbered = new.withColumn("_next", F.row_number().over(Window.partitionBy("name").orderBy("target")))  # the few composites of a name
    met = steps.join(last, "name", "left").join(numbered, ["name", "target"], "left")
    to = F.coalesce("reuse_version", F.coalesce("_last", F.lit(0)) + F.col("_next"))
    text = F.concat(F.lit("cascade v"), F.col("from_version"), F.lit(" -> v"), to, F.lit(f": {reason}"))
    return met.select("name", "from_version", to.alias("to_version"), F.col("reuse_version").isNull().alias("rebuilt"), "target", F.lit(action).alias("action"), text.alias("reason"))


def update_verdicts(existing: DataFrame, updates: DataFrame, frozen: DataFrame) -> DataFrame:
    """``updates`` (experiment, run and further columns) with ``verdict``: ``frozen`` if the experiment is, ``completed`` if the
    stored run is completed and so immutable, else ``written``. ``existing``: experiment, run, status; ``frozen``: experiment."""
    done = existing.where("status = 'completed'").select(F.col("experiment").alias("_e"), F.col("run").alias("_r")).distinct()
    ice = frozen.select(F.col("experiment").alias("_f")).distinct()
    met = updates.join(done, (F.col("experiment") == F.col("_e")) & (F.col("run") == F.col("_r")), "left").join(ice, F.col("experiment") == F.col("_f"), "left")
    verdict = F.when(F.col("_f").isNotNull(), "frozen").when(F.col("_e").isNotNull(), "completed").otherwise("written")
    return met.withColumn("verdict", verdict).drop("_e", "_r", "_f")


def freezable(runs: DataFrame) -> DataFrame:
    """A row an experiment: n_runs, n_unfinished, the least unfinished run, and ``can_freeze``, which needs all completed."""
    open_ = F.col("status").isNull() | (F.col("status") != "completed")
    per = runs.groupBy("experiment").agg(F.count("*").alias("n_runs"), F.count_if(open_).alias("n_unfinished"), F.min(F.when(open_, F.col("run"))).alias("first_unfinished"))
    return per.withColumn("can_freeze", F.col("n_unfinished") == 0)


def frozen(runs: DataFrame, experiments: DataFrame, tag: str) -> DataFrame:
    """Marks (experiment, tag) of the experiments to freeze; an unfinished run is an error that names it. ``experiments`` without
    runs have nothing unfinished."""
    state = experiments.select("experiment").distinct().join(freezable(runs), "experiment", "left")
    wrong = F.raise_error(F.concat(F.lit("cannot freeze "), F.col("experiment").cast("string"), F.lit(": unfinished run "), F.col("first_unfinished").cast("string")))
    ok = F.coalesce(F.col("can_freeze"), F.lit(True))
    return state.select(F.when(ok, F.col("experiment")).otherwise(wrong).alias("experiment"), F.lit(tag).alias("tag"))


def version_history(versions: DataFrame, decisions: DataFrame, active: DataFrame) -> DataFrame:
    """``versions`` (name, version and further columns) with ``is_active`` and ``decisions``, those made about this very version, in
    order of ``seq``: structs of the columns of ``decisions`` (name, version, seq and further ones). Other decisions don't show."""
    rest = [c for c in decisions.columns if c not in ("name", "version", "seq")]
    made = decisions.groupBy(F.col("name").alias("_n"), F.col("version").alias("_v")).agg(F.array_sort(F.collect_list(F.struct("seq", *rest))).alias("decisions"))
    now = active.select(F.col("name").alias("_a"), F.col("active").alias("_at"))
    met = versions.join(made, (F.col("name") == F.col("_n")) & (F.col("version") == F.col("_v")), "left").join(now, F.col("name") == F.col("_a"), "left")
    none = F.array().cast(made.schema["decisions"].dataType)
    return met.select(*versions.columns, F.coalesce(F.col("version") == F.col("_at"), F.lit(False)).alias("is_active"), F.coalesce("decisions", none).alias("decisions"))


def decide(candidates: DataFrame, tolerance: float = 0.02, refuse: bool = True) -> DataFrame:
    """``candidates`` with ``action``, ``active_version_after`` and ``reason``, by both sides of the promotion rule.

    Columns needed: version, previous_version, delta (gain within projects; null: no baseline), band, base_guard and
    cand_guard (pass@1; null: missing). Promoted is what gains more than its band and loses at most ``tolerance``; all
    else, also what isn't measured, is rolled back to the previous version. Where there is none that is an error, or,
    unless ``refuse``, a null action whose reason says so. Values are compared as they are and rounded in the text only.
    """
    gain = F.col("delta") > F.col("band")
    drop = F.col("base_guard") - F.col("cand_guard")
    hold = drop <= tolerance
    first = F.when(F.col("delta").isNull(), "no baseline_in_project supplied — cannot confirm improvement").when(gain, F.format_string("edit_similarity +%.4f clears noise band %.4f", "delta", "band")).otherwise(F.format_string("edit_similarity delta %.4f does not clear noise band %.4f", "delta", "band"))
    limit = f"{tolerance:.2f} tolerance"
    second = F.when(drop.isNull(), "HumanEval guard metrics missing on candidate or baseline").when(hold, F.format_string(f"HumanEval pass@1 drop %.4f within {limit}", drop)).otherwise(F.format_string(f"HumanEval pass@1 dropped %.4f, exceeds {limit}", drop))
    both = F.concat(first, F.lit("; "), second)
    good = F.coalesce(gain & hold, F.lit(False))
    none = F.concat(F.lit("rollback indicated ("), both, F.lit(") but there is no previous version to roll back to"))
    stuck = ~good & F.col("previous_version").isNull()
    reason = F.when(good, F.concat(F.lit("promoted: "), both)).when(stuck, F.raise_error(none) if refuse else none).otherwise(F.concat(F.lit("rolled back: "), both))
    action: Column = F.when(good, "promote").when(~stuck, "rollback")
    return candidates.select("*", action.alias("action"), F.when(good, F.col("version")).otherwise(F.col("previous_version")).alias("active_version_after"), reason.alias("reason"))


def checked_lookup(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``known``, one row a key; a row whose key is unknown or null is an error that names it."""
    there = known.withColumnRenamed(key, "_key")
    met = rows.join(there, F.col(key) == F.col("_key"), "left")
    wrong = F.raise_error(F.concat(F.lit(f"unknown {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return met.withColumn(key, F.when(F.col("_key").isNotNull(), F.col(key)).otherwise(wrong)).drop("_key")
