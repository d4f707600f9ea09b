"""Validation rules as expressions that list what is wrong (P12-P14, P16-P19, P23, U01). An empty list means valid."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits of an adapter, and what a request's fields may hold.
RANK_CAP, NORM_ERROR, NORM_WARNING = 16, 100.0, 80.0
NAME = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,63}$(?!\n)"
CLIENT = r"^[a-zA-Z0-9-]{1,64}$(?!\n)"


def problems(*checks: Column) -> Column:
    """The messages of the checks that fail, in order; a check is null when it passes."""
    return F.array_compact(F.array(*checks))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, where ``value`` is computed once a row however often ``body`` uses it. Spark doesn't share what stands
    inside conditions, so without this a document would be parsed anew for each of its checks."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def domain(value: Column, low: float | None = None, high: float | None = None, name: str = "range") -> Column:
    bad = F.lit(False)
    if low is not None:
        bad = bad | (value < low)
    if high is not None:
        bad = bad | (value > high)
    return F.when(bad, name)


def reconciled(outer: Column, inner: Column, relative: float = 1e-9) -> Column:
    """``epsilon_mismatch`` if both are given and differ by more than the relative tolerance."""
    return F.when(F.abs(outer - inner) > relative * F.greatest(F.abs(outer), F.abs(inner)), "epsilon_mismatch")


def path_problem(path: Column) -> Column:
    """Why a relative path is refused: missing, going up, or absolute."""
    return F.when(F.coalesce(path, F.lit("")) == "", "empty").when(path.contains(".."), "traversal").when(path.rlike(r"^[/\\]") | path.rlike("^[A-Za-z]:"), "absolute")


def upload_problems(document: Column) -> Column:
    """What is wrong with an upload's metadata, given as JSON text, in either of its two shapes.

    Flat: client_id, round_id, rank, target_modules. Nested: client_id, round, hparams.rank and
    hparams.target_modules. Types are judged on the JSON values themselves.
    """
    fields = (
        ("client_id", "$.client_id", "$.client_id", "STRING", "string"),
        ("round", "$.round_id", "$.round", "BIGINT", "integer"),
        ("rank", "$.rank", "$.hparams.rank", "BIGINT", "integer"),
        ("target_modules", "$.target_modules", "$.hparams.target_modules", "ARRAY<STRING>", "list of strings"),
    )
    kind = lambda v, path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))

    def check(found: Column, field: str, wanted: str, word: str) -> Column:
        return F.when(found.isNull() | (found == "VOID"), f"missing {field}").when(~found.isin(wanted, "ARRAY<VOID>" if wanted[0] == "A" else wanted), f"{field} must be a {word}")

    def judged(v: Column) -> Column:
        kinds = let(kind(v, "$.hparams").isNotNull(), lambda nested: F.array(*(F.when(nested, kind(v, deep)).otherwise(kind(v, flat)) for _, flat, deep, _, _ in fields)))
        listed = let(kinds, lambda k: problems(*(check(F.get(k, F.lit(i)), field, wanted, word) for i, (field, _, _, wanted, word) in enumerate(fields))))
        # a null document and one that isn't an object are one problem
        return F.when(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), F.array(F.lit("not an object"))).otherwise(listed)

    return let(F.try_parse_json(document), judged)


def tensor_problems(name: Column, dtype: Column, shape: Column, data: Column, most_bytes: int = 100 << 20) -> Column:
    """Missing fields of a tensor, and base64 text too long for the limit."""
    missing = [F.when(c.isNull(), f"missing {n}") for n, c in (("name", name), ("dtype", dtype), ("shape", shape), ("data", data))]
    return problems(*missing, F.when(F.length(data) * 3 > 4 * most_bytes, "too large"))


def integrity_problems(values: Column, norm: Column, rank: Column, n_bytes: Column, most_bytes: int) -> Column:
    """Rank above the cap, values that aren't finite, a norm too large, too many bytes."""
    x = lambda v: v.cast("double")
    return problems(
        F.when(rank > RANK_CAP, "rank_cap"),
        F.when(F.exists(values, lambda v: F.isnan(x(v))), "nan"),
        F.when(F.exists(values, lambda v: F.abs(x(v)) == float("inf")), "inf"),
        F.when(norm > NORM_ERROR, "norm_error").when(norm > NORM_WARNING, "norm_warning"),
        F.when(n_bytes > most_bytes, "too_many_bytes"),
    )


def module_differences(parts: DataFrame, key: list[str], part: str, module: str) -> DataFrame:
    """For each key the modules that only one of its two parts (``cluster``, ``client``) adapts.

    Columns only_cluster and only_client, sorted; both empty means the sets are the same. Keys with
    one part differ in nothing. Modules of a part are a set that an adapter's layers bound.
    """
    sets = parts.groupBy(*key).agg(*(F.collect_set(F.when(F.col(part) == p, F.col(module))).alias(p) for p in ("cluster", "client")))
    both = (F.size("cluster") > 0) & (F.size("client") > 0)
    less = lambda a, b: F.when(both, F.array_sort(F.array_except(a, b))).otherwise(F.array().cast("array<string>"))
    return sets.select(*key, less("cluster", "client").alias("only_cluster"), less("client", "cluster").alias("only_client"))


def plan_acceptance(shards: DataFrame, plan: str, client: str, n_files: str, declared: Column | None, most: int, expected: int) -> DataFrame:
    """A row a plan: errors, warnings and whether it is accepted.

    Errors: fewer than two clients or more than ``most`` declared, a client named twice, a shard
    without files. A declared number other than ``expected`` is a warning. Without ``declared`` a plan declares the shards it has.

    Shards are added up by client and then by plan, after one shuffle by plan.
    """
    dealt = shards.repartition(plan)
    n = F.lit(None).cast("bigint") if declared is None else declared
    each = dealt.groupBy(plan, client).agg(F.max(n).alias("n"), F.count("*").alias("rows"), F.count_if(F.col(n_files) == 0).alias("empty"))
    one = each.groupBy(plan).agg(F.sum("rows").alias("rows"), (F.sum("rows") if declared is None else F.max("n")).alias("n"), F.count(client).alias("clients"), F.sum("empty").alias("empty"))
    errors = problems(
        F.when(F.col("n") < 2, "too_few_clients"), F.when(F.col("n") > most, "too_many_clients"), F.when(F.col("clients") < F.col("rows"), "duplicate_client"), F.when(F.col("empty") > 0, "empty_shard")
    )
    return one.select(plan, errors.alias("errors"), problems(F.when(F.col("n") != expected, "count_mismatch")).alias("warnings")).withColumn("accepted", F.size("errors") == 0)


def union_of(sources: dict[str, DataFrame]) -> DataFrame:
    """All rows of the sources with ``origin``; reading a source without rows is an error."""
    out = None
    for name, rows in sources.items():
        tagged = rows.withColumn("origin", F.lit(name))
        # the assertion is part of the plan: a source's single count row turns into an error, or into nothing
        count = rows.agg(F.count("*").alias("n"))
        empty = count.where(F.col("n") == 0).select(F.raise_error(F.lit(f"source {name} is empty")).cast("string").alias("e"))
        tagged = tagged.unionByName(empty.where("e is not null").select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in tagged.schema)))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def sweep_problems(size: Column, unexplained: Column, cost: Column, cap: float, override: float, budget: float) -> Column:
    """A sweep point over its compute cap, over the cap's override without a reason, and over the budget (P20)."""
    return problems(F.when(size > cap, "cap"), F.when((size > override) & unexplained, "override_without_reason"), F.when(cost > budget, "budget"))


def group_compatibility(rows: DataFrame, by: str, kind: str, base: str, alpha: str, wanted: list[str]) -> DataFrame:
    """A row a group (P10, P11, U06): ``n``, ``problems`` (``mixed_kind``, ``mixed_base``, ``alpha``: not all close to each other) and
    ``subset``, whether all its kinds are among ``wanted``."""
    close = F.max(alpha) - F.min(alpha) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(F.max(alpha))
    g = rows.groupBy(by).agg(F.count("*").alias("n"), F.countDistinct(kind).alias("_kinds"), F.countDistinct(base).alias("_bases"), close.alias("_close"), F.count_if(~F.col(kind).isin(*wanted)).alias("_others"))
    found = problems(F.when(F.col("_kinds") > 1, "mixed_kind"), F.when(F.col("_bases") > 1, "mixed_base"), F.when(~F.col("_close"), "alpha"))
    return g.select(by, "n", found.alias("problems"), (F.col("_others") == 0).alias("subset"))
