"""Corpus filtering, partitioning, splits and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators.ordering import hash_bucket, range_bucket, running, streamed_digest

#: Rows of names and counts that are broadcast.
SMALL_LIST = 100_000


def with_text_columns(files: DataFrame, content: str = "content") -> DataFrame:
    """Line, code-line and byte counts and the digest of the newline-normalised text."""
    t = F.col(content)
    return files.withColumns({"num_lines": X.count_lines(t), "num_code_lines": X.count_code_lines(t), "num_bytes": X.normalised_bytes(t), "content_sha256": X.sha256(X.normalise_newlines(t))})


def filter_reasons(files: DataFrame, exclude: list[str], order: list[str], min_code_lines: int = 10, max_bytes: int = 262_144, drop_duplicates: bool = True) -> DataFrame:
    """``files`` with ``reason``, the first rule that rejects a file (null: accepted).

    Columns needed: path, content (null: not decodable), num_code_lines, content_sha256, and ``order``,
    which tells all files apart. Duplicates are judged among the files that pass all other rules, by
    an aggregation: the first file of each digest that several files share is joined back, so a
    digest with a third of all files combines before the shuffle.
    """
    size = F.octet_length("content")
    early = (
        F.when(X.matches_glob(F.col("path"), exclude), "excluded_glob")
        .when(size == 0, "empty")
        .when(size > max_bytes, "too_large")
        .when(F.col("content").isNull(), "undecodable")
        .when(F.col("num_code_lines") < min_code_lines, "too_few_code_lines")
    )
    judged = files.withColumn("reason", early)
    if not drop_duplicates:
        return judged
    shared = judged.where("reason IS NULL").groupBy(F.col("content_sha256").alias("_digest")).agg(F.min(F.struct(*order)).alias("_first"), F.count("*").alias("_copies")).where("_copies > 1")
    met = judged.join(shared, F.col("reason").isNull() & (F.col("content_sha256") == F.col("_digest")), "left")
    late = F.col("_first").isNotNull() & (F.struct(*order) != F.col("_first"))
    return met.withColumn("reason", F.when(F.col("reason").isNull() & late, "duplicate_content").otherwise(F.col("reason"))).drop("_digest", "_first", "_copies")


def reason_counts(judged: DataFrame, by: str) -> DataFrame:
    """Counts of each reason by source and over all (``by`` null)."""
    rejected = judged.where("reason IS NOT NULL")
    return rejected.groupingSets([["reason", by], ["reason"]], "reason", by).agg(F.count("*").alias("n"))


def first_seen(records: DataFrame, digest: str, order: list[str]) -> DataFrame:
    """Of the rows with one digest the first in ``order``. A null digest is a value of its own.

    An aggregation, so a frequent digest combines before the shuffle.
    """
    rest = [c for c in records.columns if c != digest]
    return records.groupBy(digest).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(digest, "_r.*").select(*records.columns)


def roll_up(records: DataFrame, by: list[str]) -> DataFrame:
    return records.groupBy(*by).agg(
        F.count("*").alias("num_files"), F.sum("num_lines").alias("num_lines"), F.sum("num_code_lines").alias("num_code_lines"), F.sum("num_bytes").alias("total_bytes")
    )


def hash_order(seed: int, group: str, key: str) -> Column:
    return X.sha256(F.concat_ws(":", F.lit(str(seed)), F.col(group), F.col(key).cast("string")))


def in_hash_order(records: DataFrame, group: str, key: str, seed: int) -> DataFrame:
    """``_at``, a record's place in its group's seeded hash order, and ``_n``, the group's size."""
    hashed = records.withColumn("_hash", hash_order(seed, group, key))
    return running(hashed, [group], ["_hash", key], hash_bucket(F.col("_hash"))).drop("_hash")


def hash_chunks(records: DataFrame, group: str, key: str, seed: int, target: int) -> DataFrame:
    """Deal the records of a group to max(1, n div target) chunks, round robin in seeded hash order."""
    chunks = F.greatest(F.lit(1), F.floor(F.col("_n") / target))
    return in_hash_order(records, group, key, seed).withColumn("chunk", (F.col("_at") % chunks).cast("int")).drop("_at", "_n")


def holdout(records: DataFrame, group: str, key: str, seed: int, fraction: float) -> DataFrame:
    """``held_out`` for the first clamp(round(n * fraction), 1, n - 1) records in seeded hash order.

    Rounding is half to even. A group of one record cannot be split: its ``held_out`` is null.
    """
    n = F.col("_n")
    most = F.greatest(F.lit(1), F.least(F.bround(n * fraction).cast("bigint"), n - 1))
    return in_hash_order(records, group, key, seed).withColumn("held_out", F.when(n >= 2, F.col("_at") < most)).drop("_at", "_n")


def developers(records: DataFrame, group: str, key: str, path: str, seed: int, target: int, least: int) -> DataFrame:
    """Split each group into developers by module path, else by hash chunks, else not at all.

    A basis holds if it gives at least two parts and each has at least ``least`` records. Adds
    ``basis`` and ``dev_index``. Parts are counted by aggregation; the index ranks parts, not records.
    """
    base = hash_chunks(records.withColumn("_module", X.module_key(F.col(path))), group, key, seed, target)

    def holds(part: str, name: str) -> DataFrame:
        sizes = base.groupBy(group, part).agg(F.count("*").alias("n"))
        return sizes.groupBy(group).agg(((F.count("*") >= 2) & (F.min("n") >= least)).alias(name))

    judged = base.join(holds("_module", "_by_module"), group).join(holds("chunk", "_by_chunk"), group)
    basis = F.when(F.col("_by_module"), "module_path").when(F.col("_by_chunk"), "deterministic_hash_chunk").otherwise("single_developer_whole_project")
    part = F.when(F.col("_by_module"), F.col("_module")).when(F.col("_by_chunk"), F.lpad(F.col("chunk").cast("string"), 12, "0")).otherwise("")
    marked = judged.withColumn("basis", basis).withColumn("_part", part)
    index = marked.select(group, "_part").distinct().withColumn("dev_index", F.row_number().over(Window.partitionBy(group).orderBy("_part")) - 1)
    return marked.join(index, [group, "_part"]).drop("_part", "_module", "_by_module", "_by_chunk", "chunk")


def picked_lines(content: str, per_file: int, stride: int, skip: int, least: int) -> Column:
    """(line_no, target) of every stride-th usable line from line ``skip`` on, ``per_file`` at most. The walk stays
    inside the row (higher-order functions), so files aren't shuffled."""
    numbered = F.transform(X.split_lines(F.col(content)), lambda x, i: F.struct(i.alias("line_no"), x.alias("target")))
    usable = F.filter(numbered, lambda x: (x["line_no"] >= skip) & X.is_usable_line(x["target"], least))
    return F.slice(F.filter(usable, lambda _, i: i % stride == 0), 1, per_file)


def prompted(files: DataFrame, file: str, content: str, picked: Column) -> DataFrame:
    """(file, line_no, prompt, target) of the picked lines; a prompt is all of the file before the line."""
    out = files.select(F.col(file).alias("file"), X.split_lines(F.col(content)).alias("_lines"), F.explode(picked).alias("x")).select("file", "_lines", "x.*")
    return out.select("file", "line_no", F.concat(F.array_join(F.slice("_lines", F.lit(1), F.col("line_no")), "\n"), F.lit("\n")).alias("prompt"), "target")


def next_line_examples(files: DataFrame, file: str, content: str, per_file: int, stride: int = 7, skip: int = 3, least: int = 4) -> DataFrame:
    """(file, line_no, prompt, target): every stride-th usable line from line ``skip`` on, at most ``per_file`` a file.

    A usable line has ``least`` characters when stripped and is no comment.
    """
    return prompted(files, file, content, picked_lines(content, per_file, stride, skip, least))


def first_examples(files: DataFrame, file: str, content: str, most: int, per_file: int | None = None, stride: int = 7, skip: int = 3, least: int = 4) -> DataFrame:
    """The first ``most`` of the files' examples, files taken in the order of their paths' components and lines in
    theirs (T02, T03). A file gives ``per_file`` at most, by default twice ceil(most / number of files).

    Examples are counted file by file and the counts summed in ranges of the order, which chooses files and how
    many lines each gives; prompts are built for those alone. Files whose ``content`` is null (not decodable) count
    as files and give none. ``file`` tells files apart; its nulls count as files and give none.
    """
    if most < 1:
        raise ValueError(f"most = {most}")
    quota = per_file if per_file is not None else 2 * max(1, -(-most // max(1, files.count())))
    picked = picked_lines(content, quota, stride, skip, least)
    parts = F.split(F.col(file).cast("string"), "/")
    sized = files.where(F.col(file).isNotNull() & F.col(content).isNotNull()).select(F.col(file).alias("_file"), parts.alias("_parts"), F.size(picked).alias("_many"))
    placed = running(sized, [], ["_parts"], range_bucket(sized, F.col("_parts")), F.col("_many"))
    chosen = placed.where((F.col("_at") < most) & (F.col("_many") > 0)).select("_file", F.least(F.col("_many"), F.lit(most) - F.col("_at")).cast("int").alias("_take"))
    if most <= SMALL_LIST:
        chosen = F.broadcast(chosen)  # at most ``most`` rows
    met = files.join(chosen, F.col(file) == F.col("_file"))
    return prompted(met, file, content, F.slice(picked, F.lit(1), F.col("_take")))


def ordered_digest(records: DataFrame, group: str, key: str, digest: str) -> DataFrame:
    """``num_files`` and ``shard_sha256``, the digest of the group's ``key NUL digest LF`` lines in key order. Lines with a
    null are counted but left out."""
    line = F.concat(F.col(key), F.lit("\x00"), F.col(digest), F.lit("\n")).cast("binary")
    return streamed_digest(records, [group], [key, digest], line).withColumnsRenamed({"n": "num_files", "digest": "shard_sha256"})


def fixed_chunks(texts: DataFrame, group: str, order: str, tokens: str, length: int, keep_tail: bool, span: int = 4096) -> DataFrame:
    """``group``, ``block``, ``pos`` and ``token`` of each token of the group's texts, taken in ``order`` (a number);
    the last, short block of a group only if ``keep_tail``.

    Only ids and sizes are summed to offsets (in ranges of ``span`` ids); tokens are dealt to blocks by
    arithmetic where they are and aren't sorted. Null token lists are empty.
    """
    sized = texts.select(group, F.col(order).alias("_o"), F.coalesce(F.size(tokens), F.lit(0)).alias("_s"))
    offsets = running(sized, [group], ["_o"], F.floor(F.col("_o") / span), F.greatest(F.col("_s"), F.lit(0))).select(F.col(group).alias("_g"), "_o", "_at", "_n")
    met = texts.join(offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col(order) == F.col("_o")))
    each = met.select(group, "_at", "_n", F.posexplode(tokens).alias("_p", "token")).withColumn("_at", F.col("_at") + F.col("_p"))
    out = each.withColumn("block", F.floor(F.col("_at") / length)).withColumn("pos", (F.col("_at") % length).cast("int"))
    return (out if keep_tail else out.where((F.col("block") + 1) * length <= F.col("_n"))).select(group, "block", "pos", "token")


def budgets(counts: DataFrame, n: str, total: int, policy: str = "sqrt", max_epochs: float = 3.0, least: int = 20) -> DataFrame:
    """Share ``total`` blocks by weight 1, sqrt(n) or n, capped at n * max_epochs and floored at min(least, n)."""
    weight = {"uniform": F.lit(1.0), "sqrt": F.sqrt(F.col(n)), "linear": F.col(n).cast("double")}[policy]
    weighed = counts.withColumn("_w", weight)
    whole = weighed.agg(F.sum("_w").alias("_all"))
    share = F.lit(float(total)) * F.col("_w") / F.when(F.col("_all") == 0, 1.0).otherwise(F.col("_all"))
    ceiling = F.greatest(F.col(n) * max_epochs, F.lit(float(least)))
    budget = F.greatest(F.bround(F.least(share, ceiling)).cast("bigint"), F.least(F.lit(least), F.col(n)).cast("bigint"))
    out = weighed.join(F.broadcast(whole)).withColumn("chunk_budget", budget)  # one row is broadcast
    return out.withColumn("epochs", F.when(F.col(n) > 0, F.bround(F.col("chunk_budget") / F.col(n), 3)).otherwise(0.0)).drop("_w", "_all")
