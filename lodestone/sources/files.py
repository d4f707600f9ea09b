"""JSON lines, documents, logs, run records, file trees and settings through Spark's readers."""

from __future__ import annotations

import hashlib
import json
import os
import re
import warnings
from dataclasses import MISSING, fields, is_dataclass
from typing import get_type_hints

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators.ordering import range_bucket, running
from lodestone.sources.commit import swap_file
from lodestone.sources.scratch import stored


def read_jsonl(spark: SparkSession, path: str, schema: str, required: list[str] | None = None) -> DataFrame:
    """Rows of a JSON-lines path under a fixed schema. Blank lines are skipped; a malformed line
    and a null in a required column are errors when rows are read."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return asserted(rows, required or [])


def asserted(rows: DataFrame, required: list[str]) -> DataFrame:
    for c in required:
        rows = rows.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"missing {c}"))).otherwise(F.col(c)))
    return rows


def write_jsonl(rows: DataFrame, path: str) -> None:
    """Replace a path by the rows; the committer shows all of them or none."""
    rows.write.mode("overwrite").json(path)


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_document(spark: SparkSession, path: str, document: dict) -> None:
    """Replace ``path`` by one JSON document, in one step: a reader sees the old one or the new one."""
    swap_file(spark, path, json.dumps(document, indent=2, ensure_ascii=False).encode())


def read_runs(spark: SparkSession, root: str, schema: str, experiment: str | None = None) -> DataFrame:
    """Run records ``root/<experiment>/<run>/run.json`` by experiment and path; one experiment's folder only, if given."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(f"{root}/{experiment or '*'}/*/run.json")
    return rows.withColumn("path", F.regexp_extract(F.input_file_name(), "([^/]+/[^/]+)/run.json$", 1)).orderBy("path")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def discover(spark: SparkSession, root: str, name: str | list[str] = "*.py", subpaths: list[str] | None = None, missing: str = "warn") -> DataFrame:
    """(path, length, content) of the files below a folder whose name fits one of the globs; path is relative to it. A file
    that several globs or overlapping ``subpaths`` find counts once.

    ``subpaths`` reads those folders only; one that isn't there is skipped with a warning, and if none is there the whole
    folder is read. With ``missing`` = ``error`` a folder that isn't there is an error.
    """
    root = root.rstrip("/")
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = []
    for s in subpaths or []:
        at = jvm.org.apache.hadoop.fs.Path(f"{root}/{s}")
        if fs.exists(at) and fs.getFileStatus(at).isDirectory():
            there.append(s.strip("/"))
        elif missing == "error":
            raise FileNotFoundError(f"{root}/{s} does not exist")
        else:
            warnings.warn(f"{root}/{s} does not exist and is skipped", stacklevel=2)
    outer = sorted({s for s in there if not any(s != o and s.startswith(f"{o}/") for o in there)})  # folders inside others are read with those
    globs = [name] if isinstance(name, str) else name
    glob = globs[0] if len(globs) == 1 else "{" + ",".join(globs) + "}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load([f"{root}/{s}" for s in outer] if outer else root)
    clean = root.split(":", 1)[-1]
    relative = F.regexp_replace("path", rf"^.*?\Q{clean}\E/", "")
    return found.select(relative.alias("path"), "length", "content")


def texts(spark: SparkSession, root: str, name: str = "*.py") -> DataFrame:
    """(path, text) of the decodable files below a folder."""
    return discover(spark, root, name).select("path", decoded(F.col("content")).alias("text")).where("text is not null")


def sorted_texts(spark: SparkSession, root: str, name: str = "*.py") -> DataFrame:
    """The same in path order, parts of a path compared one by one."""
    return texts(spark, root, name).orderBy(F.split("path", "/"))


def numbered_paths(rows: DataFrame, path: str, name: str) -> DataFrame:
    """``rows`` with ``name``, their place (from 0) in the order of paths, parts compared one by one.

    Places need the rows four times, so they are stored first: what gives them, such as a tree of files, is read once.
    """
    parts = F.split(path, "/")
    rows, _ = stored(rows.repartition(path), "paths")  # tasks of a few files each would leave as many tables
    return running(rows.withColumn("_parts", parts), [], ["_parts"], range_bucket(rows, parts), at=name).drop("_parts", "_n")


def config_digest(config: Column, swept: tuple[str, ...] = ()) -> Column:
    """``config_hash`` for a column of maps of texts, without the keys that a sweep sets."""
    kept = F.map_filter(config, lambda k, _: ~k.isin(*swept)) if swept else config
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept)))).cast("binary"), 256)


def read_corpus(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """Corpus records, each with its required columns; a corpus without records is an error when it is read."""
    from lodestone.operators.validators import union_of

    return union_of({"corpus": read_jsonl(spark, path, schema, required)}).drop("origin")


def synthetic_files(spark: SparkSession, n: int, project: str, lines: int = 20) -> DataFrame:
    """``n`` source files made from digests of their numbers: project, path, content. The same on every run."""
    line = lambda i: F.concat(F.lit("value_"), F.substring(X.sha256(F.concat_ws("|", F.lit(project), "id", i.cast("string"))), 1, 8), F.lit(" = "), i.cast("string"))
    body = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(lines)), line), "\n")
    path = F.concat(F.lit("pkg"), (F.col("id") % 7).cast("string"), F.lit("/m"), F.col("id").cast("string"), F.lit(".py"))
    return spark.range(n).select(F.lit(project).alias("project"), path.alias("path"), F.concat(body, F.lit("\n")).alias("content"))


def config_hash(config: dict, length: int = 64) -> str:
    """Digest of a configuration: its compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:length]


def run_id(config: dict, swept: tuple[str, ...] = ()) -> str:
    """Ten digits of the digest of a configuration without the keys that the sweep itself sets."""
    return config_hash({k: v for k, v in config.items() if k not in swept}, 10)


def load_config(text: str, kind: type, environment: dict[str, str] | None = None):
    """A dataclass from a JSON document; ``${NAME}`` and ``${NAME:-default}`` come from the environment.

    Keys that the dataclass lacks, fields without a value and unset names are errors; nested dataclasses
    are built from nested objects.
    """
    env = os.environ if environment is None else environment

    def expand(m: re.Match) -> str:
        if m[1] not in env and m[2] is None:
            raise KeyError(f"{m[1]} is not set")
        return json.dumps(env.get(m[1], m[2]))[1:-1]

    def build(value, of):
        if not is_dataclass(of) or not isinstance(value, dict):
            return value
        known, types = {f.name: f for f in fields(of)}, get_type_hints(of)
        if extra := sorted(set(value) - set(known)):
            raise ValueError(f"unknown keys {extra} for {of.__name__}")
        if gone := [n for n, f in known.items() if n not in value and f.default is MISSING and f.default_factory is MISSING]:
            raise ValueError(f"{of.__name__} lacks {gone}")
        return of(**{k: build(v, types[k]) for k, v in value.items()})

    return build(json.loads(re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", expand, text)), kind)


def round_trip_differences(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """Rows whose JSON text in ``column`` changes when it is read under ``schema`` and written again: the text
    and the keys that were lost. Keys whose value is null count as absent."""
    keys = lambda c: F.map_keys(F.map_filter(F.from_json(c, "map<string,string>"), lambda _, v: v.isNotNull()))
    again = F.to_json(F.from_json(column, schema))
    lost = F.array_except(keys(F.col(column)), keys(again))
    return rows.withColumn("lost", F.array_sort(lost)).where(F.size("lost") > 0)


def decoded(content: Column) -> Column:
    """The text of a file, newlines normalised; null if it is binary or no UTF-8."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text) & ~X.looks_binary(content), X.normalise_newlines(text))


def shards(manifests: DataFrame) -> DataFrame:
    """One row a shard of partition manifests."""
    return manifests.select("manifest_version", "strategy", "seed", "corpus_sha256", F.explode("shards").alias("s")).select("manifest_version", "strategy", "seed", "corpus_sha256", "s.*")


def nested(rows: DataFrame, column: str, key: str) -> DataFrame:
    """One row a map entry, with its key. A null map is an error that names the column."""
    there = F.when(F.col(column).isNull(), F.raise_error(F.lit(f"missing {column}"))).otherwise(F.col(column))
    others = [c for c in rows.columns if c != column]
    return rows.select(*others, F.explode(there).alias(key, "_v")).select(*others, key, "_v.*")


def samples(rows: DataFrame) -> DataFrame:
    """Samples need a task and a solution or a completion."""
    text = F.coalesce("solution", "completion")
    return asserted(rows.withColumn("sample", text), ["task_id", "sample"])


def tasks(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Tasks of the first of ``paths`` that exists; none, and one without tasks, is an error."""
    from lodestone.operators.validators import union_of

    jvm = spark.sparkContext._jvm
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return union_of({"tasks": read_jsonl(spark, p, schema, ["task_id"])}).drop("origin")
    raise FileNotFoundError(f"no tasks at {paths}")


def first_tasks(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Tasks by numeric suffix, those without one last; ``limit`` takes the first ones."""
    suffix = F.coalesce(F.element_at(F.split("task_id", "/"), -1).try_cast("int"), F.lit(1 << 30))
    ordered = rows.orderBy(suffix, "task_id")
    return ordered if limit is None else ordered.limit(limit)
