"""Immutable versions of named payloads in a folder of any Hadoop file system, and packs of files.

``root/name=N/version=V`` holds one row: kind, cluster_id, sha256, num_bytes, payload. A version is written once,
in a hidden folder, and gets its name by a rename that fails where the name is taken. Several writers may store
versions of one name.
"""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.validators import NAME
from lodestone.sources import commit

ROW = "kind string, cluster_id string, sha256 string, num_bytes bigint, payload binary"


def scan(spark: SparkSession, root: str) -> DataFrame:
    """All versions: name, version, kind, cluster_id, sha256, num_bytes, payload. Metadata queries don't read payloads."""
    rows = spark.read.schema(f"{ROW}, name string, version int").parquet(root)
    return rows.select("name", "version", "kind", "cluster_id", "sha256", "num_bytes", "payload")


def names(versions: DataFrame) -> DataFrame:
    return versions.select("name").distinct()


def latest(versions: DataFrame) -> DataFrame:
    """The greatest version of each name, with its metadata."""
    rest = [c for c in versions.columns if c not in ("name", "payload")]
    return versions.groupBy("name").agg(F.max_by(F.struct(*rest), "version").alias("m")).select("name", "m.*")


def _there(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def version_numbers(spark: SparkSession, root: str, name: str) -> list[int]:
    """Committed versions of a name, from the folder's listing alone."""
    fs, path = _there(spark, root)
    at = path(f"{root}/name={name}")
    found = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(f[8:]) for f in found if f.startswith("version=") and fs.exists(path(f"{root}/name={name}/{f}/_SUCCESS")))


class KindMismatch(ValueError):
    """A name holds versions of one kind only."""


def stage(spark: SparkSession, root: str, name: str, payload: bytes, kind: str, cluster_id: str | None = None) -> tuple[str, int]:
    """(staged folder, number): the next version of a name, written in full but not there yet.

    A name begins with a letter or digit and has up to 64 letters, digits, dots, underscores and hyphens. Another kind
    than the name's latest version has is refused.
    """
    if not re.fullmatch(NAME, name):
        raise ValueError(f"invalid name {name!r}")
    there = version_numbers(spark, root, name)
    if there:
        now = spark.read.schema(ROW).parquet(f"{root}/name={name}/version={there[-1]}").select("kind").first().kind
        if now != kind:
            raise KindMismatch(f"{name} holds {now}, not {kind}")
    version = max(there, default=0) + 1
    row = (kind, cluster_id, hashlib.sha256(payload).hexdigest(), len(payload), bytearray(payload))
    part = commit.staged(f"{root}/name={name}/version={version}")
    spark.createDataFrame([row], ROW).coalesce(1).write.parquet(part)
    return part, version


def save(spark: SparkSession, root: str, name: str, payload: bytes, kind: str, cluster_id: str | None = None) -> int:
    """Store the next version of a name and return its number. The version appears at once, with its bytes and its
    metadata; a dead attempt leaves a hidden folder that nothing reads. If another writer has published that number
    meanwhile, this one fails with AlreadyThere and stores nothing."""
    part, version = stage(spark, root, name, payload, kind, cluster_id)
    target = f"{root}/name={name}/version={version}"
    fs, path = _there(spark, root)
    if fs.exists(path(target)) and not fs.exists(path(f"{target}/_SUCCESS")):
        commit.discard(spark, target)  # no version: a renamed folder has its mark, so this was written in place and never ended
    commit.publish(spark, part, target)
    return version


def set_active(spark: SparkSession, root: str, name: str, version: int) -> None:
    """Point a name at one of its versions; the pointer is swapped in one step."""
    if version not in version_numbers(spark, root, name):
        raise KeyError(f"{name} has no version {version}")
    commit.swap_file(spark, f"{root}/_active/{name}.json", json.dumps({"version": version}).encode())


def active(spark: SparkSession, root: str, name: str) -> int | None:
    """The version that a name points at (null: none was set)."""
    fs, path = _there(spark, root)
    at = f"{root}/_active/{name}.json"
    return spark.read.schema("version int").option("multiLine", True).option("mode", "FAILFAST").json(at).first().version if fs.exists(path(at)) else None


def load(spark: SparkSession, root: str, name: str, version: int | None = None, kind: str | None = None) -> bytes:
    """The payload of a version (default: the latest). A missing version, another kind than asked for, and
    bytes that don't fit the stored size and digest are errors."""
    there = version_numbers(spark, root, name)
    version = version if version is not None else max(there, default=0)
    if version not in there:
        raise KeyError(f"{name} has no version {version}")
    row = spark.read.schema(ROW).parquet(f"{root}/name={name}/version={version}").first()
    if kind is not None and row.kind != kind:
        raise ValueError(f"{name} v{version} is a {row.kind}, not a {kind}")
    payload = bytes(row.payload)
    if len(payload) != row.num_bytes or hashlib.sha256(payload).hexdigest() != row.sha256:
        raise ValueError(f"{name} v{version} does not fit its digest")
    return payload


def broken(versions: DataFrame) -> DataFrame:
    """Versions whose payload doesn't fit its size or digest."""
    ok = (F.octet_length("payload") == F.col("num_bytes")) & (F.sha2("payload", 256) == F.col("sha256"))
    return versions.where(~F.coalesce(ok, F.lit(False))).select("name", "version")


def pack_manifest(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, num_bytes, sha256) of a pack's files."""
    return files.select(F.col(path).alias("path"), F.octet_length(content).cast("bigint").alias("num_bytes"), F.sha2(content, 256).alias("sha256"))


def verify_pack(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, status): files that are missing, extra or changed against the manifest."""
    have = pack_manifest(files).select("path", F.col("sha256").alias("_have"))
    both = manifest.select("path", F.col("sha256").alias("_want")).join(have, "path", "full_outer")
    status = F.when(F.col("_have").isNull(), "missing").when(F.col("_want").isNull(), "extra").when(F.col("_have") != F.col("_want"), "changed")
    return both.select("path", status.alias("status")).where("status is not null")
