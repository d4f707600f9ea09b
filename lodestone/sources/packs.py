"""Reproducibility packs (S22): files in tar archives with a manifest, written and read by tasks.

A pack is a folder: ``files-NNNNN.tar``, each a range of paths in order, and ``manifest``, JSON lines of path, num_bytes,
sha256 and archive. The archives of one set of files and one number of archives are the same, byte for byte.
"""

from __future__ import annotations

import hashlib
import io
import tarfile
import uuid

import pyarrow as pa
from pyarrow import fs as afs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.validators import path_problem
from lodestone.sources.tensor_files import opened
from lodestone.sources.versions import verify_pack

#: Bytes of files in an archive, about; an archive is written and read by one task.
ARCHIVE_BYTES = 64 << 20

MANIFEST = "path string, num_bytes bigint, sha256 string, archive string"


def write_pack(files: DataFrame, root: str, archives: int = 1, most_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``files`` (path, content) and return the manifest, read back from the pack. There are ``archives`` ranges of paths, and
    more if they would hold over ``most_bytes`` each, so what a task reads doesn't grow with the pack. A path that is missing, goes up or is
    absolute is an error, and so is one that occurs twice. A task streams its range of paths into one archive, under a
    hidden name until it is whole; it holds one batch of files. The manifest comes last: without it there is no pack."""
    spark = files.sparkSession
    checked = F.when(path_problem(F.col("path")).isNull(), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("path refused: "), F.coalesce("path", F.lit("null")))))
    rows = files.select(checked.alias("path"), F.col("content").cast("binary").alias("content"))
    total = files.agg(F.coalesce(F.sum(F.octet_length(F.col("content").cast("binary"))), F.lit(0))).first()[0]
    ranged = rows.repartitionByRange(max(archives, -(-total // most_bytes)), "path").sortWithinPartitions("path")

    def pack(batches):
        name = f"files-{TaskContext.get().partitionId():05d}.tar"
        system, at = opened(root)
        system.create_dir(at, recursive=True)
        part, last, n = f"{at.rstrip('/')}/.{name}.{uuid.uuid4().hex}", None, 0
        with system.open_output_stream(part) as raw, tarfile.open(fileobj=raw, mode="w|", format=tarfile.PAX_FORMAT) as tar:
            for b in batches:
                out = []
                for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                    if path == last:
                        raise ValueError(f"{path} occurs twice")
                    last, content, n = path, content or b"", n + 1
                    info = tarfile.TarInfo(path)  # time, owner and rights are the same for all
                    info.size = len(content)
                    tar.addfile(info, io.BytesIO(content))
                    out.append((path, len(content), hashlib.sha256(content).hexdigest(), name))
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out, strict=True)], names=["path", "num_bytes", "sha256", "archive"]) if out else pa.RecordBatch.from_pylist([], pa.schema([("path", pa.string()), ("num_bytes", pa.int64()), ("sha256", pa.string()), ("archive", pa.string())]))
        if n:
            system.move(part, f"{at.rstrip('/')}/{name}")
        else:
            system.delete_file(part)

    ranged.mapInArrow(pack, MANIFEST).write.mode("overwrite").json(f"{root}/manifest")
    return read_manifest(spark, root)


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("mode", "FAILFAST").json(f"{root}/manifest")


def read_pack(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the files in a pack's archives, a task an archive; files stream through."""
    system, at = opened(root)
    names = sorted(i.path for i in system.get_file_info(afs.FileSelector(at)) if i.base_name.endswith(".tar") and not i.base_name.startswith("."))
    listed = spark.createDataFrame([(n,) for n in names], "archive string").repartition(max(1, len(names)), "archive")

    def unpack(batches):
        for b in batches:
            for name in b.column("archive").to_pylist():
                with opened(root)[0].open_input_stream(name) as raw, tarfile.open(fileobj=raw, mode="r|") as tar:
                    for info in tar:
                        if info.isfile():
                            yield pa.RecordBatch.from_arrays([pa.array([info.name]), pa.array([tar.extractfile(info).read()], pa.binary())], names=["path", "content"])

    return listed.mapInArrow(unpack, "path string, content binary")


def verified_pack(spark: SparkSession, root: str) -> DataFrame:
    """(path, status) of what is missing, extra or changed in a pack against its manifest; no rows: the pack is whole."""
    return verify_pack(read_manifest(spark, root), read_pack(spark, root))


def write_tree(files: DataFrame, root: str) -> int:
    """Write ``files`` (path, content) as files below ``root`` and return how many. Each appears under its name when it is
    whole; a path that is missing, goes up or is absolute is an error."""
    checked = F.when(path_problem(F.col("path")).isNull(), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("path refused: "), F.coalesce("path", F.lit("null")))))

    def write(batches):
        system, at = opened(root)
        made = set()
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                folder, _, name = f"{at.rstrip('/')}/{path}".rpartition("/")
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                part = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write(content or b"")
                system.move(part, f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    return files.select(checked.alias("path"), F.col("content").cast("binary").alias("content")).mapInArrow(write, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def extract(spark: SparkSession, root: str, target: str) -> int:
    """Unpack a pack below ``target``; a pack that doesn't fit its manifest is an error."""
    if wrong := verified_pack(spark, root).limit(5).collect():
        raise ValueError(f"{root} does not fit its manifest: {[tuple(r) for r in wrong]}")
    return write_tree(read_pack(spark, root), target)
