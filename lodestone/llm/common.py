"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.scratch import remove, scratch_path, stored  # noqa: F401


def load(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes, so that very long texts cannot fill a worker. All operators
    ask for the same bounds, so the order in which plans are built doesn't matter."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def materialised(df: DataFrame, label: str) -> DataFrame:
    return stored(df, label)[0]


#: Rows of short columns (ids, hashes, digests) that are broadcast at most: some tens of megabytes.
SMALL_SIDE = 250_000


def small_side(df: DataFrame) -> DataFrame:
    """``df``, a stored table of short columns, for the small side of a join: broadcast if it has at most
    SMALL_SIDE rows, so that the large side needn't move; joined with a shuffle beyond."""
    return F.broadcast(df) if df.limit(SMALL_SIDE + 1).count() <= SMALL_SIDE else df


def share_of(key, wanted: int, total: int):
    """Rows whose hash is in the first wanted / total of its range: about ``wanted`` of ``total`` rows, however
    large ``total`` is. ``key`` is a 64-bit hash column."""
    if total <= wanted:
        return F.lit(True)
    return F.shiftrightunsigned(key.cast("bigint"), 2) < F.lit((wanted << 62) // total)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def no_clash(keep, results: tuple[str, ...]) -> None:
    """An error if a column to keep is named like a result."""
    if clash := sorted({c.lower() for c in keep} & set(results)):
        raise ValueError(f"columns {clash} can't be kept beside results of that name; rename them first")


def held_out(doc_id: str = "doc_id"):
    """The contract's hold-out: crc32 of the id as text leaves 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star steps.

    ``edges`` has two columns of one type, ``a`` and ``b``. Returns ``(node, root)`` for every
    node that has an edge to another one, where ``root`` is the least node of its component.
    Each step replaces neighbourhoods by stars around their minimum, as an aggregation and a
    join; no neighbourhood is collected. Every round is written to the shared folder.
    Loops, nulls and repeated edges are ignored; no edges give no rows.
    """
    spark = edges.sparkSession

    def large(e: DataFrame) -> DataFrame:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()

    def small(e: DataFrame) -> DataFrame:  # here a > b on every row
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        moved = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    start = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, path = stored(start, "cc")
    seen = mark(now)
    for _ in range(max_rounds if seen[0] else 0):
        after, next_path = stored(small(large(now)), "cc")
        was, seen = seen, mark(after)
        remove(spark, path)
        now, path = after, next_path
        if seen == was:
            break
    else:
        if seen[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def shut(*columns: np.ndarray, level: int = 3) -> bytes:
    """Columns as one compressed block; bytes of one place stand together."""
    head = np.array([len(columns), *(len(c) for c in columns)], np.int64).tobytes()
    kinds = "".join(c.dtype.str[1:].ljust(3) for c in columns).encode()
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=level).compress(b"".join([head, kinds, *planes]))


def opened(block: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    k = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, k, 8).tolist()
    at, out = 8 + 8 * k, []
    kinds = [raw[at + 3 * i : at + 3 * i + 3].decode().strip() for i in range(k)]
    at += 3 * k
    for kind, n in zip(kinds, sizes, strict=True):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += n * width
    return out
