"""Files and folders that appear at once or not at all, on any Hadoop file system with an atomic rename."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class AlreadyThere(Exception):
    """Somebody else has published under this path first."""


def _hadoop(spark: SparkSession):
    return spark.sparkContext._jvm.org.apache.hadoop


def _context(spark: SparkSession, path: str):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return _hadoop(spark).fs.FileContext.getFileContext(_hadoop(spark).fs.Path(path).getFileSystem(conf).getUri(), conf)


def _rename(spark: SparkSession, source: str, target: str, overwrite: bool) -> None:
    kind = getattr(_hadoop(spark).fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE if overwrite else kind.NONE
    path = _hadoop(spark).fs.Path
    _context(spark, target).rename(path(source), path(target), how)


def staged(target: str) -> str:
    """A name beside ``target`` that readers and listings skip."""
    folder, _, name = target.rstrip("/").rpartition("/")
    return f"{folder}/.{name}.{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    _context(spark, path).delete(_hadoop(spark).fs.Path(path), True)


def swap_file(spark: SparkSession, target: str, content: bytes) -> None:
    """Replace or create a file. It is written beside the target, flushed to disk and renamed over it in one step, so
    whoever reads, now or after a crash, finds the old content or the new one."""
    part = staged(target)
    at = _hadoop(spark).fs.Path(part)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        out = fs.create(at, False)
        try:
            out.write(bytearray(content))
            out.hsync()
        finally:
            out.close()
        _rename(spark, part, target, True)
    except BaseException:
        discard(spark, part)
        raise


def publish(spark: SparkSession, part: str, target: str) -> None:
    """Give a finished staged folder its name, if nothing bears it. The second of two writers gets AlreadyThere, and what
    it staged is removed."""
    from py4j.protocol import Py4JJavaError

    try:
        _rename(spark, part, target, False)
    except Py4JJavaError as e:
        there = _context(spark, target).util().exists(_hadoop(spark).fs.Path(target))
        discard(spark, part)
        if there:
            raise AlreadyThere(target) from e
        raise
