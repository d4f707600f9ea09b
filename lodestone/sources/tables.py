"""Parquet table access. Only Spark's readers are used, so any Hadoop file system works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table ``name`` of a directory that holds one Parquet path per table."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
