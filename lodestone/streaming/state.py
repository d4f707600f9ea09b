"""What stateful streams need of a session, and a run over all that has arrived."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state with timers lives in the RocksDB store, on executors' disks with changelogs in the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def drained(out: DataFrame, path: str, checkpoint: str, timeout_s: int = 3600) -> None:
    """Appends to ``path`` what a stream gives for all input there is, and stops. Another call with the same checkpoint
    goes on where this one ended, or where it failed."""
    q = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    try:
        if not q.awaitTermination(timeout_s):
            raise TimeoutError(f"the stream into {path} has not ended after {timeout_s} s")
    finally:
        q.stop()
