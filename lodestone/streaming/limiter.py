"""Token buckets on a stream, with state that ages (R11, R12). The batch form is ``rounds.token_buckets``."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, StructType

from lodestone.streaming.state import use_rocksdb

#: Requests of a row between the state and the result; the start of time.
PACK, EPOCH = 4096, datetime(1970, 1, 1, tzinfo=UTC)


class Buckets(StatefulProcessor):
    """A value state of tokens and the time of the last request; a timer clears what has been idle for ``ttl_s``."""

    def __init__(self, client: str, ts: str, order: str, capacity: float, rate: float, ttl_s: float):
        self.names = client, ts, order
        self.pack = Row(client, order, "allowed")
        self.capacity, self.rate, self.ttl_s = capacity, rate, ttl_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "tokens double, last double")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        _, ts, order = self.names
        held = self.bucket.get()
        tokens, last = held or (self.capacity, None)
        before = last
        orders, allowed = [], []
        for now, which in sorted(((r[ts] - EPOCH).total_seconds(), r[order]) for r in rows):
            idle = 0.0 if last is None else now - last
            tokens = self.capacity if idle >= self.ttl_s else min(self.capacity, tokens + idle * self.rate)
            last = now
            orders.append(which)
            allowed.append(tokens >= 1)
            tokens -= tokens >= 1
        self.bucket.update((tokens, last))
        if before is not None:
            self.handle.deleteTimer(self._expires(before))
        self.handle.registerTimer(self._expires(last))
        for i in range(0, len(orders), PACK):
            yield self.pack(*key, orders[i : i + PACK], allowed[i : i + PACK])

    def _expires(self, last: float) -> int:
        return int((last + self.ttl_s) * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.bucket.clear()
        return iter([])

    def close(self) -> None:
        pass


def token_buckets(requests: DataFrame, client: str, ts: str, order: str, capacity: float, rate: float, ttl_s: float, lateness: str = "1 second") -> DataFrame:
    """``allowed`` for each request of a stream: a bucket of ``capacity`` starts full, gains ``rate`` tokens a second and
    loses one a request; a bucket idle for ``ttl_s`` seconds starts anew, and its state is cleared once the watermark
    has passed that time, so state is held for the clients of the last ``ttl_s`` only.

    Requests of a client are handled in the order of (``ts``, ``order``) inside a micro-batch; a micro-batch must not
    hold requests before those of earlier ones. What lies ``lateness`` or more behind the newest
    request of an earlier micro-batch is dropped.
    """
    use_rocksdb(requests.sparkSession)
    kinds = requests.schema
    out = StructType().add(client, kinds[client].dataType).add(order, ArrayType(kinds[order].dataType)).add("allowed", ArrayType(BooleanType()))
    marked = requests.select(client, ts, order).withWatermark(ts, lateness)
    packed = marked.groupBy(client).transformWithState(statefulProcessor=Buckets(client, ts, order, capacity, rate, ttl_s), outputStructType=out, outputMode="append", timeMode="eventTime")
    return packed.select(client, F.inline(F.arrays_zip(order, "allowed")))
