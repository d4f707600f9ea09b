"""Round protocol as a stateful stream, and its batch replay.

Events of a cluster are handled in (ts, event_id) order by one function over one state: uploads of
the current round by client, each with the base it builds on, the round's number and the active
version. The batch replay folds the same function over sorted events, batch by batch, so both give
the same rows. Clusters are independent; the events of one are a sequence by nature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from lodestone.streaming.state import use_rocksdb

CAPACITY, MIN_CLIENTS = 64, 3
OUT = "cluster_id bigint, event_id bigint, round_id bigint, status int, pending int"


@dataclass
class Cluster:
    round_id: int = 0
    uploads: dict[int, tuple[int, int]] = field(default_factory=dict)  # client: examples, base version
    active: int = 0

    def handle(self, kind: str, client: int, claimed: int, n: int) -> int:
        """The status of one event: 201 stored, 200 done, 4xx refused (then nothing changes)."""
        if kind == "upload":
            if claimed != self.round_id:
                return 409
            if client not in self.uploads and len(self.uploads) >= CAPACITY:
                return 429
            self.uploads[client] = (n, self.active)
            return 201
        if kind == "move":
            return 200 if self.uploads.pop(client, None) is not None else 404
        if kind in ("aggregate", "peek"):
            if sum(v > 0 for v, _ in self.uploads.values()) < MIN_CLIENTS:
                return 409  # below quorum the buffer stays
            if kind == "aggregate":
                self.round_id, self.uploads = self.round_id + 1, {}
                self.active = self.round_id
            return 200
        if kind == "restore":  # an older version is served again; what builds on another one goes, the round stays
            if not 0 <= n <= self.round_id:
                return 404
            self.active, self.uploads = n, {k: v for k, v in self.uploads.items() if v[1] == n}
            return 200
        return 422


COLUMNS = ["cluster_id", "event_id", "round_id", "status", "pending"]


def _walk(state: Cluster, cluster: int, pdf: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for e in pdf.sort_values(["ts", "event_id"]).itertuples():
        status = state.handle(e.kind, e.client_id, state.round_id - e.lag, e.num_examples)
        rows.append((cluster, e.event_id, state.round_id, status, len(state.uploads)))
    return pd.DataFrame(rows, columns=COLUMNS)


def replay(events: DataFrame) -> DataFrame:
    """``events``: cluster_id, ts, event_id, kind, client_id, lag (rounds behind the current one), num_examples
    (of a restore: the version). A task reads its clusters' sorted events in batches and holds one state."""

    def run(pdfs):
        now, state = None, None
        for pdf in pdfs:
            for cluster, part in pdf.groupby("cluster_id", sort=False):
                if cluster != now:
                    now, state = cluster, Cluster()
                yield _walk(state, cluster, part)

    dealt = events.repartition("cluster_id").sortWithinPartitions("cluster_id", "ts", "event_id")
    return dealt.mapInPandas(run, OUT)


class Rounds(StatefulProcessor):
    """A value state of the round and the active version, and a map state of the uploads by client."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "round_id long, active long")
        self.uploads = handle.getMapState("uploads", "client long", "examples long, base long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = {k[0]: (v[0], v[1]) for k, v in self.uploads.iterator()}
        round_id, active = self.head.get() if self.head.exists() else (0, 0)
        state = Cluster(round_id, dict(before), active)
        yield _walk(state, key[0], pd.concat(list(rows)))
        self.head.update((state.round_id, state.active))
        for client in before.keys() - state.uploads.keys():
            self.uploads.removeKey((client,))
        for client, upload in state.uploads.items():
            if before.get(client) != upload:  # only what has changed is written
                self.uploads.updateValue((client,), upload)

    def close(self) -> None:
        pass


def stream(events: DataFrame) -> DataFrame:
    """The same over a stream; a micro-batch must not hold events that are older than what came before."""
    use_rocksdb(events.sparkSession)
    return events.groupBy("cluster_id").transformWithStateInPandas(statefulProcessor=Rounds(), outputStructType=StructType.fromDDL(OUT), outputMode="append", timeMode="none")
