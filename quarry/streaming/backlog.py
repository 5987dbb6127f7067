"""STR-3: the re-index backlog as a leased work queue in streaming state.

Versions that lack an index wait in the state of their document's shard. Each tick leases the
first ``limit`` that are free: not leased before, or given back, or with a lease run out, and of
a document that no other worker holds. A result takes a version out, or gives it back for the
next tick. Results of attempts that are settled already change nothing, so a batch that runs
twice leaves the same queue.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LIMIT, LEASE, SHARDS = 20, 5, 16
#: Within a tick, results count first, then changes and holds; then the tick leases.
ORDER = {"result": 0, "change": 1, "hold": 2, "tick": 3}
EVENTS = "kind string, tick bigint, version_id bigint, document_id bigint, wanted boolean, attempt int, ok boolean"
LEASED = "shard int, tick long, version_id long, document_id long, attempt int"


def candidates(versions: DataFrame, docs: DataFrame) -> DataFrame:
    """QLT-13's condition as a column ``wanted``: published, valid, index pending or failed, of a live document."""
    live = docs.select("document_id", F.lit(True).alias("live_")).distinct()
    wanted = "workflow_status = 'published' and validity_status in ('active', 'legacy_active') and index_status in ('pending', 'failed') and live_"
    return versions.join(live, "document_id", "left").select("version_id", "document_id", F.coalesce(F.expr(wanted), F.lit(False)).alias("wanted"))


def events(kind: str, rows: DataFrame) -> DataFrame:
    """Rows as events of one kind: change (version_id, document_id, wanted), hold (document_id until ``tick``), result (version_id, document_id, attempt, ok), tick."""
    kinds = dict(x.rsplit(" ", 1) for x in EVENTS.split(", "))
    return rows.select(*[F.lit(kind).alias(c) if c == "kind" else (F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])


#: Ids of a page: one value of the state holds all entries of as many ids in a row, sorted, so that state is not called for each.
PAGE = 1 << 14
ENTRY = np.dtype([("id", "<i8"), ("document", "<i8"), ("attempts", "<i4"), ("leased", "<i8")])
HOLD = np.dtype([("id", "<i8"), ("until", "<i8")])


def _rows(kind: np.dtype, *columns) -> np.ndarray:
    """Entries of a page, one for each id: the first of its rows."""
    out = np.empty(len(columns[0]), kind)
    for name, values in zip(kind.names, columns):
        out[name] = values
    return out[np.unique(out["id"], return_index=True)[1]]


class _Pages:
    """Entries of one kind in a map state, by page."""

    def __init__(self, state, kind: np.dtype):
        self.state, self.kind = state, kind

    def get(self, page: int) -> np.ndarray:
        return np.frombuffer(bytes(self.state.getValue((page,))[0]), self.kind) if self.state.containsKey((page,)) else np.empty(0, self.kind)

    def put(self, page: int, rows: np.ndarray) -> None:
        if len(rows):
            self.state.updateValue((page,), (rows.tobytes(),))
        elif self.state.containsKey((page,)):
            self.state.removeKey((page,))

    def all(self):
        for key, value in self.state.iterator():
            yield key[0], np.frombuffer(bytes(value[0]), self.kind)


class BacklogProcessor(StatefulProcessor):
    """One shard's queue: version -> (document, attempts, tick of its lease or -1), and documents that others hold until a tick."""

    def __init__(self, limit: int, lease: int):
        self.limit, self.lease = limit, lease

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.queue = handle.getMapState("queue", "page long", "entries binary")
        self.held = handle.getMapState("held", "page long", "entries binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat([r.assign(order=r["kind"].map(ORDER).astype("int8")).drop(columns="kind") for r in rows])
        found = found.sort_values(["tick", "order", "version_id", "attempt"], kind="stable")
        leased = []
        for (tick, order), group in found.groupby(["tick", "order"]):  # in their order
            if order == ORDER["tick"]:
                for _ in range(len(group)):
                    leased += self._lease(int(tick), int(key[0]))
            elif order == ORDER["hold"]:
                self._hold(group["document_id"].to_numpy(np.int64), int(tick))
            elif order == ORDER["change"]:
                self._change(group["version_id"].to_numpy(np.int64), group["document_id"].to_numpy(np.int64), group["wanted"].to_numpy(bool))
            else:
                self._result(group["version_id"].to_numpy(np.int64), group["attempt"].to_numpy(np.int64), group["ok"].to_numpy(bool))
        yield pd.DataFrame(leased, columns=["shard", "tick", "version_id", "document_id", "attempt"]).astype({"shard": "int32", "tick": "int64", "version_id": "int64", "document_id": "int64", "attempt": "int32"})

    def _hold(self, documents: np.ndarray, tick: int) -> None:
        pages, held = documents // PAGE, _Pages(self.held, HOLD)
        for page, at in pd.Series(pages).groupby(pages).indices.items():
            known = held.get(int(page))
            held.put(int(page), _rows(HOLD, np.r_[documents[at], known["id"]], np.r_[np.full(len(at), tick), known["until"]]))

    def _change(self, versions: np.ndarray, documents: np.ndarray, wanted: np.ndarray) -> None:
        """Of a version's rows, sorted by version: one that is not wanted takes it out; the first that is wanted after that puts it in, where it is not in."""
        number = np.arange(len(versions))
        first = np.searchsorted(versions, versions)
        out = np.full(len(versions), -1)
        np.maximum.at(out, first[~wanted], number[~wanted])
        comes = wanted & (number > out[first])
        pages, queue = versions // PAGE, _Pages(self.queue, ENTRY)
        for page, at in pd.Series(pages).groupby(pages).indices.items():
            known, new = queue.get(int(page)), at[comes[at]]
            known = known[~np.isin(known["id"], versions[at[~wanted[at]]])]
            columns = (np.r_[known["id"], versions[new]], np.r_[known["document"], documents[new]], np.r_[known["attempts"], np.zeros(len(new), int)], np.r_[known["leased"], np.full(len(new), -1)])
            queue.put(int(page), _rows(ENTRY, *columns))

    def _result(self, versions: np.ndarray, attempts: np.ndarray, ok: np.ndarray) -> None:
        pages, queue = versions // PAGE, _Pages(self.queue, ENTRY)
        for page, at in pd.Series(pages).groupby(pages).indices.items():
            known = queue.get(int(page)).copy()
            stays = np.ones(len(known), bool)
            for i in at:
                place = np.searchsorted(known["id"], versions[i])
                if place < len(known) and known["id"][place] == versions[i] and stays[place] and known["attempts"][place] == attempts[i] and known["leased"][place] >= 0:
                    stays[place] = not ok[i]
                    known["leased"][place] = -1
            queue.put(int(page), known[stays])

    def _lease(self, tick: int, shard: int) -> list[tuple]:
        held, queue, ids = _Pages(self.held, HOLD), _Pages(self.queue, ENTRY), [np.empty(0, np.int64)]
        for page, rows in list(held.all()):
            stays = rows["until"] > tick
            if not stays.all():
                held.put(page, rows[stays])
            ids.append(rows["id"][stays])
        until = np.sort(np.concatenate(ids))
        free: dict[int, np.ndarray] = {}
        for page, rows in queue.all():
            rows = rows[(rows["leased"] < 0) | (tick - rows["leased"] >= self.lease)]
            place = np.searchsorted(until, rows["document"])
            rows = rows[(place == len(until)) | (until[np.minimum(place, len(until) - 1)] != rows["document"])] if len(until) else rows
            if len(rows):
                free[page] = rows["id"][: self.limit].copy()
        out, left = [], self.limit
        for page in sorted(free):
            if left <= 0:
                break
            rows = queue.get(page).copy()
            at = np.searchsorted(rows["id"], free[page][:left])
            rows["attempts"][at] += 1
            rows["leased"][at] = tick
            queue.put(page, rows)
            out += [(shard, tick, int(r["id"]), int(r["document"]), int(r["attempts"])) for r in rows[at]]
            left -= len(at)
        return out

    def close(self) -> None:
        pass


def backlog_stream(source: DataFrame, *, limit: int = LIMIT, lease: int = LEASE, shards: int = SHARDS) -> DataFrame:
    """Leases (shard, tick, version_id, document_id, attempt) of a stream of ``events``; needs the RocksDB state store.

    A document's versions and holds share a shard; a tick goes to all. ``limit`` holds for
    each shard and tick: a shard is a worker. A lease without a result comes back after
    ``lease`` ticks.
    """
    shard = F.when(F.col("kind") == "tick", F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(F.array(F.pmod("document_id", F.lit(shards)).cast("int")))
    rows = source.select(F.explode(shard).alias("shard"), "*")
    schema = "shard int, " + EVENTS
    assert [c.split()[0] for c in schema.split(", ")] == rows.columns
    return rows.groupBy("shard").transformWithStateInPandas(BacklogProcessor(limit, lease), LEASED, "Append", "None")


def clock(spark: SparkSession, seconds: int = 60) -> DataFrame:
    """A live stream of ticks, one each ``seconds``, numbered from 0."""
    rate = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("advanceMillisPerBatch", seconds * 1000).load()
    return events("tick", rate.select(F.col("value").alias("tick")))


def work(leases: DataFrame, reindex: Callable[[DataFrame], DataFrame], results: str, checkpoint: str, *, interval: str | None = "60 seconds", log: str | None = None):
    """Runs ``reindex`` (leases -> version_id, document_id, attempt, ok) on each batch of leases; the results come back by the folder ``results``.

    A batch writes into a folder of its own, which a second run of it replaces. ``log`` is a
    folder for the leases with their outcome.
    """

    def handle(df: DataFrame, n: int) -> None:
        if df.isEmpty():  # an empty result would be news, and wake the next batch
            return
        done = reindex(df).persist()
        if log:
            df.join(done.select("version_id", "attempt", "ok"), ["version_id", "attempt"], "left").write.mode("overwrite").parquet(f"{log}/batch={n}")
        settled = events("result", done.join(df.select("version_id", "tick"), "version_id"))
        settled.write.mode("overwrite").parquet(f"{results}/batch={n}")
        done.unpersist()

    writer = leases.writeStream.foreachBatch(handle).outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer).start()
