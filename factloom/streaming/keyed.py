"""Keyed state over streams by Spark's state API: folded operations, capped histories, fading evidence.

State lies in the RocksDB store, one set of entries per key, and is restored from the query's checkpoint when a stream
is started again. Outputs are in update mode: one row per key that a batch (or a timer) touched.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..runtime import shared_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Event time of one tick in milliseconds; tick 0 is one tick after the epoch, where watermarks begin.
TICK_MS = 1000


class _Fold(StatefulProcessor):
    """Last set or delete of a key, and its appended values in order, at most ``cap`` of the latest."""

    def __init__(self, kind: str, cap: int | None):
        self.kind, self.cap = kind, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", f"seq long, op string, value {self.kind}")
        self.items = handle.getListState("items", f"seq long, value {self.kind}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, listed, changed = self.last.get() if self.last.exists() else None, [], False
        for frame in rows:
            frame = frame.astype({"value": object}).where(frame.notna(), None)
            written = frame[frame["op"].isin(["set", "delete"])]
            if len(written):
                row = written.loc[written["seq"].astype("int64").idxmax()]
                if last is None or int(row["seq"]) >= last[0]:
                    last, changed = (int(row["seq"]), row["op"], row["value"]), True
            listed += [(int(s), v) for s, v, op in zip(frame["seq"], frame["value"], frame["op"], strict=True) if op == "append"]
        if changed:
            self.last.update(last)
        if listed:
            # with a cap the list is read and cut; without one, values are only added
            if self.cap is None:
                self.items.appendList(listed)
            else:
                held = list(self.items.get()) if self.items.exists() else []
                self.items.put(sorted([*map(tuple, held), *listed], key=lambda x: x[0])[-self.cap :])
        items = sorted(map(tuple, self.items.get()), key=lambda x: x[0]) if self.items.exists() else []
        alive = last is not None and last[1] == "set"
        yield pd.DataFrame({"key": [key[0]], "value": [last[2] if alive else None], "is_set": [alive], "items": [[v for _, v in items]]})

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """Keyed state needs the RocksDB store; a session that names one of its own keeps it."""
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def fold_operations(ops: DataFrame, cap: int | None = None) -> DataFrame:
    """Streaming ``key, value, is_set, items`` of operations ``key, seq, op, value``.

    ``set`` and ``delete``: the one with the largest ``seq`` holds, whatever order they come in; ``append``: values in
    order of ``seq`` with repeats, the last ``cap`` if given. A row per key that changed, in update mode. Rows without a
    seq are left out; a deleted key keeps its number, so an earlier set that comes late does not bring it back.
    """
    use_state_store(ops.sparkSession)
    kind = ops.schema["value"].dataType.simpleString()
    name = ops.schema["key"].dataType.simpleString()
    known = ops.filter("seq is not null").select("key", F.col("seq").cast("long").alias("seq"), "op", "value")
    schema = f"key {name}, value {kind}, is_set boolean, items array<{kind}>"
    return known.groupBy("key").transformWithStateInPandas(_Fold(kind, cap), schema, "update", "none")


def history(messages: DataFrame, n: int = 24) -> DataFrame:
    """Streaming ``key, items``: the last n messages of each conversation (``conv_id, turn, role, text``); state holds n rows a key.

    Messages of one turn are ordered by role and text.
    """
    use_state_store(messages.sparkSession)
    rows = messages.select("conv_id", F.struct("turn", "role", "text").alias("m")).select("conv_id", "m.*")
    name = messages.schema["conv_id"].dataType.simpleString()
    return rows.groupBy("conv_id").transformWithStateInPandas(_Recent(n), f"conv_id {name}, history array<struct<turn:long,role:string,text:string>>", "update", "none")


class _Recent(StatefulProcessor):
    """The last n messages of a conversation, in a list that is cut after each batch."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getListState("items", "turn long, role string, text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = list(map(tuple, self.items.get())) if self.items.exists() else []
        order = lambda x: (x[0], x[1] or "", x[2] or "")
        for frame in rows:
            more = zip(frame["turn"], frame["role"].where(frame["role"].notna(), None), frame["text"].where(frame["text"].notna(), None), strict=True)
            held = sorted(held + [(int(t), r, x) for t, r, x in more], key=order)[-self.n :]
        self.items.put(held)
        yield pd.DataFrame({"conv_id": [key[0]], "history": [[{"turn": t, "role": r, "text": x} for t, r, x in held]]})

    def close(self) -> None:
        pass


class _Fade(StatefulProcessor):
    """Evidence of a node that timers halve tick by tick; hits wait until the watermark has passed their tick."""

    def __init__(self, share: float, least: float):
        self.share, self.least = share, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lam = handle.getValueState("lam", "tick long, lam double")
        self.waiting = handle.getMapState("waiting", "tick long", "lam double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done = max(-1, timerValues.getCurrentWatermarkInMs() // TICK_MS - 1)
        held = self.lam.get()[0] if self.lam.exists() else done
        more: dict[int, float] = {}
        for frame in rows:
            for tick, lam in zip(frame["tick"].tolist(), frame["lam"].tolist(), strict=True):
                # a tick that is over takes nothing in any more
                at = max(tick, held + 1, done + 1)
                more[at] = more.get(at, 0.0) + lam
        for tick, lam in more.items():
            before = self.waiting.getValue((tick,))[0] if self.waiting.containsKey((tick,)) else 0.0
            self.waiting.updateValue((tick,), (before + lam,))
        self._wake((self.lam.get()[0] + 1) if self.lam.exists() else self._first())
        return iter([])

    def _first(self) -> int | None:
        ticks = [k[0] for k in self.waiting.keys()]  # noqa: SIM118  a state, not a dict
        return min(ticks) if ticks else None

    def _wake(self, tick: int | None) -> None:
        """One timer, when the tick is over."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if tick is not None:
            self.handle.registerTimer((tick + 1) * TICK_MS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() // TICK_MS - 1  # the last tick that is over
        tick, lam = self.lam.get() if self.lam.exists() else (None, 0.0)
        hits = {k[0]: v[0] for k, v in self.waiting.iterator()}
        at = tick + 1 if tick is not None else min(hits)
        while at <= upto:
            lam = lam * self.share if lam * self.share >= self.least else 0.0
            if at in hits:
                lam += hits.pop(at)
                self.waiting.removeKey((at,))
            if lam == 0.0:
                if not hits or min(hits) > upto:
                    at = upto + 1
                    break
                at = min(hits)
            else:
                at += 1
        if lam > 0:
            self.lam.update((upto, lam))
            self._wake(upto + 1)
        else:
            # a node without evidence keeps no state; what waits wakes it again
            self.lam.clear()
            self._wake(self._first())
        yield pd.DataFrame({"run_id": [key[0]], "uid": [key[1]], "tick": [upto], "lam": [lam]})

    def close(self) -> None:
        pass


def fading_evidence(hits: DataFrame, share: float = 0.5, least: float = 0.05, delay: str = "1 second") -> DataFrame:
    """Streaming ``run_id, uid, tick, lam`` of hits ``run_id, uid, tick, lam`` (ticks from 0): evidence once a tick is over.

    At each tick a node's evidence goes down to its ``share``, is dropped below ``least`` and takes in the tick's hits. A
    tick is over when the watermark (the largest tick less ``delay``, a tick being a second, so by default once a later tick was seen) has passed it; timers then
    fold all ticks up to there, any number of them. Spark drops hits that come behind the watermark. A row with ``lam`` 0 says that a node's state was freed.
    """
    use_state_store(hits.sparkSession)
    timed = hits.filter("tick >= 0 and lam is not null").select("run_id", "uid", F.col("tick").cast("long").alias("tick"), F.col("lam").cast("double").alias("lam"))
    timed = timed.withColumn("ts", F.timestamp_millis((F.col("tick") + 1) * TICK_MS)).withWatermark("ts", delay)
    kinds = {f.name: f.dataType.simpleString() for f in hits.schema.fields}
    schema = f"run_id {kinds['run_id']}, uid {kinds['uid']}, tick long, lam double"
    return timed.groupBy("run_id", "uid").transformWithStateInPandas(_Fade(share, least), schema, "update", "eventTime")


def latest(stream: DataFrame, keys: list[str], checkpoint: str | None = None) -> DataFrame:
    """Drain a stream in update mode and return the last row of each key. Batches go to the shared folder, each once.

    With a ``checkpoint`` the query may be run again over more input: it goes on from its state, and the rows of
    earlier runs are kept beside the new ones.
    """
    spark = stream.sparkSession
    home = checkpoint or f"{shared_folder(spark)}/factloom/keyed-{uuid.uuid4().hex}"

    # a stream without input makes no batch
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{home}/rows/epoch=-1")

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/rows/epoch={epoch}")

    stream.writeStream.outputMode("update").option("checkpointLocation", f"{home}/log").foreachBatch(save).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema.fields)}, epoch long").parquet(f"{home}/rows")
    others = [c for c in stream.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "epoch").alias("_row"))
    return newest.select(*keys, "_row.*")
