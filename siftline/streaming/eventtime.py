"""Sessions and conversation windows as state that follows the events' own time.

Both keep their state in Spark's RocksDB store (``rocksdb`` sets it for a start), which
survives a restart from the checkpoint."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import LongType, StructField, StructType

from siftline.streaming.sessions import TTL_SECONDS

#: Turns of a conversation that are kept.
TURNS = 10
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep state in RocksDB; the setting is put back after."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


class Sessions(StatefulProcessor):
    """A session begins with an event that no session holds and holds the events until
    ``ttl`` after. Where it begins is certain when the watermark has passed: events wait
    until then (one entry a millisecond, so as many as the watermark's delay has), later
    ones only add to the session's numbers. When the watermark passes the session's end
    its row goes out, once."""

    def __init__(self, ttl: int):
        self.ttl = ttl * 1000

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "created long, last long, n long")
        self.waiting = handle.getListState("waiting", "ms long, n long")

    def handleInputRows(self, key, rows, timerValues):
        opened = self.open.get() if self.open.exists() else None
        waiting = self._waiting()
        for row in rows:
            if key[0] is None or row.ms is None:
                continue
            if opened and row.ms <= opened[0] + self.ttl:
                if row.ms >= opened[0]:
                    opened = (opened[0], max(opened[1], row.ms), opened[2] + 1)
            else:
                waiting[row.ms] = waiting.get(row.ms, 0) + 1
        self._keep(opened, waiting)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs()
        opened = self.open.get() if self.open.exists() else None
        waiting, out = self._waiting(), []
        while True:
            if opened is None:
                first = min(waiting, default=None)
                if first is None or first >= passed:
                    break
                opened = (first, first, 0)
            own = [ms for ms in waiting if ms <= opened[0] + self.ttl]
            opened = (opened[0], max([opened[1], *own]), opened[2] + sum(waiting.pop(ms) for ms in own))
            if passed <= opened[0] + self.ttl:
                break
            out.append(Row(user_id=key[0], created_ms=opened[0], last_ms=opened[1], n_events=opened[2]))
            opened = None
        self._keep(opened, waiting)
        return iter(out)

    def close(self) -> None:
        pass

    def _waiting(self) -> dict[int, int]:
        return {ms: n for ms, n in self.waiting.get()} if self.waiting.exists() else {}

    def _keep(self, opened: tuple | None, waiting: dict[int, int]) -> None:
        """Write the state, with the one timer that it needs next."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if opened:
            self.open.update(tuple(opened))
        else:
            self.open.clear()
        if waiting:
            self.waiting.put(sorted(waiting.items()))
        else:
            self.waiting.clear()
        if opened or waiting:
            self.handle.registerTimer(opened[0] + self.ttl + 1 if opened else min(waiting) + 1)


def sessions(events: DataFrame, delay: str = "1 hour", ttl: int = TTL_SECONDS) -> DataFrame:
    """(user_id, created_ms, last_ms, n_events) of a stream of (user_id, ts): one final
    row a session, when the watermark, ``delay`` behind the latest event, has passed its
    end. Events behind the watermark are dropped, as are those without user or time;
    the others give the sessions that they'd give in order, however they come."""
    timed = events.select("user_id", "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms")).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    user = events.schema["user_id"].dataType.simpleString()
    return timed.groupBy("user_id").transformWithState(Sessions(ttl), f"user_id {user}, created_ms long, last_ms long, n_events long", "append", "eventTime")


class Turns(StatefulProcessor):
    """The last turns of a conversation, in order."""

    def __init__(self, most: int, live_ms: int | None):
        self.most, self.live_ms = most, live_ms

    def init(self, handle) -> None:
        self.turns = handle.getListState("turns", "turn long, role string, text string", self.live_ms)

    def handleInputRows(self, key, rows, timerValues):
        kept = {t[0]: tuple(t) for t in self.turns.get()} if self.turns.exists() else {}
        for row in rows:
            if row.turn is None:
                continue
            own = (row.turn, row.role, row.text)
            kept[row.turn] = own
            if len(kept) > self.most:
                kept.pop(min(kept))
        if not kept:
            return iter(())
        last = [kept[t] for t in sorted(kept)]
        self.turns.put(last)
        return iter([Row(conv_id=key[0], last=last[-1][0], text="\n".join(": ".join(x for x in t[1:] if x is not None) for t in last))])

    def close(self) -> None:
        pass


def conversation_windows(turns: DataFrame, most: int = TURNS, live_seconds: int | None = None) -> DataFrame:
    """(conv_id, last, text) of a stream of (conv_id, turn, role, text): a conversation's
    last ``most`` turns, one line each, after every batch that adds to it; ``last`` is the
    greatest turn. A turn that comes again replaces itself; null turns are left out. A
    conversation is forgotten ``live_seconds`` after its last batch, if that is given."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    live = live_seconds * 1000 if live_seconds else None
    return rows.groupBy("conv_id").transformWithState(Turns(most, live), f"conv_id {kind}, last long, text string", "update", "processingTime" if live else "none")


def run(rows: DataFrame, path: str, mode: str, more: Callable[[DataStreamWriter], DataStreamWriter] = lambda w: w) -> DataFrame:
    """Take all that a stream has, write its rows under ``path`` (which driver and
    executors share) and give those of all runs so far, with ``batch``, their number. A
    batch that is done again after a failure replaces its own files, so each row is there
    once; the state is beside them and a later run goes on from it."""
    spark = rows.sparkSession
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
    with rocksdb(spark):
        more(rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(StructType([*rows.schema.fields, StructField("batch", LongType())])).parquet(f"{path}/rows")


def closed(events: DataFrame, path: str, after: datetime) -> DataFrame:
    """``events`` (user_id, ts) of a stream that ends, and one event of no user at
    ``after``, by which the watermark passes the last sessions; ``path`` is for its file."""
    spark, schema = events.sparkSession, events.schema
    spark.createDataFrame([(None, after)], StructType([StructField(f.name, f.dataType) for f in schema])).coalesce(1).write.parquet(path)
    return events.unionByName(spark.readStream.schema(schema).parquet(path))
