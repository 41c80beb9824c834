"""Sessions that end a fixed time after they were made."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TTL_SECONDS = 86_400


def live_sessions(events: DataFrame, now: str, ttl: int = TTL_SECONDS) -> DataFrame:
    """(user_id, created, last_access, n_events, live) of (user_id, ts): a session
    lives while its age, from its first event, is at most ``ttl``."""
    s = events.groupBy("user_id").agg(F.min("ts").alias("created"), F.max("ts").alias("last_access"), F.count("*").alias("n_events"))
    return s.withColumn("live", F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("created") <= ttl)


def conversation_window(turns: DataFrame, n: int = 10) -> DataFrame:
    """(conv_id, text): the last n turns of each conversation, one line each."""
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    last = turns.withColumn("rank", rank).where(F.col("rank") <= n)
    joined = last.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line")))).alias("t"))
    return joined.select("conv_id", F.array_join("t.line", "\n").alias("text"))


def session_stream(events: DataFrame, ttl: int = TTL_SECONDS, expire: bool = True) -> DataFrame:
    """(user_id, created_ms, last_ms, n_events) of a stream of (user_id, ts): events of
    a user within ``ttl`` of a session's first belong to it, a later one opens a new
    session. A batch gives a row for each session that it met; of several rows of one
    session the one with the most events is the last. State goes when no event comes
    for the time a session lives, unless ``expire`` is false: a stream that ends would
    wait for that time."""
    import pandas as pd

    def step(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        created, last, n = state.get if state.exists else (None, None, 0)
        rows = []
        for ms in sorted(pd.Timestamp(ts).value // 1_000_000 for f in frames for ts in f["ts"].dropna()):
            if created is None or ms - created > ttl * 1000:
                if created is not None:
                    rows.append((created, last, n))
                created, last, n = ms, ms, 0
            last, n = max(last, ms), n + 1
        if created is not None:
            rows.append((created, last, n))
            state.update((created, last, n))
            if expire:
                state.setTimeoutDuration(ttl * 1000)
        yield pd.DataFrame({"user_id": [key[0]] * len(rows), "created_ms": [r[0] for r in rows], "last_ms": [r[1] for r in rows], "n_events": [r[2] for r in rows]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, created_ms long, last_ms long, n_events long", "created long, last long, n long", "update", "ProcessingTimeTimeout" if expire else "NoTimeout")


def sessions_of(events: DataFrame, path: str, ttl: int = TTL_SECONDS) -> DataFrame:
    """All sessions of a stream that has an end, written under ``path`` (which driver
    and executors share) as its batches are done."""
    spark = events.sparkSession
    rows = session_stream(events, ttl, expire=False)
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
    rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(rows.schema).parquet(f"{path}/rows")
    last = Window.partitionBy("user_id", "created_ms").orderBy(F.desc("n_events"))
    return found.withColumn("rank", F.row_number().over(last)).where("rank = 1").select(*rows.columns)
