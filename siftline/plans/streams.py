"""Queries of streams with event-time state, with the SQL of their batch forms."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftline.plans.queries import SQL, query, read
from siftline.sources import tables
from siftline.streaming import eventtime


@query(SQL["session_stream"])
def session_event_time(spark, sf_dir):
    """The events as a stream of files, whose sessions end by the watermark."""
    rows, path = read(spark, sf_dir, "events").select("user_id", "ts"), tables.new_folder(spark, "sessions")
    last = rows.agg(F.max("ts")).first()[0]
    if last is None:
        return spark.createDataFrame([], "user_id long, created_ms long, last_ms long, n_events long")
    stream = tables.streamed(spark, sf_dir, "events").select("user_id", "ts")
    try:
        ended = eventtime.closed(stream, f"{path}/end", last + timedelta(seconds=3 * eventtime.TTL_SECONDS))
        return tables.written(eventtime.run(eventtime.sessions(ended), path, "append").drop("batch"), "sessions")
    finally:
        tables.delete(spark, path)


@query(SQL["conversation_window"])
def conversation_window_stream(spark, sf_dir):
    """The turns as a stream of files, each conversation's last ten held as state."""
    path = tables.new_folder(spark, "turns")
    turns = tables.streamed(spark, sf_dir, "conversations")
    try:
        found = eventtime.run(eventtime.conversation_windows(turns), path, "update")
        newest = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("batch")))
        return tables.written(found.withColumn("n", newest).where("n = 1").select("conv_id", "text"), "turns")
    finally:
        tables.delete(spark, path)
