"""Event-time state over several runs, each of which goes on from the checkpoint."""

import random

from pyspark.sql import functions as F

from siftline.plans.registered import QUERIES, SQL
from siftline.streaming import eventtime

from .oracle import compare

HOUR, START = 3600, 1_700_000_000


def put(spark, folder, rows):
    made = spark.createDataFrame(rows, "user_id long, s long").select("user_id", F.timestamp_seconds("s").alias("ts"))
    made.coalesce(1).write.mode("append").parquet(folder)


def in_order(events, ttl):
    """The sessions of some seconds, one after the other."""
    out = []
    for s in sorted(events):
        if not out or s - out[-1][0] > ttl:
            out.append([s, s, 0])
        out[-1][1:] = [s, out[-1][2] + 1]
    return [tuple(x) for x in out]


def test_sessions_end_by_event_time_across_restarts(spark, tmp_path):
    rnd, delay, ttl = random.Random(3), 2 * HOUR, 6 * HOUR
    runs = [[(rnd.choice([1, 1, 1, 2, 3, None]), START + 10 * HOUR * i + rnd.randrange(-3 * HOUR, 10 * HOUR)) for _ in range(60)] for i in range(3)]
    runs.append([(None, START + 100 * HOUR)])
    kept, watermark, dropped = {}, None, 0
    for i, rows in enumerate(runs):
        put(spark, str(tmp_path / "in"), rows)
        stream = spark.readStream.schema("user_id long, ts timestamp").parquet(str(tmp_path / "in"))
        got = eventtime.run(eventtime.sessions(stream, "2 hours", ttl), str(tmp_path / "out"), "append").collect()
        for user, s in rows:
            late = watermark is not None and s <= watermark
            dropped += late
            if user is not None and not late:
                kept.setdefault(user, []).append(s)
        watermark = max(watermark or 0, max(s for _, s in rows) - delay)
        want = {(u, c, e, n) for u, events in kept.items() for c, e, n in in_order(events, ttl) if c + ttl < watermark}
        assert {(r.user_id, r.created_ms // 1000, r.last_ms // 1000, r.n_events) for r in got} == want, i
        assert len(got) == len(want)
    assert dropped > 3 and len(want) > 8


def test_windows_keep_the_last_turns(spark, tmp_path):
    runs = [[("a", t, "user", f"t{t}") for t in (3, 1, 2)] + [("b", None, "user", "x"), (None, 1, None, "n")], [("a", t, "bot", f"t{t}") for t in (9, 5, 4)] + [("a", 1, "bot", "old")], [("a", 9, "bot", "again")]]
    for rows in runs:
        spark.createDataFrame(rows, "conv_id string, turn int, role string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("conv_id string, turn int, role string, text string").parquet(str(tmp_path / "in"))
        got = eventtime.run(eventtime.conversation_windows(stream, 3), str(tmp_path / "out"), "update").collect()
    by = {}
    for r in sorted(got, key=lambda r: r.batch):
        by.setdefault(r.conv_id, []).append(r.text)
    assert by == {None: ["n"], "a": ["user: t1\nuser: t2\nuser: t3", "bot: t4\nbot: t5\nbot: t9", "bot: t4\nbot: t5\nbot: again"]}
    assert spark.conf.get(eventtime.PROVIDER).endswith("HDFSBackedStateStoreProvider")


def test_streams_equal_the_batch_forms(spark):
    for name in ("session_event_time", "conversation_window_stream"):
        assert not compare(spark, QUERIES[name], SQL[name], "/root/testdata/sf0.01"), name
