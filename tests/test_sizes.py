"""Queries on inputs that the small tables don't have."""

from siftline.plans.registered import QUERIES, SQL

from .oracle import compare


def test_key_segments_of_texts_with_one_part(spark, tmp_path):
    texts = ["a sentence of one part, ab", "no punctuation in a text of some length", "x" * 20, "one part. and, a second part", "", None, "ab, cd"]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = QUERIES["key_segments"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in rows) == [(0, "a sentence of one part"), (1, texts[1]), (2, texts[2]), (3, "a second part"), (3, "one part")]
    assert not compare(spark, QUERIES["key_segments"], SQL["key_segments"], "/root/testdata/sf0.1")


def test_streams_read_tables_of_several_files(spark, tmp_path):
    """A table that is a folder of files; the sizes up to sf0.1 have one file each."""
    for name in ("conversations", "events"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name in ("conversation_window_stream", "session_event_time", "session_stream"):
        got, want = (sorted(map(str, QUERIES[name](spark, folder).collect())) for folder in (str(tmp_path), "/root/testdata/sf0.001"))
        assert got == want and want, name
