"""Short keys of the data looked up in texts of the data."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a key at most, and bits that tell the tasks which keys there are.
MOST_LENGTH, BITS = 20, 26
#: Distinct findings that a task holds before it hands them on, and characters that it
#: looks up at once.
HELD, CHUNK = 200_000, 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15)


def slots(text: str, most: int, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each length up to ``most`` the slots of the text's substrings of that
    length, by where they begin."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    value = np.zeros(len(codes), np.uint64)
    for length in range(1, min(most, len(codes)) + 1):
        value = value[: len(codes) - length + 1] * BASE + codes[length - 1 :]
        mixed = value ^ (value >> np.uint64(31))
        yield length, (mixed * BASE) >> np.uint64(64 - bits)


def first_holders(keys: DataFrame, texts: DataFrame, most: int = MOST_LENGTH, bits: int = BITS) -> DataFrame:
    """(key, ord): for each distinct key (key, of 1 to ``most`` characters) the smallest
    ord of the texts (ord, text) that contain it; keys that no text holds, longer ones,
    empty and null ones have no row.

    Keys may be as many as the texts. Tasks are given a bit map of fixed size that says
    which slots keys fall into; of each text the substrings that fall into these are
    handed on as short rows, summed up by their smallest ord, and meet the keys by
    equality. A full bit map costs more rows, not results. Neither texts nor keys pass
    the driver."""
    spark, kind = texts.sparkSession, texts.schema["ord"].dataType.simpleString()
    wanted = keys.select("key").where(F.length("key").between(1, most)).distinct()

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(int(at[0]), length) for key in batch.column(0).to_pylist() for length, at in slots(key, most, bits) if length == len(key)]
            words, marks = np.array([r[0] >> 5 for r in rows], np.int64), np.array([1 << (r[0] & 31) for r in rows], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(marks), pa.array([1 << r[1] for r in rows], pa.int64())], names=["word", "bits", "lengths"])

    found = wanted.mapInArrow(marked, "word long, bits long, lengths long").groupBy("word").agg(F.bit_or("bits").alias("bits"), F.bit_or("lengths").alias("lengths")).toArrow()
    grid = np.zeros(1 << (bits - 5), np.uint32)
    grid[found["word"].to_numpy()] = found["bits"].to_numpy().astype(np.uint32)
    lengths = int(np.bitwise_or.reduce(found["lengths"].to_numpy())) if found.num_rows else 0
    shared = spark.sparkContext.broadcast(grid)

    longest = lengths.bit_length() - 1

    def chunks(batch: pa.RecordBatch) -> Iterator[list[tuple]]:
        """Some (ord, text) of CHUNK characters together, about."""
        some, total = [], 0
        for ord_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if ord_ is not None and text:
                some.append((ord_, text))
                total += len(text)
            if total > CHUNK:
                yield some
                some, total = [], 0
        yield some

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[str, object] = {}
        for batch in batches:
            for some in chunks(batch) if lengths else ():
                whole, owner = "".join(t for _, t in some), np.repeat(np.arange(len(some)), [len(t) for _, t in some])
                for length, at in slots(whole, longest, bits):
                    if not lengths >> length & 1:
                        continue
                    hit = (shared.value[at >> np.uint64(5)] >> (at & np.uint64(31)).astype(np.uint32) & np.uint32(1)).astype(bool)
                    for p in np.flatnonzero(hit & (owner[: len(at)] == owner[length - 1 :])).tolist():
                        piece, ord_ = whole[p : p + length], some[owner[p]][0]
                        if piece not in first or ord_ < first[piece]:
                            first[piece] = ord_
                if len(first) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(list(first), pa.string()), pa.array(list(first.values()), batch.column(0).type)], names=["key", "ord"])
                    first = {}
            kind_ = batch.column(0).type
        if first:
            yield pa.RecordBatch.from_arrays([pa.array(list(first), pa.string()), pa.array(list(first.values()), kind_)], names=["key", "ord"])

    pieces = texts.select("ord", "text").mapInArrow(held, f"key string, ord {kind}").groupBy("key").agg(F.min("ord").alias("ord"))
    return wanted.join(pieces, "key")
