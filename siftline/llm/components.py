"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_scratch, scratch


#: Ids that a task's forest holds before it is handed on.
FOREST_IDS = 1 << 20


class Forest:
    """Union-find over any ids; the smallest id of a tree is its root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def stars(self) -> pa.RecordBatch:
        """Every id but the smallest of each tree, with that smallest id."""
        every = list(self.up)
        return pa.RecordBatch.from_arrays([pa.array([self.root(x) for x in every], pa.int64()), pa.array(every, pa.int64())], names=["a", "b"])

    def full(self) -> Iterator[pa.RecordBatch]:
        """The stars of a forest that has grown to its bound, which starts anew."""
        if len(self.up) >= FOREST_IDS:
            yield self.stars()
            self.up = {}


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of links (a, b) to stars that join the same ids, of the links of one
    task: at most one for each id there."""
    trees = Forest()
    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            trees.join(a, b)
        yield from trees.full()
    yield trees.stars()


def components(links: DataFrame) -> DataFrame:
    """(id, label) of every id in ``links`` (columns a, b, both long and not
    null); label is the smallest id that can be reached.

    Each task first joins its own links and hands on stars, so that dense links weigh
    no more than the ids. Each round takes the smallest label of the neighbours and
    then the label's own label, so that the rounds grow with the logarithm of a
    chain's length. Each round is written to the shared folder; nothing is collected
    but a count. An empty table gives an empty one; loops and repeated links change
    nothing."""
    stars = links.select("a", "b").mapInArrow(contracted, "a long, b long").distinct()
    edges = scratch(stars.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).select("col.*"), "edges")
    written = scratch(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("label")), "labels")
    while True:
        label = written.select("id", "label")
        near = edges.join(label, edges.b == label.id).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        lower = label.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = label.select(F.col("id").alias("label"), F.col("label").alias("up"))
        after = scratch(lower.join(up, "label").select("id", "old", F.least("label", "up").alias("label")), "labels")
        drop_scratch(written)
        written = after
        if written.where("old <> label").isEmpty():
            drop_scratch(edges)
            out = written.select("id", "label")
            out.scratch_path = written.scratch_path
            return out
