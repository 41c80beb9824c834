"""Codes of vectors by codebooks of whole numbers.

A component x counts as floor(256 * x). Vectors are cut into PARTS equal parts; each
part position has a codebook of at most ENTRIES entries, at first the parts of the
vectors with the smallest ids. A round assigns every part to its nearest entry
(squared distance, ties to the lower index) and replaces each entry by the floor of
its parts' mean; after ROUNDS of them parts are assigned once more.

The nearest entry is found by a vantage-point tree over the entries of each position:
a node holds an entry and the range of the distances of the others below it, on
either side of their median. Whole batches of parts go down the tree at once. The
first way down gives every part a near entry; then all nodes are visited that may
hold one as near, by the triangle inequality with distances rounded away from the
bound, and also where the bound is met exactly, as a tie may have a lower index.
Distances that decide are whole numbers of 64 bits.

Dropped are vectors that are null, empty or hold null or non-finite components, and
those that can't be cut or compared: of a length that PARTS doesn't divide, or another
than the first vector's (the one with the smallest id). A component of 2**26 or more
in absolute value, as a whole number, raises an error, as sums of squares must fit 64 bits.
Null ids come last. Rows with the same id count each, in the order of their components.
With fewer vectors than ENTRIES the codebooks are shorter; an empty table gives an
empty result. Null labels count as equal. Other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import scratch

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries of a leaf, which are compared one by one.
LEAF = 4
LARGEST = 1 << 26


@dataclass
class Node:
    """Entries (rows of the codebook) of a leaf; else the vantage point and, for the
    two children, the least and greatest distance of their entries from it."""

    entries: np.ndarray
    point: int = -1
    low: tuple[float, float] = (0.0, 0.0)
    high: tuple[float, float] = (0.0, 0.0)
    children: list[Node] = field(default_factory=list)


def root_of(square: np.ndarray, up: bool) -> np.ndarray:
    """The root of whole numbers, rounded up or down."""
    return np.nextafter(np.sqrt(square.astype(np.float64)), np.inf if up else -1.0)


def tree(codebook: np.ndarray, entries: np.ndarray | None = None) -> Node:
    """A vantage-point tree; its point is the entry that is farthest from the first."""
    entries = np.arange(len(codebook)) if entries is None else entries
    if len(entries) <= LEAF:
        return Node(entries)
    far = ((codebook[entries] - codebook[entries[0]]) ** 2).sum(axis=1)
    point = int(entries[np.argmax(far)])
    rest = entries[entries != point]
    square = ((codebook[rest] - codebook[point]) ** 2).sum(axis=1)
    order = np.argsort(square, kind="stable")
    halves = [order[: len(order) // 2], order[len(order) // 2 :]]
    return Node(
        entries,
        point,
        tuple(float(root_of(square[h].min(), False)) for h in halves),
        tuple(float(root_of(square[h].max(), True)) for h in halves),
        [tree(codebook, np.sort(rest[h])) for h in halves],
    )


def nearest(top: Node, codebook: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, ties to the lower; squared distance) of every row."""
    best = np.full(len(parts), -1, np.int64)
    least = np.full(len(parts), np.iinfo(np.int64).max, np.int64)

    def try_entry(entry: int, rows: np.ndarray) -> np.ndarray:
        square = ((parts[rows] - codebook[entry]) ** 2).sum(axis=1)
        better = (square < least[rows]) | ((square == least[rows]) & (entry < best[rows]))
        hit = rows[better]
        best[hit], least[hit] = entry, square[better]
        return square

    def first_way(node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if not node.children:
            for entry in node.entries.tolist():
                try_entry(entry, rows)
            return
        square = try_entry(node.point, rows)
        inside = np.sqrt(square.astype(np.float64)) <= (node.high[0] + node.low[1]) / 2
        first_way(node.children[0], rows[inside])
        first_way(node.children[1], rows[~inside])

    def visit(node: Node, rows: np.ndarray) -> None:
        if not node.children:
            for entry in node.entries.tolist():
                try_entry(entry, rows)
            return
        square = try_entry(node.point, rows)
        under, over = root_of(square, False), root_of(square, True)
        for child, low, high in zip(node.children, node.low, node.high, strict=True):
            bound = root_of(least[rows], True)
            may = (under - high <= bound) & (low - over <= bound)
            if may.any():
                visit(child, rows[may])

    every = np.arange(len(parts))
    first_way(top, every)
    if len(parts):
        visit(top, every)
    return best, least


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def assigned(codebooks: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each part of each row; codebooks: (part, entry, component)."""
    n, width = len(values), codebooks.shape[2]
    index, square = np.empty((n, PARTS), np.int64), np.empty((n, PARTS), np.int64)
    for p in range(PARTS):
        index[:, p], square[:, p] = nearest(tree(codebooks[p]), codebooks[p], np.ascontiguousarray(values[:, p * width : (p + 1) * width]))
    return index, square


def summed(codebooks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (whole) to the sums of one task: (part, entry, n, sums)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = codebooks.value
        entries, width = books.shape[1:]
        count = np.zeros((PARTS, entries), np.int64)
        sums = np.zeros((PARTS, entries, width), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            values = matrix(batch.column(0))
            index, _ = assigned(books, values)
            for p in range(PARTS):
                count[p] += np.bincount(index[:, p], minlength=entries)
                np.add.at(sums[p], index[:, p], values[:, p * width : (p + 1) * width])
        part, entry = (x.reshape(-1) for x in np.meshgrid(np.arange(PARTS), np.arange(entries), indexing="ij"))
        offsets = (np.arange(PARTS * entries + 1) * width).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(count.reshape(-1)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(sums.reshape(-1)))], names=["part", "entry", "n", "sums"])

    return run


def coded(codebooks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (vec_id, label, whole) to (vec_id, label, code, error)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, square = assigned(codebooks.value, matrix(batch.column(2))) if batch.num_rows else (np.zeros((0, PARTS), np.int64), np.zeros((0, PARTS), np.int64))
            digits = index.astype(np.uint8).tobytes().hex()
            code = [digits[2 * PARTS * i : 2 * PARTS * (i + 1)] for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(square.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    return run


def whole(vector: Column) -> Column:
    """floor(SCALE * x) of each component; an error where one is too large."""
    number = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))
    large = F.exists(vector, lambda x: F.abs(x.cast("double")) * SCALE >= LARGEST)
    return F.when(large, F.raise_error(F.lit(f"a component of {LARGEST // SCALE} or more is beyond the codes' arithmetic"))).otherwise(number)


def usable(vector: Column) -> Column:
    """Whether all components are finite numbers and the parts are equal."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & (F.size(vector) % PARTS == 0) & finite, F.lit(False))


def codes(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector that has a code."""
    spark = vectors.sparkSession
    kept = vectors.where(usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), "label", whole(F.col("embedding")).alias("whole"))
    # a bounded number of rows: the first entries of the codebooks
    start = kept.orderBy(F.col("vec_id").asc_nulls_last(), "whole").select("whole").limit(1).collect()
    width = len(start[0].whole) if start else PARTS
    kept = kept.where(F.size("whole") == width)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "whole").select("whole").limit(entries).collect()
    rows = np.array([r.whole for r in first], np.int64).reshape(len(first), PARTS, width // PARTS)
    books = np.ascontiguousarray(rows.transpose(1, 0, 2))
    for _ in range(rounds if first else 0):
        shared = spark.sparkContext.broadcast(books)
        sums = kept.select("whole").mapInArrow(summed(shared), "part long, entry long, n long, sums array<long>")
        width_of = books.shape[2]
        total = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[j]) for j in range(width_of))).alias("sums")).where("n > 0").collect()
        books = books.copy()
        for r in total:
            books[r.part, r.entry] = [x // r.n for x in r.sums]
        shared.destroy()
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    shared = spark.sparkContext.broadcast(books)
    label = vectors.schema["label"].dataType.simpleString()
    out = scratch(kept.mapInArrow(coded(shared), f"vec_id long, label {label}, code string, error long"), "codes")
    shared.destroy()
    sums = out.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return out.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _assign(name: str, books: str) -> str:
    """SQL that assigns every part to the nearest entry of ``books``."""
    return f"""{name} AS MATERIALIZED (
    SELECT vec_id, label, part, arg_min(entry, (d, entry)) entry, min(d) d, any_value(v) v
    FROM (SELECT p.*, b.entry, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) d FROM parts p JOIN {books} b USING (part))
    GROUP BY vec_id, label, part)"""


def _moved(name: str, books: str, assigned: str) -> str:
    means = "SELECT part, entry, list(m ORDER BY i) v FROM (SELECT part, entry, i, CAST(floor_div(sum(x), count(*)) AS BIGINT) m FROM (SELECT part, entry, unnest(v) x, generate_subscripts(v, 1) i FROM {0}) GROUP BY part, entry, i) GROUP BY part, entry".format(assigned)
    return f"{name} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) v FROM {books} b LEFT JOIN ({means}) m USING (part, entry))"


SQL_OP13 = f"""
WITH kept AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
    SELECT vec_id, label, p part, v[p * (len(v) // {PARTS}) + 1:(p + 1) * (len(v) // {PARTS})] v FROM kept, range({PARTS}) s(p)),
ids AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 entry FROM kept ORDER BY vec_id LIMIT {ENTRIES}),
books0 AS MATERIALIZED (SELECT part, entry, v FROM parts JOIN ids USING (vec_id)),
{_assign("near0", "books0")},
{_moved("books1", "books0", "near0")},
{_assign("near1", "books1")},
{_moved("books2", "books1", "near1")},
{_assign("near2", "books2")},
coded AS (SELECT vec_id, label, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' ORDER BY part) code, CAST(sum(d) AS BIGINT) error FROM near2 GROUP BY vec_id, label),
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) codebooks_sha256 FROM books2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) label_error, codebooks_sha256 FROM coded, digest
""".replace("floor_div(sum(x), count(*))", "(sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*)")
