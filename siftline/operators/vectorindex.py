"""A stored index of vectors: inverted lists with product-quantised residuals.

An index is a folder. ``model`` holds the coarse centres and the codebooks of the
residuals' parts, fitted on a sample of at most about SAMPLE vectors, those with the
smallest hashes. ``entries`` holds every vector in the folder of its list (the nearest
centre), with its code, the length of what the code leaves out (``rest``) and its
distance from the centre (``radius``); so a search reads the files of the lists that
it probes and no others. Lists of many vectors are dealt over several files.

A search takes a stated set of queries. In the tasks, table look-ups give each query's
distance to the codes; as no vector is nearer than that less its ``rest``, only those
that may still be among the k best are compared by themselves, and each task hands on
its k best. So the result is exact within the probed lists. In exact mode a second
round probes the lists that may hold something better by the triangle inequality: a
list's nearest vector is no nearer than its centre less the list's greatest radius.

Vectors without an id, those that are null, of another length than the model's, or hold
null or non-finite components are not in the index; queries like these find nothing. New vectors join an index by
``add`` without a rebuild. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators.retrieve import NEEDLE_BYTES, top

#: Vectors that the model is fitted on, about; rounds of fitting; vectors of a list, about; lists at most.
SAMPLE, FIT_ROUNDS, LIST_SIZE, MOST_LISTS = 20_000, 8, 256, 4096
#: Parts of a code, and entries of a part's codebook at most.
PARTS, ENTRIES = 8, 256
#: Vectors of one file of a list, about.
FILE_ROWS = 200_000
#: Distances that are in a task's memory at once.
DISTANCES = 1 << 22
HIT = "query_id long, vec_id long, dist double, cosine double"


@dataclass
class Model:
    """Centres (list, component) and codebooks (part, entry, component)."""

    centres: np.ndarray
    books: np.ndarray

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(list, code, rest, radius) of some vectors."""
        home = closest(x, self.centres)
        left = self.split(x - self.centres[home])
        code = np.stack([closest(left[:, p], self.books[p]) for p in range(PARTS)], axis=1)
        over = left - self.books[np.arange(PARTS), code]
        return home, code, np.sqrt((over**2).sum(axis=(1, 2))), np.sqrt((left**2).sum(axis=(1, 2)))

    def split(self, x: np.ndarray) -> np.ndarray:
        """The parts of some vectors, with zeros at the end where they don't come out even."""
        room = PARTS * self.books.shape[2] - x.shape[1]
        return np.pad(x, ((0, 0), (0, room))).reshape(len(x), PARTS, -1)

    def to_codes(self, x: np.ndarray, lists: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Distances of a vector to some codes of lists."""
        out = np.zeros(len(code), np.float64)
        for number in np.unique(lists).tolist():
            own = lists == number
            left = self.split((x - self.centres[number])[None])[0]
            table = ((left[:, None] - self.books) ** 2).sum(axis=2)
            out[own] = table[np.arange(PARTS), code[own]].sum(axis=1)
        return np.sqrt(out)


def closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)


def centred(x: np.ndarray, many: int, rng: np.random.Generator) -> np.ndarray:
    """At most ``many`` means of some vectors."""
    out = x[rng.permutation(len(x))[:many]].copy()
    for _ in range(FIT_ROUNDS):
        own = closest(x, out)
        for number in np.unique(own).tolist():
            out[number] = x[own == number].mean(axis=0)
    return out


def fitted(sample: np.ndarray, lists: int) -> Model:
    rng = np.random.default_rng(11)
    centres = centred(sample, lists, rng)
    model = Model(centres, np.zeros((PARTS, 1, -(-sample.shape[1] // PARTS))))
    left = model.split(sample - centres[closest(sample, centres)])
    model.books = np.stack([centred(left[:, p], min(ENTRIES, len(sample)), rng) for p in range(PARTS)])
    return model


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(finite & (F.size(vector) > 0), F.lit(False))


def rows_of(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(-1, width)


def build(vectors: DataFrame, path: str, lists: int | None = None) -> None:
    """Make an index of (vec_id, embedding) under ``path``, which must not exist. The
    length of most vectors (of equally many, the smaller) is the index's; without
    vectors the index is empty."""
    spark = vectors.sparkSession
    good = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    size = good.groupBy(F.size("embedding").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").first()
    if size is None:
        size, sample = (1, 0), np.zeros((1, 1))
    else:
        own = good.where(F.size("embedding") == size.width)
        share = int(min(1.0, SAMPLE / size.n) * 1_000_000_007)
        chosen = own.where(F.pmod(F.xxhash64("embedding"), F.lit(1_000_000_007)) <= share).select("embedding").limit(2 * SAMPLE).toArrow().column("embedding").combine_chunks()
        if not len(chosen):
            chosen = own.select("embedding").limit(1).toArrow().column("embedding").combine_chunks()
        sample = rows_of(chosen, size.width)
    model = fitted(sample, max(1, min(MOST_LISTS, lists or -(-size[1] // LIST_SIZE))))
    rows = [("centre", i, 0, x.tolist()) for i, x in enumerate(model.centres)] + [("entry", p, e, x.tolist()) for p, book in enumerate(model.books) for e, x in enumerate(book)]
    spark.createDataFrame(rows, "kind string, place int, number int, values array<double>").coalesce(1).write.parquet(f"{path}/model")
    add(vectors, path)


def model_of(spark: SparkSession, path: str) -> Model:
    rows = spark.read.parquet(f"{path}/model").toArrow().to_pylist()
    centres = sorted((r["place"], r["values"]) for r in rows if r["kind"] == "centre")
    books = sorted((r["place"], r["number"], r["values"]) for r in rows if r["kind"] == "entry")
    return Model(np.array([x for _, x in centres]), np.array([x for *_, x in books]).reshape(PARTS, -1, len(books[0][2])))


def add(vectors: DataFrame, path: str) -> None:
    """Put (vec_id, embedding) into the index under ``path``."""
    spark = vectors.sparkSession
    model = spark.sparkContext.broadcast(model_of(spark, path))
    width = model.value.centres.shape[1]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                home, code, rest, radius = model.value.codes(rows_of(part.column(1), width))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(home.astype(np.int32)), pa.array([bytes(c) for c in code.astype(np.uint8)], pa.binary()), pa.array(rest), pa.array(radius)], names=["vec_id", "embedding", "list", "code", "rest", "radius"])

    good = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")) & (F.size("embedding") == width)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    entries = good.mapInArrow(coded, "vec_id long, embedding array<double>, list int, code binary, rest double, radius double")
    counts = entries.groupBy("list").agg(F.ceil(F.count("*") / FILE_ROWS).cast("int").alias("files"))
    dealt = entries.join(F.broadcast(counts), "list").withColumn("file", F.pmod(F.xxhash64("vec_id"), F.col("files")))  # at most MOST_LISTS rows
    dealt.repartition("list", "file").drop("file", "files").write.mode("append").partitionBy("list").parquet(f"{path}/entries")
    model.unpersist()


def entries_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("vec_id long, embedding array<double>, code binary, rest double, radius double, list int").parquet(f"{path}/entries")


def probed(spark: SparkSession, path: str, model: Model, asked: list[tuple[int, np.ndarray, np.ndarray, float]], k: int) -> DataFrame:
    """The k best of every task, for queries (id, vector, lists to probe, distance that
    k known ones don't exceed)."""
    width = model.centres.shape[1]
    wanted = sorted({int(x) for _, _, lists, _ in asked for x in lists})
    shared = spark.sparkContext.broadcast((model, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, asked = shared.value
        by_list: dict[int, list[int]] = {}
        for i, (_, _, lists, _) in enumerate(asked):
            for x in lists.tolist():
                by_list.setdefault(x, []).append(i)
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # rounded distances, ids, cosines
        for whole in batches:
            for low in range(0, whole.num_rows, 8192):
                batch = whole.slice(low, 8192)
                lists = batch.column(3).to_numpy()
                ids, rest = batch.column(0).to_numpy(), batch.column(4).to_numpy()
                x = rows_of(batch.column(1), width)
                code = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, PARTS)
                for number in np.unique(lists).tolist():
                    own = np.flatnonzero(lists == number)
                    for i in by_list.get(number, ()):
                        _, q, _, known = asked[i]
                        held = best.get(i)
                        least = min(known, held[0][k - 1] if held is not None and len(held[0]) == k else np.inf) + 2e-6
                        at = own[model.to_codes(q, lists[own], code[own]) - rest[own] <= least]
                        if not len(at):
                            continue
                        y = x[at]
                        dist = np.sqrt(((y - q) ** 2).sum(axis=1))
                        norm = np.sqrt((q**2).sum()) * np.sqrt((y**2).sum(axis=1))
                        cosine = np.divide(y @ q, norm, out=np.zeros(len(y)), where=norm > 0)
                        new = (dist, ids[at], cosine)
                        if held is not None:
                            new = tuple(np.concatenate(z) for z in zip(held, new, strict=True))
                        order = np.lexsort((new[1], np.round(new[0], 6)))[:k]
                        best[i] = tuple(z[order] for z in new)
        rows = [(asked[i][0], vec, dist, cosine) for i, held in best.items() for dist, vec, cosine in zip(*(z.tolist() for z in held), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=["query_id", "vec_id", "dist", "cosine"])

    entries = entries_of(spark, path).where(F.col("list").isin(wanted))
    return entries.select("vec_id", "embedding", "code", "list", "rest").mapInArrow(run, HIT)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, probes: int = 8, exact: bool = False) -> DataFrame:
    """(query_id, vec_id, dist, cosine, rank) of the k nearest vectors of each query
    (query_id, embedding), by Euclidean distance, in its ``probes`` nearest lists, or in
    all lists that may hold one of them. Queries go to the tasks in blocks of about
    NEEDLE_BYTES; each block is one more branch of the plan."""
    model = model_of(spark, path)
    width = model.centres.shape[1]
    rows = queries.where(usable(F.col("embedding")) & (F.size("embedding") == width)).select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    radii: dict[int, float] = {}
    if exact:
        radii = {r.list: r.radius for r in entries_of(spark, path).groupBy("list").agg(F.max("radius").alias("radius")).collect()}  # at most MOST_LISTS rows
    found, held = None, []

    def block(held: list) -> DataFrame:
        q = np.array([r.embedding for r in held])
        far = np.sqrt(np.maximum(((q[:, None] - model.centres[None]) ** 2).sum(axis=2), 0)) if len(q) * model.centres.size <= DISTANCES else np.stack([np.sqrt(((x - model.centres) ** 2).sum(axis=1)) for x in q])
        order = np.argsort(far, axis=1, kind="stable")
        first = [(r.query_id, x, o[:probes], np.inf) for r, x, o in zip(held, q, order, strict=True)]
        hits = top(probed(spark, path, model, first, k), "query_id", [F.round("dist", 6).asc(), F.asc("vec_id")], k)
        if not exact:
            return hits
        hits = spark.createDataFrame(hits.toArrow().to_pylist(), hits.schema)  # k rows a query of a stated block
        kth = {r.query_id: r.dist for r in hits.where(F.col("rank") == k).select("query_id", "dist").collect()}
        second = []
        for r, x, o, f in zip(held, q, order, far, strict=True):
            least = kth.get(r.query_id, np.inf)
            more = np.array([n for n in o[probes:].tolist() if n in radii and f[n] - radii[n] <= least + 2e-6], np.int64)
            if len(more):
                second.append((r.query_id, x, more, least))
        if not second:
            return hits
        more = probed(spark, path, model, second, k)
        return top(hits.drop("rank").union(more), "query_id", [F.round("dist", 6).asc(), F.asc("vec_id")], k)

    for r in rows.toLocalIterator():
        held.append(r)
        if len(held) * width * 8 >= NEEDLE_BYTES:
            found, held = block(held) if found is None else found.union(block(held)), []
    if held or found is None:
        more = block(held) if held else spark.createDataFrame([], f"{HIT}, rank int")
        found = more if found is None else found.union(more)
    return found
