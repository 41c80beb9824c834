"""Near-duplicate vectors by product quantisation.

Two vectors are linked where their labels are equal and their cosine, in double
precision, reaches ``least``. Vectors that are null, empty, zero or hold null or
non-finite components are linked with nothing, nor are those without a label or of
different lengths.

1. Equal vectors of a label form a class; only classes are compared.
2. Coarse centres and the codebooks of the residuals' PARTS subspaces are fitted on a
   sample of at most about SAMPLE classes, those with the smallest hashes. Every class
   is put into the inverted list of its nearest centre, with the code of its residual
   and the length of what the code leaves out.
3. Every class visits its own list and those that may hold a partner: lists beyond the
   bisecting plane whose distance a partner reaches with a chance that isn't below that of CHANCE
   standard deviations. The spread across a plane is that of a random direction, or of
   the sample where that is larger. A pair is met if either of the two visits the
   other's list. Lists of over BLOCK classes are cut into blocks, so no task holds
   more than a block and a batch of visitors.
4. In a block, table look-ups give the distance of every visitor to every member's
   code. By the triangle inequality only pairs within the threshold's distance plus
   what the code leaves out can be linked; nothing that is linked falls away here. Those
   pairs are reranked by their exact cosine.
5. A task hands on one row for each visitor and member that has links: their number,
   and one id that it is joined with. Pairs are never written. So n_links and
   components follow from sums and from stars.

Ids may repeat: each row is a vector. A null id counts as a partner, but never names
a component; a vector of null id that reaches no other id has component_id null and is
kept. An empty table gives an empty one. Other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import bounded_batches, drop_scratch, scratch

LEAST = 0.93
#: Classes that the model is fitted on, about; rounds of fitting.
SAMPLE, FIT_ROUNDS = 20_000, 8
#: Classes of a label for which there is a list, and lists at most.
LIST_SIZE, MOST_LISTS = 1024, 2048
#: Subspaces of a code, and entries of each.
PARTS, ENTRIES = 16, 64
#: Members of a block, and visitors that are compared with it at once.
BLOCK, VISITORS = 2048, 512
CHANCE = 4.0
#: Allowed for rounding of distances.
SLACK = 1e-4


@dataclass
class Model:
    """Coarse centres (list, component), codebooks (part, entry, component), and
    variances of the sample: ``spread`` (component, component)."""

    centres: np.ndarray
    books: np.ndarray
    spread: np.ndarray

    @property
    def width(self) -> int:
        return self.centres.shape[1]


def units(column: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows of length one, with zeros up to ``width``."""
    size = column.value_lengths().to_numpy()
    values = column.flatten().to_numpy().astype(np.float64)
    out = np.zeros((len(column), width))
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
    out /= np.abs(out).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def near(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each point."""
    return (points @ centres.T - (centres * centres).sum(axis=1) / 2).argmax(axis=1)


def means(points: np.ndarray, many: int, rng: np.random.Generator) -> np.ndarray:
    """At most ``many`` centres of the points."""
    centres = points[rng.permutation(len(points))[:many]].copy()
    for _ in range(FIT_ROUNDS):
        own = near(points, centres)
        order = np.argsort(own, kind="stable")
        filled, first = np.unique(own[order], return_index=True)
        centres[filled] = np.add.reduceat(points[order], first, axis=0) / np.bincount(own)[filled][:, None]
    return centres


def fitted(sample: np.ndarray, lists: int) -> Model:
    rng = np.random.default_rng(7)
    centres = means(sample, lists, rng)
    rest = sample - centres[near(sample, centres)]
    step = sample.shape[1] // PARTS
    many = min(ENTRIES, len(sample))
    books = np.stack([means(np.ascontiguousarray(rest[:, p * step : (p + 1) * step]), many, rng) for p in range(PARTS)])
    return Model(centres, books, np.atleast_2d(np.cov(sample.T, bias=True)))


def probes(model: Model, points: np.ndarray, home: np.ndarray, least: float) -> np.ndarray:
    """Which lists (columns) each point visits besides its own."""
    c = model.centres
    score = points @ c.T - (c * c).sum(axis=1) / 2
    lengths = (c * c).sum(axis=1)
    between = np.sqrt(np.maximum(lengths[:, None] + lengths[None, :] - 2 * c @ c.T, 1e-12))
    cov = c @ model.spread @ c.T
    spread = np.maximum((np.diag(cov)[:, None] + np.diag(cov)[None, :] - 2 * cov) / between**2, 1 / max(model.width - 1, 1))
    to = between[home]
    gap = (score[np.arange(len(points)), home][:, None] - score) / to
    along = (points @ c.T - (points * c[home]).sum(axis=1)[:, None]) / to  # the point's part in the direction of the other centre
    reach = np.sqrt(1 - least**2) * np.sqrt(spread[home])
    out = (gap + (1 - least) * along <= CHANCE * reach) & (gap <= np.sqrt(2 - 2 * least) + SLACK)
    out[np.arange(len(points)), home] = False
    return out


def indexed(model, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (cid, n, embedding) to (cid, home, code, rest, visits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        step = m.width // PARTS
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                part = batch.slice(low, 2048)
                x = units(part.column(1), m.width)
                home = near(x, m.centres)
                rest = x - m.centres[home]
                code = np.stack([near(rest[:, p * step : (p + 1) * step], m.books[p]) for p in range(PARTS)], axis=1)
                left = rest - m.books[np.arange(PARTS), code].reshape(len(x), m.width)
                visits = probes(m, x, home, least)
                offsets = np.concatenate([[0], np.cumsum(visits.sum(axis=1))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(home.astype(np.int32)), pa.array([bytes(r) for r in code.astype(np.uint8)], pa.binary()), pa.array(np.sqrt((left * left).sum(axis=1))), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.nonzero(visits)[1].astype(np.int32)))],
                    names=["cid", "home", "code", "rest", "visits"],
                )

    return run


class Block:
    """The members of one block of a list, and what visitors have found of them."""

    def __init__(self, model: Model, least: float, t: pa.Table):
        self.model, self.least = model, least
        self.list = t.column("list")[0].as_py()
        self.ids, self.n = t.column("cid").to_numpy(), t.column("n").to_numpy()
        self.x = units(t.column("embedding").combine_chunks(), model.width)
        self.code = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(-1, PARTS)
        self.reach = ((np.sqrt(2 - 2 * least) + t.column("rest").to_numpy() + SLACK) ** 2).astype(np.float32)
        visits = t.column("visits").combine_chunks()
        self.visits = visits.flatten().to_numpy(), np.repeat(np.arange(len(self.ids)), visits.value_lengths().to_numpy())
        self.links = np.zeros(len(self.ids), np.int64)
        self.group = np.arange(len(self.ids))
        self._visiting: dict[int, np.ndarray] = {}

    def visiting(self, home: int) -> np.ndarray:
        """Which members visit the list ``home`` themselves."""
        if home not in self._visiting:
            self._visiting[home] = np.zeros(len(self.ids), bool)
            self._visiting[home][self.visits[1][self.visits[0] == home]] = True
        return self._visiting[home]

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of some vectors to the members' codes, by look-ups."""
        step = self.model.width // PARTS
        rest = (x - self.model.centres[self.list]).reshape(len(x), PARTS, step)
        books = self.model.books
        table = ((rest * rest).sum(axis=2)[:, :, None] + (books * books).sum(axis=2)[None] - 2 * np.einsum("vps,pes->vpe", rest, books, optimize=True)).astype(np.float32)
        out = np.zeros((len(x), len(self.ids)), np.float32)
        for p in range(PARTS):
            out += table[:, p].take(self.code[:, p], axis=1)
        return out

    def linked(self, x: np.ndarray, allowed: np.ndarray) -> np.ndarray:
        """Which of the allowed pairs (vector, member) are linked."""
        may = allowed & (self.distances(x) <= self.reach[None, :])
        out = np.zeros(may.shape, bool)
        i, j = np.nonzero(may)
        if 4 * len(i) > may.size:
            return may & (x @ self.x.T >= self.least)
        for low in range(0, len(i), 100_000):
            a, b = i[low : low + 100_000], j[low : low + 100_000]
            out[a, b] = (x[a] * self.x[b]).sum(axis=1) >= self.least
        return out

    def join(self, hits: np.ndarray) -> np.ndarray:
        """Join the members that share a visitor; a member of each visitor, or -1."""
        some = np.flatnonzero(hits.any(axis=1))
        of = np.full(len(hits), -1)
        of[some] = hits[some].argmax(axis=1)
        for i in some.tolist():
            found = self.group[hits[i]]
            if (found != found[0]).any():
                found = np.unique(found)
                self.group[np.isin(self.group, found)] = found[0]
        return of

    def visit(self, ids: np.ndarray, n: np.ndarray, x: np.ndarray, allowed: np.ndarray) -> pa.RecordBatch:
        """Rows (a, b, links) of the visitors that have links."""
        hits = self.linked(x, allowed)
        of = self.join(hits)
        self.links += n @ hits
        own = hits @ self.n
        some = of >= 0
        return rows(ids[some], self.ids[of[some]], own[some])

    def within(self) -> Iterator[pa.RecordBatch]:
        """The pairs of members."""
        for low in range(0, len(self.ids), VISITORS):
            part = slice(low, low + VISITORS)
            later = np.arange(len(self.ids))[None, :] > np.arange(len(self.ids))[part, None]
            yield self.visit(self.ids[part], self.n[part], self.x[part], later)

    def visitors(self, t: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for low in range(0, t.num_rows, VISITORS):
            part = t.slice(low, VISITORS)
            home = part.column("home").to_numpy()
            # a pair whose both sides visit each other counts once: in the list of the greater number
            allowed = np.ones((len(home), len(self.ids)), bool)
            for h in np.unique(home[home > self.list]).tolist():
                allowed[home == h] = ~self.visiting(h)
            yield self.visit(part.column("cid").to_numpy(), part.column("n").to_numpy(), units(part.column("embedding"), self.model.width), allowed)

    def members(self) -> pa.RecordBatch:
        """Rows (a, b, links) of the members that have links."""
        some = self.links > 0
        return rows(self.ids[some], self.ids[self.group[some]], self.links[some])


def rows(a: np.ndarray, b: np.ndarray, links: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(links.astype(np.int64))], names=["a", "b", "links"])


def compared(model, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of a table sorted by tile, members before visitors, to (a, b, links)."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bool, pa.RecordBatch]]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tile, visitor = batch.column("tile").dictionary_encode().indices.to_numpy(), batch.column("visitor").to_numpy(zero_copy_only=False)
            edge = np.flatnonzero((tile[1:] != tile[:-1]) | (visitor[1:] != visitor[:-1])) + 1
            edge = [0, *edge.tolist(), batch.num_rows]
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                yield batch.column("tile")[a].as_py(), bool(visitor[a]), batch.slice(a, b - a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block = None, [], None

        def sealed() -> Iterator[pa.RecordBatch]:
            nonlocal block, held
            if held:
                block = Block(model.value, least, pa.Table.from_batches(held))
                held = []
                yield from block.within()

        for tile, visitor, part in runs(batches):
            if tile != at:
                yield from sealed()
                if block:
                    yield block.members()
                at, block = tile, None
            if not visitor:
                held.append(part)
                continue
            yield from sealed()
            if block:
                yield from block.visitors(part)
        yield from sealed()
        if block:
            yield block.members()

    return run


def usable(vector: Column, label: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(label.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def model_of(classes: DataFrame) -> Model:
    """The model, from a sample of the classes."""
    sizes = classes.groupBy("label", "size").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max("size").alias("size")).first()
    width = -(-sizes.size // PARTS) * PARTS
    share = min(1.0, SAMPLE / sizes.n)
    chosen = F.pmod(F.xxhash64("embedding"), F.lit(1_000_000_007)) < int(share * 1_000_000_007)
    sample = classes.where(chosen).select("embedding").limit(2 * SAMPLE).toArrow().column("embedding").combine_chunks()
    if not len(sample):
        sample = classes.select("embedding").limit(1).toArrow().column("embedding").combine_chunks()
    return fitted(units(sample, width), max(1, min(MOST_LISTS, -(-sizes.most // LIST_SIZE))))


def near_vectors(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    ok = usable(F.col("embedding"), F.col("label"))
    grouped = given.where(ok).groupBy("label", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("low"))
    classes = scratch(grouped.select(F.monotonically_increasing_id().alias("cid"), "label", F.size("embedding").alias("size"), "n", "low", "embedding"), "classes")
    alone = given.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if classes.isEmpty():
        return alone.withColumn("kept", F.lit(True))
    model = spark.sparkContext.broadcast(model_of(classes))
    keys = classes.select("cid", "embedding").mapInArrow(indexed(model, least), "cid long, home int, code binary, rest double, visits array<int>")
    entries = scratch(classes.join(keys, "cid").withColumn("label", F.concat_ws(":", "size", F.col("label").cast("string"))).select("cid", "label", "n", "embedding", "home", "code", "rest", "visits"), "lists")
    found = scratch(tiles(entries).mapInArrow(compared(model, least), "a long, b long, links long"), "links")
    model.destroy()
    links = found.groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    joined = components(found.where("a <> b").select("a", "b").distinct())
    named = classes.join(joined.select(F.col("id").alias("cid"), F.col("label").alias("component")), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    of = scratch(named.join(lowest, "component").join(links, "cid", "left").select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), "component_id"), "classes")
    drop_scratch(classes, entries, found, joined)
    compared_rows = given.where(ok).join(of, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    return compared_rows.union(alone.where(~ok)).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def tiles(entries: DataFrame) -> DataFrame:
    """Rows (tile, visitor, list, ...), one for each member and each visit, dealt and
    sorted by tile: a block of a list, with those that visit it."""
    sizes = entries.groupBy("label", F.col("home").alias("list")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = entries.withColumn("list", F.explode(F.concat(F.array("home"), "visits"))).join(sizes, ["label", "list"])
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    # at home: a member of its block, a visitor of the later ones
    to = F.when(F.col("list") == F.col("home"), F.sequence(own, F.col("blocks") - 1)).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    every = dealt.withColumn("own", own).withColumn("block", F.explode(to)).withColumn("visitor", (F.col("list") != F.col("home")) | (F.col("block") != F.col("own")))
    at_home = lambda c: F.when(~F.col("visitor"), F.col(c)).alias(c)  # noqa: E731  visitors need no code
    out = every.select(F.concat_ws(":", "list", "block", "label").alias("tile"), "visitor", "list", "home", "cid", "n", "embedding", at_home("code"), at_home("rest"), at_home("visits"))
    return out.repartition("tile").sortWithinPartitions("tile", "visitor")


def op12_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL_OP12 = f"""
WITH RECURSIVE good AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (
    SELECT a.vec_id a, b.vec_id b
    FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= {LEAST}),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM link WHERE a = e.vec_id) n_links, c.component_id, e.vec_id = c.component_id kept
FROM embeddings e JOIN (SELECT a, min(b) component_id FROM reach GROUP BY a) c ON c.a = e.vec_id
"""
