"""Near-duplicate detection by b-bit MinHash.

A document's set holds its distinct shingles of k words (A-Z as a-z); a text of
fewer words is one shingle, a text without words or a null one has an empty set
and is linked with nothing. Two documents are linked where

    100 * |A and B| >= percent * |A or B|.

1. One pass hashes every shingle and takes HASHES minima. Of each, BITS low bits
   are packed into the signature; all of them make BANDS band keys.
2. Documents of equal sets form a class that its smallest id stands for.
3. Within each band bucket, the smallest and the largest id are paired with every
   member. Pairs whose collision-corrected similarity, from bit counts of the
   packed signatures, is under the threshold by more than MARGIN fall away; the
   others are confirmed on the full sets. Confirmed links make components.
4. In buckets that still hold several components, every pair across components is
   compared by bit counts, tile by tile. What isn't under the margin is not emitted
   as pairs but joins the documents into clusters; a task hands on a star to the
   smallest id of each of its clusters, so that tasks that met the same cluster
   write the same rows. The member of a cluster that is alike to most others is
   confirmed against all of them first; what is left apart is confirmed with all
   others on the full sets, by products of 0/1 matrices of two blocks of documents.
   So no link is lost because of who stood in the middle of a bucket, and what is
   written grows with the documents, not with the pairs of a group.

Buckets with the same members count once. Blocks of documents are dealt by component:
large components have blocks of their own, which are never compared with each other
or within, so a document is copied once for each block of other components.

A linked pair is missed only if it shares no band (at a similarity of 0.8: 5e-8)
or its estimate is off by over MARGIN (5 standard deviations).

Rows with the same doc_id count as one document. Rows whose doc_id is null are
kept and linked with nothing by id. Other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import Forest, components
from .shared import bounded_batches, drop_scratch, scratch
from .words import Words, mix, words

HASHES, ROWS, BITS = 128, 4, 4
BANDS, WORDS = HASHES // ROWS, HASHES * BITS // 64
MARGIN = 0.2
#: Members of a bucket that are compared with each other in one piece.
TILE = 4096
#: Bits of a Bloom filter of documents (8 MB) at most, and its hashes.
BLOOM_BITS, BLOOM_HASHES = 1 << 26, 4
#: Documents and bytes of a block of a cluster, of which two at once are in a task's
#: memory; a text beyond the bytes is a block of its own.
CLUSTER_TILE, CLUSTER_BYTES = 512, 8 << 20

_XOR = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_MUL = mix(np.arange(1, HASHES + 1, dtype=np.uint64) + np.uint64(0xABCDEF)) | np.uint64(1)
_PLACE = mix(np.arange(64, dtype=np.uint64) + np.uint64(0x5EED)) | np.uint64(1)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of a slice's texts (repeated ones too), and where
    each text's begin."""
    count = np.diff(w.doc)
    n = len(w.hash)
    whole = np.zeros(n, np.uint64)
    for j in range(k):
        whole[: max(0, n - j)] += w.hash[j:] * _PLACE[j]
    whole = mix(whole)
    pos = np.arange(n) - np.repeat(w.doc[:-1], count)
    size = np.repeat(count, count)
    keep = (pos + k <= size) | ((size < k) & (pos == 0))
    for d in np.flatnonzero((count > 0) & (count < k)):
        a, b = w.doc[d], w.doc[d + 1]
        whole[a] = mix(np.array([(w.hash[a:b] * _PLACE[: b - a]).sum() ^ _PLACE[63 - (b - a)]], np.uint64))[0]
    return whole[keep], np.concatenate([[0], np.cumsum(keep)])[w.doc]


def sketched(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (key, text) to (key, n_shingles, set_a, set_b, bands, packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, w in words(batch.column(1)):
                s, at = shingles(w, k)
                n = len(at) - 1
                size, a, b = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                for d in np.flatnonzero(np.diff(at)):
                    own = np.unique(s[at[d] : at[d + 1]])
                    size[d], a[d], b[d] = len(own), own.sum(), mix(own ^ _PLACE[7]).sum()
                some = np.flatnonzero(size)
                least = np.empty((len(some), HASHES), np.uint64)
                if len(some):
                    begin = at[:-1][some]
                    for h in range(HASHES):
                        least[:, h] = np.minimum.reduceat((s ^ _XOR[h]) * _MUL[h], begin)
                band = np.zeros((len(some), BANDS), np.uint64)
                for r in range(ROWS):
                    band += least[:, r::ROWS] * _PLACE[r]
                band = mix(band + _XOR[:BANDS])
                low = (least >> np.uint64(20)) & np.uint64((1 << BITS) - 1)
                packed = np.zeros((len(some), WORDS), np.uint64)
                for x in range(64 // BITS):
                    packed |= low[:, x :: 64 // BITS] << np.uint64(BITS * x)
                lists = lambda m, width: pa.ListArray.from_arrays(pa.array((np.concatenate([[0], np.cumsum(size > 0)]) * width).astype(np.int32)), pa.array(m.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.array(size), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), lists(band, BANDS), lists(packed, WORDS)], names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "packed"])

    return run


def likeness(x: Column, y: Column) -> Column:
    """Similarity of two packed signatures: the share of equal pieces, corrected
    for the 2**-BITS that are equal by chance."""
    ones = sum(1 << (BITS * j) for j in range(64 // BITS))
    ones = ones - (1 << 64) if ones >= 1 << 63 else ones
    unequal = F.lit(0)
    for j in range(WORDS):
        z = x[j].bitwiseXOR(y[j])
        folded = z
        for shift in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(z, shift))
        unequal = unequal + F.bit_count(folded.bitwiseAND(F.lit(ones)))
    chance = 2.0**-BITS
    return (1 - unequal / HASHES - chance) / (1 - chance)


def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole tiles from batches sorted by their first column, as many at once as
    have come."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and batch.column(0)[batch.num_rows - 1] == held[0].column(0)[0]:
            held.append(batch)
            continue
        t = pa.Table.from_batches([*held, batch])
        tile = t.column(0).to_numpy()
        cut = int(np.searchsorted(tile, tile[-1]))
        if cut:
            yield t.slice(0, cut)
        held = t.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def similar(k: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (a, b, text_a, text_b), to stars of what the linked pairs of one
    task join; pairs that earlier ones have joined need no look."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = Forest()
        held: list[tuple] = [(None, None), (None, None)]  # the last text of each side and its set

        def own(side: int, text: str) -> np.ndarray:
            if held[side][0] != text:
                held[side] = (text, np.unique(np.concatenate([shingles(w, k)[0] for _, w in words(pa.array([text], pa.string()))])))
            return held[side][1]

        for batch in batches:
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if trees.root(a) == trees.root(b):
                    continue
                p, q = own(0, x), own(1, y)
                both = len(p) + len(q) - len(np.union1d(p, q))
                if 100 * both >= percent * (len(p) + len(q) - both):
                    trees.join(a, b)
            yield from trees.full()
        yield trees.stars()

    return run


def across(least: float, likely: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (tile, block, within, id, label, packed), sorted by tile, to rows
    (a, b, alike). Stars, with alike 0, of what the pairs of one task join that are
    of different components and alike by ``least``; and for each id (a = b) the
    number of those that are alike by ``likely``."""
    pieces = np.array([sum(1 << (BITS * j) for j in range(64 // BITS))], np.uint64)[0]
    chance = 2.0**-BITS
    most, close = (HASHES * (1 - chance - x * (1 - chance)) for x in (least, likely))

    def compare(t: pa.Table, trees: Forest) -> tuple[np.ndarray, np.ndarray]:
        tile, block, label, ids = (t.column(c).to_numpy() for c in ("tile", "block", "label", "id"))
        within = t.column("within").to_numpy(zero_copy_only=False)
        packed = t.column("packed").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)
        at, degree = np.arange(len(tile)), np.zeros(len(tile), np.int64)
        for step in range(1, len(tile)):
            at = at[at + step < len(tile)]
            at = at[tile[at] == tile[at + step]]
            if not len(at):
                break
            x, y = at, at + step
            ok = (label[x] != label[y]) & (within[x] | (block[x] != block[y]))
            x, y = x[ok], y[ok]
            z = packed[x] ^ packed[y]
            folded = z.copy()
            for shift in range(1, BITS):
                folded |= z >> np.uint64(shift)
            unequal = np.bitwise_count(folded & pieces).sum(axis=1, dtype=np.int64)
            near = unequal <= close
            degree += np.bincount(x[near], minlength=len(tile)) + np.bincount(y[near], minlength=len(tile))
            ok = unequal <= most
            for a, b in zip(ids[x[ok]].tolist(), ids[y[ok]].tolist(), strict=True):
                trees.join(a, b)
        return ids[degree > 0], degree[degree > 0]

    def rows(a: pa.Array, b: pa.Array, alike: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([a, b, pa.array(alike, pa.int64())], names=["a", "b", "alike"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = Forest()
        for t in tiles(batches):
            ids, degree = compare(t, trees)
            yield rows(pa.array(ids), pa.array(ids), degree)
            for stars in trees.full():
                yield rows(*stars.columns, np.zeros(stars.num_rows, np.int64))
        stars = trees.stars()
        yield rows(*stars.columns, np.zeros(stars.num_rows, np.int64))

    return run


def overlaps(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of some sets with others, as a matrix: products
    of 0/1 matrices over the elements that several sets hold."""
    size = np.array([len(x) for x in sets])
    _, element, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)
    several = count > 1
    number = np.cumsum(several) - 1
    keep = several[element]
    owner, element = owner[keep], number[element[keep]]
    order = np.argsort(element, kind="stable")
    owner, element = owner[order], element[order]
    out = np.zeros((len(rows), len(columns)), np.float32)
    for low in range(0, int(several.sum()), 8192):
        a, b = np.searchsorted(element, [low, low + 8192])
        m = np.zeros((len(sets), 8192), np.float32)
        m[owner[a:b], element[a:b] - low] = 1
        out += m[rows] @ m[columns].T
    return out


def within_clusters(k: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (tile, block, within, id, label, text), sorted by tile, to stars
    (a, b) of the components that the links of one task join."""

    def join(t: pa.Table, trees: Forest) -> None:
        block, label = (t.column(c).to_numpy() for c in ("block", "label"))
        sets = [np.unique(np.concatenate([shingles(w, k)[0] for _, w in words(pa.array([x], pa.string()))] or [np.zeros(0, np.uint64)])) for x in t.column("text").to_pylist()]
        size = np.array([len(x) for x in sets])
        low = np.flatnonzero(block == block.min())
        high = low if t.column("within")[0].as_py() else np.flatnonzero(block != block.min())
        if not len(high):
            return
        both = overlaps(sets, low, high)
        ok = (100 * both >= percent * (size[low][:, None] + size[high][None, :] - both)) & (label[low][:, None] != label[high][None, :])
        for i, j in np.argwhere(ok).tolist():
            trees.join(int(label[low[i]]), int(label[high[j]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = Forest()
        for t in tiles(batches):
            tile = t.column("tile").to_numpy()
            edge = [0, *(np.flatnonzero(tile[1:] != tile[:-1]) + 1).tolist(), len(tile)]
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                join(t.slice(a, b - a), trees)
            yield from trees.full()
        yield trees.stars()

    return run


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands, packed) of every row."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("key"), F.col("text")).mapInArrow(sketched(k), "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, packed array<long>")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept."""
    sketch = scratch(sketches(docs, k), "sketch")
    named = sketch.where("n_shingles > 0 and doc_id is not null")
    classes = scratch(named.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep")), "classes")
    heads = named.join(classes.select("set_a", "set_b", F.col("rep").alias("doc_id")), ["set_a", "set_b", "doc_id"], "left_semi")
    label = labels(docs, heads.select(F.col("doc_id").alias("id"), "bands", "packed"), k, percent)
    member = sketch.join(classes, ["set_a", "set_b"], "left").join(label, F.col("rep") == label.id, "left")
    return member.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.coalesce("label", "rep")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def tiled(rows: DataFrame, group: str, most: int, weight: Column) -> DataFrame:
    """``rows`` with tile, block and within: the members of a group are dealt into
    blocks whose weights (1 at least each) sum to about ``most``, and each pair of
    blocks that may hold two components is a tile; one block beside itself is
    compared within.

    A component that fills a block has blocks of its own; the others share the rest
    by their labels. A group's list holds its large components, so at most its
    weight divided by ``most``."""
    rows = rows.withColumn("__weight", weight.cast("long"))
    sums = rows.groupBy(group, "label").agg(F.sum("__weight").alias("w"))
    large = F.col("w") >= most
    parts = sums.groupBy(F.col(group).alias("__group")).agg(
        F.coalesce(F.ceil(F.sum(F.when(~large, F.col("w"))) / most), F.lit(0)).cast("int").alias("__rest"),
        F.collect_list(F.when(large, F.struct("label", F.ceil(F.col("w") / most).cast("int").alias("n")))).alias("__large"),
    )
    dealt = rows.join(parts, F.col(group) == F.col("__group"))
    own = F.try_element_at(F.filter("__large", lambda x: x["label"] == F.col("label")), F.lit(1))["n"]
    of = lambda label, part: F.xxhash64(label, part)
    spread = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    alone = F.lit(None).cast("long")
    # the blocks of the other large components, then those that small ones share
    other = F.concat(
        F.flatten(F.transform(F.filter("__large", lambda x: x["label"] != F.col("label")), lambda x: F.transform(F.sequence(F.lit(0), x["n"] - 1), lambda p: of(x["label"], p)))),
        F.when(F.col("__rest") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("__rest"), F.lit(1)) - 1), lambda p: of(alone, p))).otherwise(F.array().cast("array<bigint>")),
    )
    return (
        dealt.withColumn("__n", own)
        .withColumn("block", F.when(F.col("__n").isNull(), of(alone, spread("label", F.greatest(F.col("__rest"), F.lit(1))))).otherwise(of(F.col("label"), spread("id", F.coalesce("__n", F.lit(1))))))
        .withColumn("other", F.explode(other))
        .withColumn("within", F.col("block") == F.col("other"))
        .withColumn("tile", F.xxhash64(group, F.least("block", "other"), F.greatest("block", "other")))
    )


def unlike(rows: DataFrame, group: str) -> DataFrame:
    """``rows`` of the groups that hold several labels."""
    open_groups = rows.groupBy(group).agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select(group)
    return rows.join(open_groups, group, "left_semi")


def relabelled(ids: DataFrame, label: DataFrame) -> DataFrame:
    """``ids`` with their label, or their id where no link has met it."""
    return ids.join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))


def merged(label: DataFrame, stars: DataFrame) -> DataFrame:
    """``label`` after stars (a, b) between labels have joined some of them."""
    upper = components(stars).select(F.col("id").alias("label"), F.col("label").alias("up"))
    return scratch(label.join(upper, "label", "left").select("id", F.coalesce("up", "label").alias("label")), "merged")


def labels(docs: DataFrame, heads: DataFrame, k: int, percent: int) -> DataFrame:
    """(id, label) of the heads of classes that share a bucket with another."""
    least = percent / 100 - MARGIN
    banded = heads.select(F.explode("bands").alias("band"), "id")
    of_ids = [F.bit_xor(F.xxhash64("id", F.lit(j))).alias(f"x{j}") for j in range(2)]
    shared = banded.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n"), *of_ids).where("low < high")
    once = shared.groupBy("low", "high", "n", "x0", "x1").agg(F.min("band").alias("band")).select("band", "low", "high")
    members = scratch(banded.join(once, "band"), "members")
    packed = heads.select("id", "packed").dropDuplicates(["id"])
    stars = members.select(F.explode(F.array("low", "high")).alias("b"), F.col("id").alias("a")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    first = scratch(alike(stars, packed, least), "pairs")
    texts = scratch(texts_of(docs, first.select(F.explode(F.array("a", "b")).alias("id"))), "texts")
    links = scratch(on_full_sets(first, texts, k, percent), "links")
    found = components(links)
    drop_scratch(first, links)

    labelled = scratch(unlike(relabelled(members.select("band", "id"), found), "band"), "open")
    left = tiled(labelled.join(packed, "id"), "band", TILE, F.lit(1)).select("tile", "block", "within", "id", "label", "packed")
    rows = scratch(left.repartition("tile").sortWithinPartitions("tile").mapInArrow(across(least, percent / 100), "a long, b long, alike long"), "edges")
    edges = rows.where("a <> b").select("a", "b").distinct()
    drop_scratch(members, labelled)
    if edges.isEmpty():
        drop_scratch(texts, rows)
        return found

    cluster = components(edges).select("id", F.col("label").alias("cluster"))
    own = scratch(relabelled(cluster, found), "clusters")
    known = texts.join(own.select("id"), "id", "left_semi")
    rest = own.join(texts.select("id"), "id", "left_anti")
    if not rest.isEmpty():
        known = known.unionByName(texts_of(docs, rest.select("id")).join(rest.select("id"), "id", "left_semi"))
    known = scratch(known, "texts")
    every = scratch(found.union(own.select("id", "label")).distinct(), "labels")

    degree = rows.where("a = b").groupBy(F.col("a").alias("id")).agg(F.sum("alike").alias("alike"))
    hub = own.join(degree, "id").groupBy("cluster").agg(F.max_by(F.struct(F.col("id").alias("a"), F.col("label").alias("of")), F.struct("alike", "id")).alias("hub")).select("cluster", "hub.*")
    pairs = own.join(hub, "cluster").where("label <> of").select("a", F.col("id").alias("b")).distinct()
    every = merged(every, scratch(joined(scratch(on_full_sets(pairs, known, k, percent), "links"), every), "links"))
    own = scratch(unlike(relabelled(own.select("id", "cluster"), every), "cluster"), "clusters")
    if not own.isEmpty():
        pieces = tiled(own.join(known, "id"), "cluster", CLUSTER_TILE, F.greatest(F.lit(1), F.ceil(F.octet_length("text") * F.lit(CLUSTER_TILE / CLUSTER_BYTES)))).select("tile", "block", "within", "id", "label", "text")
        more = scratch(pieces.repartition("tile").sortWithinPartitions("tile").mapInArrow(within_clusters(k, percent), "a long, b long"), "links")
        every = merged(every, more)
    drop_scratch(texts, rows, known, own)
    return every


def joined(links: DataFrame, label: DataFrame) -> DataFrame:
    """Links (a, b) of ids as links of their labels, without those within one."""
    of = label.select("id", "label")
    ends = links.join(of.select(F.col("id").alias("a"), F.col("label").alias("x")), "a").join(of.select(F.col("id").alias("b"), F.col("label").alias("y")), "b")
    return ends.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def alike(pairs: DataFrame, packed: DataFrame, least: float) -> DataFrame:
    """The pairs whose estimate reaches ``least``."""
    x, y = packed.select(F.col("id").alias("a"), F.col("packed").alias("x")), packed.select(F.col("id").alias("b"), F.col("packed").alias("y"))
    return pairs.join(x, "a").join(y, "b").where(likeness(F.col("x"), F.col("y")) >= least).select("a", "b")


def bits_of(ids: np.ndarray, bits: int) -> np.ndarray:
    """BLOOM_HASHES bit positions under ``bits`` (a power of two) of each id."""
    h = mix(ids.astype(np.int64).view(np.uint64))
    step = mix(h) | np.uint64(1)
    return np.stack([(h + np.uint64(j) * step) & np.uint64(bits - 1) for j in range(BLOOM_HASHES)])


def set_bits(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (id) to (word, mask): the 64-bit words of a Bloom filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = bits_of(batch.column(0).to_numpy(), bits).reshape(-1)
            mask = np.uint64(1) << (at & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(mask.view(np.int64))], names=["word", "mask"])

    return run


def possibly(shared, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows whose id (first column) may be in a Bloom filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = bits_of(batch.column(0).to_numpy(), bits)
            hit = (shared.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
            yield batch.filter(pa.array(hit.all(axis=0)))

    return run


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the documents of some ids, and of few others: a Bloom filter of
    at most BLOOM_BITS picks them where they lie, so that no text is shuffled. What
    is joined with the result drops the others."""
    spark = docs.sparkSession
    count = ids.agg(F.approx_count_distinct("id")).first()[0]
    bits = min(BLOOM_BITS, 1 << (max(64, 12 * count) - 1).bit_length())
    rows = ids.mapInArrow(set_bits(bits), "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    bloom = np.zeros(bits // 64, np.uint64)
    bloom[rows.column("word").to_numpy()] = rows.column("mask").to_numpy().view(np.uint64)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("text is not null and id is not null")
    return texts.mapInArrow(possibly(spark.sparkContext.broadcast(bloom), bits), texts.schema)


def on_full_sets(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs that are linked by their full sets."""
    a, b = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(similar(k, percent), "a long, b long")


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the near-duplicates of a kept document."""
    gone = near_duplicates(docs, k, percent).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs.doc_id.cast("long") == F.col("__gone"), "left_anti").select(docs.columns)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=2)
