"""An exact similarity join of two tables of vectors, neither of which is small.

The right side's different vectors are dealt to the nearest of some pivots, and within
a pivot's cell to windows of their angle to it. A left vector goes to the windows that
may hold a partner, and to no others: by the triangle inequality of angles no partner
is further from the vector's own angle than the threshold's, and none lies beyond the
border between its nearest pivot and the cell's by more. Both are exact, so every link
is found, whatever the pivots are. Where vectors have structure most windows fall out;
where they are spread evenly over many dimensions no pivot tells them apart, and each
left vector is compared with nearly every window (``compared`` and ``pairs`` tell).
Windows are sent in groups, so a vector is copied GROUPS times at most, about, until a
group is full; from then on the copies grow with the number of full groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.operators.vectorindex import centred, usable
from siftline.sources import tables

#: Vectors that pivots are fitted on, about; pivots at most; windows of a cell; right
#: vectors of a cell, about, and of a comparison.
SAMPLE, MOST_PIVOTS, WINDOWS, BLOCK, CHUNK = 20_000, 1024, 16, 1024, 4096
#: Groups of windows, and slices of the left vectors of each, about; more where one
#: would pass so many vectors.
GROUPS, MOST_GROUP = 8, 1 << 17
#: What rounding may do to an angle.
SLACK = 1e-7


def angles(dots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(dots, -1.0, 1.0))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def pivots_of(sample: np.ndarray, many: int) -> np.ndarray:
    """Unit vectors in the middle of the sample's clusters."""
    means = centred(sample, many, np.random.default_rng(7))
    size = np.linalg.norm(means, axis=1, keepdims=True)
    return np.unique((means / np.where(size > 0, size, 1.0))[size[:, 0] > 1e-9], axis=0) if (size > 1e-9).any() else sample[:1]


def links(left: DataFrame, right: DataFrame, least: float = 0.85, block: int = BLOCK) -> DataFrame:
    """(query_id, n_links, vec_id, cosine), one row for each row of ``left`` (query_id,
    embedding), whose ids are unique: how many rows of ``right`` (vec_id, embedding) have
    a cosine of at least ``least`` (over 0) with it, and of these the smallest id of the
    greatest cosine (to nine places). Vectors that are null, empty, zero or hold null or
    non-finite components have no links, nor have those of another length than most of
    the right side's (of equally frequent lengths the smaller counts).

    Equal right vectors are one with a number. Groups of windows, a window of many vectors
    and the left vectors of a group are dealt over several tasks. To the driver go a sample's vectors and numbers of
    windows, which are bounded. The result has ``pairs`` (left by different right
    vectors), ``compared`` (those of them that tasks compare) and ``paths``, the tables
    it reads, for the caller to delete."""
    spark, kinds = left.sparkSession, [left.schema["query_id"].dataType.simpleString(), right.schema["vec_id"].dataType.simpleString()]
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    unit = lambda df, key: df.where(usable(F.col("embedding"))).withColumn("norm", norm).where("norm > 0").select(key, F.transform("embedding", lambda v: v.cast("double") / F.col("norm")).alias("unit"))
    whole = tables.written(unit(right, "vec_id").groupBy("unit").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n")), "right")
    size = whole.groupBy(F.size("unit").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").first()
    none = left.select("query_id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast(kinds[1]).alias("vec_id"), F.lit(None).cast("double").alias("cosine"))
    if size is None:
        none.pairs, none.compared, none.paths = 0, 0, [whole.path]
        return none
    width, reach = size.width, float(np.arccos(least)) + SLACK
    own = whole.where(F.size("unit") == width)
    share = int(min(1.0, SAMPLE / size.n) * 1_000_000_007)
    sample = own.where(F.pmod(F.xxhash64("unit"), F.lit(1_000_000_007)) <= share).select("unit").limit(2 * SAMPLE).toArrow()
    sample = sample if sample.num_rows else own.select("unit").limit(1).toArrow()
    pivots = pivots_of(matrix(sample["unit"], width), max(1, min(MOST_PIVOTS, -(-size.n // block))))

    def homed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dots = matrix(batch.column("unit"), width) @ pivots.T
            home = dots.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32)), pa.array(angles(dots[np.arange(len(home)), home]))], names=[*batch.schema.names, "cell", "angle"])

    kind = f"unit array<double>, vec_id {kinds[1]}, n long, cell int, angle double"
    cells = tables.written(own.mapInArrow(homed, kind), "cells")
    shares = F.array(*[F.lit(i / WINDOWS) for i in range(1, WINDOWS)])
    edges = {r.cell: sorted(set(r.e)) if r.m > block else [] for r in cells.groupBy("cell").agg(F.count("*").alias("m"), F.percentile_approx("angle", shares, 1000).alias("e")).collect()}
    rows = [(c, i, float(low), float(high)) for c, e in edges.items() for i, (low, high) in enumerate(zip([-1.0, *e], [*e, 4.0], strict=True))]
    bounds = F.broadcast(spark.createDataFrame(rows, "own int, window int, low double, high double"))  # WINDOWS a pivot at most
    placed = cells.join(bounds, (F.col("cell") == F.col("own")) & (F.col("angle") > F.col("low")) & (F.col("angle") <= F.col("high")))
    held = sorted(placed.groupBy("cell", "window").agg(F.min("angle").alias("a"), F.max("angle").alias("b"), F.count("*").alias("m")).collect())
    where = np.array([r.cell for r in held])
    low, high = np.array([r.a for r in held]) - reach, np.array([r.b for r in held]) + reach
    between = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 1e-12))

    def meets(units: np.ndarray, only: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Whether each vector has to be compared with each window."""
        dots = units @ pivots.T
        home = dots.argmax(axis=1)
        near = (dots[np.arange(len(home)), home][:, None] - dots) / between[home] <= np.sin(reach) + SLACK
        near[np.arange(len(home)), home] = True
        angle = angles(dots)[:, where[only]]
        return near[:, where[only]] & (angle >= low[only]) & (angle <= high[only])

    # windows go together into groups, so that a vector is sent once to many of them
    most = max(block, min(MOST_GROUP, -(-size.n // GROUPS)))
    first, parts, groups, filled = np.zeros(len(held), np.int64), np.ones(len(held), np.int64), 0, most
    for w, r in enumerate(held):
        if r.m > most:  # groups of its own
            first[w], parts[w], groups, filled = groups, -(-r.m // most), groups - (-r.m // most), most
        else:
            if filled + r.m > most:
                groups, filled = groups + 1, 0
            first[w], filled = groups - 1, filled + r.m

    def aims(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vector, group) of what has to be sent, and the windows that are met."""
        vector, window = np.nonzero(meets(units))
        times = parts[window]
        ends = np.cumsum(times)
        group = np.repeat(first[window] - (ends - times), times) + np.arange(ends[-1] if len(ends) else 0)
        return *np.divmod(np.unique(np.repeat(vector, times) * max(groups, 1) + group), max(groups, 1)), window

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(groups + len(where), np.int64), 0
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                _, group, window = aims(matrix(part.column("unit"), width))
                total += np.bincount(np.append(group, groups + window), minlength=len(total))
                seen += part.num_rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([*some.tolist(), -1], pa.int32()), pa.array([*total[some].tolist(), seen], pa.int64())], names=["g", "m"])

    asked = unit(left, "query_id").where(F.size("unit") == width)
    met = {r.g: r.m for r in asked.mapInArrow(counted, "g int, m long").groupBy("g").agg(F.sum("m").alias("m")).collect()}
    lefts_most = max(block, min(MOST_GROUP, -(-met.get(-1, 0) // GROUPS)))
    slices = np.array([-(-met.get(g, 0) // lefts_most) for g in range(groups)], np.int64)
    # a window's part of the right side, and the slices of left vectors that it meets
    to = [(r.cell, r.window, w, int(first[w]) + i, i, int(parts[w]), int(slices[first[w] + i])) for w, r in enumerate(held) for i in range(int(parts[w])) if slices[first[w] + i]]

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                vector, group, _ = aims(matrix(part.column("unit"), width))
                s = part.column("salt").to_numpy()[vector] % np.maximum(slices[group], 1)
                for low_ in range(0, len(vector), 4096):
                    cut = slice(low_, low_ + 4096)
                    rows = part.take(pa.array(vector[cut]))
                    yield pa.RecordBatch.from_arrays([rows.column("query_id"), rows.column("unit"), *(pa.array(x[cut].astype(np.int64)) for x in (group, s))], names=["query_id", "unit", "g", "s"])

    salted = lambda key: F.pmod(F.xxhash64(key), F.lit(1 << 30)).cast("long")
    lefts = asked.withColumn("salt", salted("query_id")).mapInArrow(sent, f"query_id {kinds[0]}, unit array<double>, g long, s long")
    dealt = F.broadcast(spark.createDataFrame(to, "own int, at int, w long, g long, r long, rs long, ss long"))  # as many rows as windows and their parts
    rights = placed.drop("own").join(dealt, (F.col("cell") == F.col("own")) & (F.col("window") == F.col("at")) & (F.pmod(salted("vec_id"), F.col("rs")) == F.col("r")))
    rights = rights.select("vec_id", "unit", "n", "w", "g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ss") - 1)).alias("s"))

    def compared(a: pa.Table, b: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if a.num_rows and b.num_rows:
            b = b.sort_by([("w", "ascending"), ("vec_id", "ascending")])
            x, y, n = matrix(a["unit"], width), matrix(b["unit"], width), b["n"].to_numpy()
            windows, begin = np.unique(b["w"].to_numpy(), return_index=True)
            ends = np.append(begin[1:], len(y))
            for start in range(0, len(x), BLOCK):
                met_ = np.ascontiguousarray(meets(x[start : start + BLOCK], windows).T)
                for w, low_, high_ in zip(range(len(windows)), begin, ends, strict=True):
                    own = np.flatnonzero(met_[w]) + start
                    for at in range(low_, high_, CHUNK) if len(own) else ():
                        cos = x[own] @ y[at : min(at + CHUNK, high_)].T
                        i, j = np.nonzero(cos >= least)
                        if not len(i):
                            continue
                        close = np.round(cos[i, j], 9)
                        order = np.lexsort((j, -close, i))
                        order = order[np.append(True, i[order][1:] != i[order][:-1])]
                        many = np.bincount(i, weights=n[at + j], minlength=len(own)).astype(np.int64)
                        found.append((own[i[order]], many[i[order]], j[order] + at, close[order]))
        i, many, best, cos = (np.concatenate([f[k] for f in found]) for k in range(4))
        return pa.table([a["query_id"].take(pa.array(i)), pa.array(many), b["vec_id"].take(pa.array(best)), pa.array(cos)], names=["query_id", "n", "vec_id", "cosine"])

    keys = ("g", "s")
    hits = lefts.groupBy(*keys).cogroup(rights.groupBy(*keys)).applyInArrow(compared, f"query_id {kinds[0]}, n long, vec_id {kinds[1]}, cosine double")
    best = hits.groupBy("query_id").agg(F.sum("n").alias("n_links"), F.min(F.struct((-F.col("cosine")).alias("c"), "vec_id", "cosine")).alias("best"))
    out = left.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "best.vec_id", "best.cosine")
    out.pairs, out.compared = met.get(-1, 0) * size.n, sum(held[g - groups].m * m for g, m in met.items() if g >= groups)
    out.paths = [whole.path, cells.path]
    return out
