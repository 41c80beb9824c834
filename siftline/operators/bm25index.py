"""A stored inverted index for BM25 with the greatest score of each block of postings.

An index is a folder of shards. A shard holds some documents that were indexed
together, numbered from 0: their ids and lengths (kind 0), and for each term its
postings (kind 1) in blocks of at most BLOCK documents: gaps between document numbers
and frequencies, each in as many bits as the block's largest needs, with the first and
last document and what bounds the block's scores: its greatest frequency and least
length. That bound holds whatever the average length becomes, so new documents are added as
new shards without touching old ones. A term that many documents have is spread over all
shards.

A search reads the blocks of the queries' terms alone. Each shard is searched by
itself: the blocks over a document bound its score, and so do the few blocks of rare
terms, which are unpacked at once. Documents of the greatest bounds are scored first;
then those whose bound reaches the k-th best score found. Blocks over no such document
are never unpacked. A task hands on k rows a query and shard. The result is that of scoring every document.

Null texts have no tokens but count as documents. Rows that repeat an id count each.
Null ids are kept and rank last among ties."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.text import tokens
from siftline.operators.retrieve import K1, QUERY_TERMS, B, top

BLOCK = 128
#: Blocks of a term in a shard that are opened before any bounds are compared.
FEW_BLOCKS = 4
#: Documents of a shard that are scored before any is passed over.
FIRST = 64
#: Tokens and documents of a shard, about.
SHARD_TOKENS, SHARD_DOCS = 1 << 21, 1 << 16
BLOCKS = "shard string, term string, n int, first int, last int, max_tf int, min_dl int, gap_bits int, tf_bits int, data binary, total long"


def packed(values: np.ndarray, width: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Bits of whole numbers, ``width`` of each from its place ``start`` on."""
    bits = np.zeros(size, np.uint8)
    inner = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
    bits[np.repeat(start, width) + inner] = (np.repeat(values, width) >> inner) & 1
    return bits


def unpacked(bits: np.ndarray, n: int, width: int) -> np.ndarray:
    return bits[: n * width].reshape(n, width).astype(np.int64) @ (1 << np.arange(width, dtype=np.int64))


def widths(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Bits that the largest value of each block needs."""
    return np.ceil(np.log2(np.maximum.reduceat(values, begin) + 1.0)).astype(np.int64)


def blocks(shard: str, terms: pa.Array, doc: np.ndarray, term: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
    """The blocks of one shard: (document, term) of its tokens, and documents' lengths."""
    pair, tf = np.unique(term * len(length) + doc, return_counts=True)
    term, doc = pair // len(length), pair % len(length)
    first = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
    place = np.arange(len(term)) - np.repeat(first, np.diff(np.append(first, len(term))))
    begin = np.flatnonzero(place % BLOCK == 0)
    n = np.diff(np.append(begin, len(term)))
    gap = np.diff(doc, prepend=0) - 1
    gap[begin] = 0
    gap_bits, tf_bits = (widths(x, begin) if len(begin) else begin for x in (gap, tf - 1))
    room = (n * (gap_bits + tf_bits) + 7) // 8
    at = 8 * (np.cumsum(room) - room)
    of = lambda x: np.repeat(x, n)
    size, inner = int(8 * room.sum()), np.arange(len(term)) - of(begin)
    bits = packed(gap, of(gap_bits), of(at) + inner * of(gap_bits), size) | packed(tf - 1, of(tf_bits), of(at + n * gap_bits) + inner * of(tf_bits), size)
    offsets = np.concatenate([[0], np.cumsum(room)]).astype(np.int32)
    data = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(np.packbits(bits, bitorder="little"))])
    whole = lambda x: pa.array(x.astype(np.int32))
    last = doc[np.append(begin[1:], len(doc)) - 1] if len(begin) else begin
    most, least = (np.maximum.reduceat(tf, begin), np.minimum.reduceat(length[doc], begin)) if len(begin) else (begin, begin)
    return pa.RecordBatch.from_arrays([pa.array([shard] * len(n), pa.string()), terms.take(pa.array(term[begin])), whole(n), whole(doc[begin]), whole(last), whole(most), whole(least), whole(gap_bits), whole(tf_bits), data, pa.nulls(len(n), pa.int64())], names=["shard", "term", "n", "first", "last", "max_tf", "min_dl", "gap_bits", "tf_bits", "data", "total"])


def add(docs: DataFrame, path: str) -> None:
    """Put (doc_id, text) into the index under ``path``, as new shards; the first call makes it."""
    segment = uuid.uuid4().hex
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        part, number, size, count = TaskContext.get().partitionId(), 0, 0, 0

        def shard() -> Iterator[pa.RecordBatch]:
            nonlocal held, number, size, count
            name = f"{segment}-{part}-{number}"
            ids, lists = (pa.concat_arrays([b.column(c) for b in held]) for c in (0, 1))
            length = lists.value_lengths().to_numpy().astype(np.int64)
            code = lists.flatten().dictionary_encode()
            own = blocks(name, code.dictionary, np.repeat(np.arange(len(length)), length), code.indices.to_numpy().astype(np.int64), length)
            names = ["kind", *own.schema.names, "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(own), np.int32)), *own.columns, pa.nulls(len(own), pa.list_(ids.type))], names=names)
            head = {"kind": pa.array([0], pa.int32()), "shard": pa.array([name]), "n": pa.array([len(length)], pa.int32()), "data": pa.array([length.astype("<i4").tobytes()], pa.binary()), "total": pa.array([int(length.sum())]), "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)}
            yield pa.RecordBatch.from_arrays([head.get(c, pa.nulls(1, own.schema.field(c).type if c in own.schema.names else None)) for c in names], names=names)
            held, number, size, count = [], number + 1, 0, 0

        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                held.append(batch)
                count, size = count + batch.num_rows, size + len(batch.column(1).flatten())
                if size >= SHARD_TOKENS or count >= SHARD_DOCS:
                    yield from shard()
        if count:
            yield from shard()

    rows = docs.select("doc_id", F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("tokens"))
    rows.mapInArrow(run, f"kind int, {BLOCKS}, ids array<{kind}>").write.mode("append").partitionBy("kind").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path)


class Shard:
    """One shard in a task: opens blocks as they are asked for."""

    def __init__(self, length: np.ndarray, average: float):
        self.norm = K1 * (1 - B + B * length / average) if average else np.zeros(len(length))
        self.length_norm = lambda dl: K1 * (1 - B + B * dl / average) if average else 0.0
        self.terms: dict[str, list[tuple]] = {}
        self.open: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
        self.asked: set[str] = set()

    def block(self, term: str, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, frequency's part of the score) of a block."""
        if (term, k) not in self.open:
            n, first, _, _, _, gap_bits, tf_bits, data = self.terms[term][k]
            bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
            gap = unpacked(bits, n, gap_bits)
            gap[0] = -1
            doc = first + np.cumsum(gap + 1)
            tf = unpacked(bits[n * gap_bits :], n, tf_bits) + 1
            self.open[term, k] = doc, tf * (K1 + 1) / (tf + self.norm[doc])
        return self.open[term, k]

    def best(self, weights: dict[str, float], k: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best, by score and the documents' ranks by id."""
        own = [(t, weights[t], len(self.terms[t])) for t in weights if t in self.terms]
        size = len(self.norm)
        score, change = np.zeros(size), np.zeros(size + 1)
        wide: list[tuple[str, int, float, int, int]] = []
        for t, weight, n in own:
            self.asked.add(t)
            if n <= FEW_BLOCKS:  # opened at once: each document bounds itself
                for j in range(n):
                    doc, part = self.block(t, j)
                    score[doc] += weight * part
                continue
            for j, (_, first, last, tf, dl, *_) in enumerate(self.terms[t]):
                most = weight * tf * (K1 + 1) / (tf + self.length_norm(dl))
                change[first] += most
                change[last + 1] -= most
                wide.append((t, j, weight, first, last))
        bound = score + np.cumsum(change)[:size]
        done = np.zeros(size, bool)
        some = np.argpartition(-bound, FIRST)[:FIRST] if size > FIRST else np.arange(size)
        for _ in range(2):  # the documents of the greatest bounds first, then all that may still be among the best
            mask = np.zeros(size, bool)
            mask[some] = True
            before = np.concatenate([[0], np.cumsum(mask)])
            for t, j, weight, first, last in wide:
                if before[last + 1] > before[first]:
                    doc, part = self.block(t, j)
                    keep = mask[doc]
                    score[doc[keep]] += weight * part[keep]
            done |= mask
            found = np.flatnonzero(done & (score > 1e-12))
            least = np.partition(score[found], len(found) - k)[len(found) - k] if len(found) >= k else 0.0
            some = np.flatnonzero(~done & (bound > 1e-12) & (bound + 2e-6 >= least))
        rounded = np.round(score[found], 6)
        order = np.lexsort((rank[found], -rounded))[:k]
        return found[order], rounded[order]


def searched(docs: DataFrame, path: str, pairs: list[tuple], k: int) -> DataFrame:
    """(item_id, doc_id, score, blocks, opened): the k best of every shard for the
    queries whose (item, term) are ``pairs``, and a row without an item for each shard, with
    the number of blocks that its queries asked for and of those that were unpacked."""
    spark = docs.sparkSession
    index = stored(spark, path)
    terms = spark.createDataFrame([(t,) for t in sorted({t for _, t in pairs})], "term string")  # of a block of a stated set
    postings = index.where("kind = 1").join(F.broadcast(terms), "term", "left_semi").select(index.columns)
    counts = {r.term: r.n for r in postings.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    heads = index.where("kind = 0")
    size = heads.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    n_docs = size.n or 0
    average = (size.total or 0) / max(n_docs, 1)
    weights: dict = {}
    for item, term in pairs:
        if term in counts:
            weights.setdefault(item, {})[term] = float(np.log1p((n_docs - counts[term] + 0.5) / (counts[term] + 0.5)))
    shared = spark.sparkContext.broadcast(weights)
    kind = index.schema["ids"].dataType.elementType.simpleString()
    schema = f"item_id long, doc_id {kind}, score double, blocks long, opened long"

    def of_shard(rows: list[dict]) -> pa.RecordBatch:
        ids = next(r["ids"] for r in rows if r["kind"] == 0)
        own = Shard(np.frombuffer(next(r["data"] for r in rows if r["kind"] == 0), "<i4").astype(np.float64), average)
        for r in rows:
            if r["kind"] == 1:
                own.terms.setdefault(r["term"], []).append(tuple(r[c] for c in ("n", "first", "last", "max_tf", "min_dl", "gap_bits", "tf_bits", "data")))
        rank = np.argsort(sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i])))
        out = [(item, ids[d], score, None, None) for item, wanted in shared.value.items() for d, score in zip(*(x.tolist() for x in own.best(wanted, k, rank)), strict=True)]
        out.append((None, None, None, sum(len(own.terms[t]) for t in own.asked), len(own.open)))
        kinds = (pa.int64(), rows_type, pa.float64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(kinds)], names=["item_id", "doc_id", "score", "blocks", "opened"])

    rows_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["shard"] != held[0]["shard"]:
                    yield of_shard(held)
                    held = []
                held.append(row)
        if held:
            yield of_shard(held)

    return heads.union(postings.select(heads.columns)).repartition("shard").sortWithinPartitions("shard", "kind", "term", "first").mapInArrow(run, schema)


def search(index: str, queries: DataFrame, k: int = 10, report: bool = False) -> DataFrame:
    """(item_id, doc_id, score, rank) of the k best documents of each query (item_id,
    text), as if all were scored; or, as a report, (blocks, opened) of each shard and
    block of queries. Queries are a stated set, in blocks of QUERY_TERMS terms."""
    spark = queries.sparkSession
    pairs = queries.select("item_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).orderBy("item_id", "term").toLocalIterator()
    found, held = None, []

    def block(held: list) -> DataFrame:
        rows = searched(queries, index, held, k)
        if report:
            return rows.where("item_id is null").select("blocks", "opened")
        return top(rows.where("item_id is not null").select("item_id", "doc_id", "score"), "item_id", [F.desc("score"), F.asc_nulls_last("doc_id")], k)

    for r in pairs:
        if len(held) >= QUERY_TERMS and r.item_id != held[-1][0]:
            found, held = block(held) if found is None else found.union(block(held)), []
        held.append((r.item_id, r.term))
    if held or found is None:
        more = block(held) if held else block([]).limit(0)
        found = more if found is None else found.union(more)
    return found
