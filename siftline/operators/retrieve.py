"""Lexical, vector and hybrid retrieval for a table of queries at once.

``docs`` has (doc_id, text), ``queries`` (item_id, text); vectors are tables of
(vec_id, embedding). Queries are a stated set; documents and vectors may be of any
size and are never collected. Ties rank by the smaller id. Null texts have no
tokens, and rows without tokens are never found."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.text import CJK, tokens

K1, B = 1.5, 0.75


#: Bytes of a query set that go to the tasks at once.
NEEDLE_BYTES = 32 << 20


def in_blocks(asked: DataFrame, size: Callable[[tuple], int], search: Callable[[list[tuple]], DataFrame]) -> DataFrame:
    """The union of what ``search`` finds for blocks of the rows of a stated set, each
    of about NEEDLE_BYTES; there is one block at least."""
    found, held, total = None, [], 0
    for row in asked.toLocalIterator():
        if total > NEEDLE_BYTES:
            found, held, total = search(held) if found is None else found.unionByName(search(held)), [], 0
        held.append(tuple(row))
        total += size(row)
    return search(held) if found is None else found.unionByName(search(held))


def occurrences(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """(item_id, doc_id, n): how often each needle (item_id, key) of a stated set
    occurs in each text (doc_id, text), without overlaps, where it does."""
    return found_at(texts, needles).select("item_id", "doc_id", "n")


def found_at(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """(item_id, doc_id, n, first_end, last_start): ``occurrences`` and, counted from 0,
    the last character of the first one and the first of the last. One automaton of all
    needles reads each text once."""
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((needles, "item_id"), (texts, "doc_id"))]

    def search(asked: list[tuple]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            of: dict[str, list] = {}
            for item, key in asked:
                of.setdefault(key, []).append(item)
            machine = ahocorasick.Automaton()
            for key in of:
                machine.add_word(key, key)
            machine.make_automaton()
            for batch in batches:
                rows: list[tuple] = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    counts: dict[str, int] = {}
                    free: dict[str, int] = {}  # where the next occurrence may begin
                    ends: dict[str, int] = {}
                    starts: dict[str, int] = {}
                    for end, key in machine.iter(text) if text and len(machine) else ():
                        ends.setdefault(key, end)
                        starts[key] = end + 1 - len(key)
                        if starts[key] >= free.get(key, 0):
                            counts[key] = counts.get(key, 0) + 1
                            free[key] = end + 1
                    rows += [(item, doc, n, ends[key], starts[key]) for key, n in counts.items() for item in of[key]]
                whole = [pa.array([r[k] for r in rows], pa.int64()) for k in (2, 3, 4)]
                own = [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], batch.schema.field(0).type)] if rows else [pa.nulls(0, pa.int64()), batch.column(0).slice(0, 0)]
                yield pa.RecordBatch.from_arrays(own + whole, names=["item_id", "doc_id", "n", "first_end", "last_start"])

        return texts.select("doc_id", "text").mapInArrow(run, f"item_id {kinds[0]}, doc_id {kinds[1]}, n long, first_end long, last_start long")

    return in_blocks(needles.select("item_id", "key").where("key <> ''"), lambda r: 4 * len(r[1]) + 16, search)


def overlapping(docs: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """(item_id, doc_id, score) of the pairs whose lexical overlap (0.7 of the share of
    the query's CJK characters and 0.3 of its words that the text has) is at least
    ``least``, which is over 0. Each text's words are looked up once for all queries."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"[{CJK}]|[a-z0-9]+"), F.lit(0)))
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((queries, "item_id"), (docs, "doc_id"))]

    def search(asked: list[tuple]) -> DataFrame:
        ids = [item for item, _ in asked]
        terms = sorted({t for _, own in asked for t in own})
        place = {t: n for n, t in enumerate(terms)}
        pairs = np.array(sorted((place[t], k) for k, (_, own) in enumerate(asked) for t in own), np.int64).reshape(-1, 2)
        first = np.searchsorted(pairs[:, 0], np.arange(len(terms) + 1))
        wide = np.array([not t.isascii() for t in terms], bool)
        sizes = [np.bincount(pairs[wide[pairs[:, 0]] == side, 1], minlength=len(ids)) + 0.001 for side in (True, False)]
        worth = np.where(wide[pairs[:, 0]], 0.7 / sizes[0][pairs[:, 1]], 0.3 / sizes[1][pairs[:, 1]])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked_terms, step = pa.array(terms, pa.string()), max(1, SCORES // max(len(ids), 1))
            for whole in batches:
                for low in range(0, whole.num_rows, step):
                    batch = whole.slice(low, step)
                    lists = batch.column(1)
                    found = pc.index_in(lists.flatten(), value_set=asked_terms)
                    known = found.is_valid().to_numpy(zero_copy_only=False)
                    term = found.fill_null(0).to_numpy().astype(np.int64)[known]
                    doc = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))[known]
                    many = first[term + 1] - first[term]
                    row = np.repeat(np.arange(len(term)), many)
                    at = np.repeat(first[term] - (np.cumsum(many) - many), many) + np.arange(len(row))
                    score = np.bincount(doc[row] * len(ids) + pairs[at, 1], weights=worth[at], minlength=len(lists) * len(ids))
                    hit = np.flatnonzero(score >= least - 1e-9)
                    yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in (hit % len(ids)).tolist()], None if len(hit) else pa.int64()), batch.column(0).take(pa.array(hit // max(len(ids), 1))), pa.array(score[hit])], names=["item_id", "doc_id", "score"])

        rows = docs.select("doc_id", words(F.col("text")).alias("w"))
        return rows.mapInArrow(run, f"item_id {kinds[0]}, doc_id {kinds[1]}, score double")

    asked = queries.select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0")
    return in_blocks(asked, lambda r: 16 * sum(len(t) + 4 for t in r[1]), search).withColumn("score", F.round("score", 6)).where(F.col("score") >= least)


#: Tokens of a task at once, about.
TOKENS = 1 << 18


def pieces(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``most`` rows and TOKENS items in the lists of the last column,
    or a single row."""
    offsets, low = batch.column(batch.num_columns - 1).offsets.to_numpy(), 0
    while low < batch.num_rows:
        high = int(np.searchsorted(offsets, offsets[low] + TOKENS, "right")) - 1
        high = max(low + 1, min(high, low + most, batch.num_rows))
        yield batch.slice(low, high - low)
        low = high


def term_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf). Documents of one row are counted where they lie; only the
    terms of ids that come again, and of null ones, which are one document, are shuffled."""
    again = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    tokenised = lambda df: df.select("doc_id", tokens(F.col("text")).alias("tokens"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, whole.num_rows):
                lists = batch.column(1)
                coded = lists.flatten().dictionary_encode()
                code, terms = coded.indices.to_numpy().astype(np.int64), coded.dictionary
                doc = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                pair, times = np.unique(doc * max(len(terms), 1) + code, return_counts=True)
                doc, term = np.divmod(pair, max(len(terms), 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), terms.take(pa.array(term)), pa.array(times)], names=["doc_id", "term", "tf"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    single = lambda df: tokenised(df).mapInArrow(counted, f"doc_id {kind}, term string, tf long")
    if again.isEmpty():
        return single(docs)
    known = docs.where("doc_id is not null")
    rest = tokenised(known.join(again, "doc_id", "left_semi").select("doc_id", "text").union(docs.where("doc_id is null").select("doc_id", "text")))
    some = rest.select("doc_id", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    return single(known.join(again, "doc_id", "left_anti")).union(some)


def term_weights(docs: DataFrame) -> DataFrame:
    """(term, n, idf): document frequency and ln(1 + (N - n + 0.5) / (n + 0.5))."""
    total = docs.agg(F.count("*").alias("n_docs"))
    counted = term_counts(docs).groupBy("term").agg(F.count("*").alias("n"))
    return counted.crossJoin(F.broadcast(total)).select("term", "n", F.log1p((F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)).alias("idf"))


def top(df: DataFrame, by: str | list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(name) <= n)


def bm25(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(item_id, doc_id, score) of all documents that share a term with a query.

    The queries' terms (a stated set) restrict the postings before anything is
    shuffled; lengths and weights come from the same pass over the tokens."""
    wanted = queries.select("item_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    terms = wanted.select("term").distinct()
    tokenised = docs.select("doc_id", tokens(F.col("text")).alias("tokens"))
    sizes = tokenised.agg(F.count("*").alias("n_docs"), (F.sum(F.size("tokens")) / F.greatest(F.count("*"), F.lit(1))).alias("avgdl"))
    hits = tokenised.select("doc_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).join(terms, "term", "left_semi")
    postings = hits.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    df = postings.groupBy("term").agg(F.count("*").alias("n"))
    rows = postings.join(df, "term").join(wanted, "term").crossJoin(F.broadcast(sizes))
    idf = F.log1p((F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return rows.groupBy("item_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))


#: Pairs of query and term that go to the tasks at once, and scores in memory.
QUERY_TERMS, SCORES = 1 << 20, 1 << 22


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = 10, side: Column | None = None) -> DataFrame:
    """(item_id, doc_id, score, rank) of the k best documents of each query; with a
    ``side`` (a condition on ``docs``; null counts as false) the k best of either side, and a column ``side``.

    One pass counts documents, tokens and the documents of each wanted term; the
    second scores every document where it lies and keeps the k best of a task for each
    query, so that only those are shuffled. Queries go to the tasks in blocks of at
    most QUERY_TERMS pairs of query and term."""
    rows = queries.select("item_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).orderBy("item_id", "term").toLocalIterator()
    found, held = None, []

    def search(pairs: list) -> DataFrame:
        return best(_scored(docs, pairs, k, side))

    def best(scored: DataFrame) -> DataFrame:
        by = ["item_id"] if side is None else ["item_id", "side"]
        return top(scored if side is not None else scored.drop("side"), by, [F.desc("score"), F.asc("doc_id")], k)

    for r in rows:
        if len(held) >= QUERY_TERMS and r.item_id != held[-1][0]:
            found, held = search(held) if found is None else found.unionByName(search(held)), []
        held.append((r.item_id, r.term))
    if held or found is None:
        more = search(held) if held else best(docs.sparkSession.createDataFrame([], f"item_id long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, side boolean"))
        found = more if found is None else found.unionByName(more)
    return found


def _scored(docs: DataFrame, pairs: list[tuple], k: int, side: Column | None) -> DataFrame:
    """(item_id, doc_id, score, side): the best of every task and side."""
    spark = docs.sparkSession
    terms = sorted({t for _, t in pairs})
    place = {t: i for i, t in enumerate(terms)}
    items = sorted({i for i, _ in pairs})
    at = {i: n for n, i in enumerate(items)}
    asked = spark.sparkContext.broadcast(pa.array(terms, pa.string()))
    of_side = F.lit(False) if side is None else F.coalesce(side, F.lit(False))
    tokenised = docs.select("doc_id", of_side.alias("side"), tokens(F.col("text")).alias("tokens"))

    def wanted(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sizes of a batch's documents, and (document, term, frequency) of wanted terms."""
        lists = batch.column(batch.num_columns - 1)
        sizes = np.diff(lists.offsets.to_numpy())
        ids = pc.index_in(lists.flatten(), value_set=asked.value)
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        term = ids.fill_null(0).to_numpy().astype(np.int64)[known]
        doc = np.repeat(np.arange(len(sizes)), sizes)[known]
        pair, times = np.unique(doc * len(terms) + term, return_counts=True)
        return sizes, pair // len(terms), pair % len(terms), times

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, df = 0, 0, np.zeros(len(terms), np.int64)
        for batch in (piece for whole in batches for piece in pieces(whole, whole.num_rows)):
            sizes, _, term, _ = wanted(batch)
            n, total, df = n + len(sizes), total + int(sizes.sum()), df + np.bincount(term, minlength=len(terms))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *some.tolist()], pa.int64()), pa.array([n, total, *df[some].tolist()], pa.int64())], names=["term", "n"])

    counts = {r.term: r.n for r in tokenised.select("tokens").mapInArrow(counted, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator()}
    n_docs, average = counts.get(-2, 0), counts.get(-1, 0) / max(counts.get(-2, 0), 1)
    df = np.array([counts.get(i, 0) for i in range(len(terms))], np.float64)
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))
    # the queries of each term, one after the other
    of_term = np.array(sorted((place[t], at[i]) for i, t in pairs), np.int64).reshape(-1, 2)
    first = np.searchsorted(of_term[:, 0], np.arange(len(terms) + 1))
    shared = spark.sparkContext.broadcast((idf, of_term[:, 1].copy(), first, np.array(items)))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, of, first, ids = shared.value
        kept = (np.zeros(0, np.int64), np.zeros(0, np.float64), np.zeros(0, np.int64))  # query and side, score, document
        least = np.full(2 * len(ids), -np.inf)  # the k-th best score so far
        for whole in batches:
            for batch in pieces(whole, max(1, SCORES // len(ids))):
                sizes, doc, term, times = wanted(batch)
                if not len(doc):
                    continue
                part = idf[term] * times * (K1 + 1) / (times + K1 * (1 - B + B * sizes[doc] / average))
                many = first[term + 1] - first[term]
                score, ends, start = np.zeros(len(sizes) * len(ids)), np.cumsum(many), 0
                while start < len(doc):
                    stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SCORES, "right")))
                    row = np.repeat(np.arange(start, stop), many[start:stop])
                    item = of[np.repeat(first[term[start:stop]] - (ends[start:stop] - many[start:stop]), many[start:stop]) + np.arange(len(row)) + (ends[start - 1] if start else 0)]
                    score += np.bincount(doc[row] * len(ids) + item, weights=part[row], minlength=len(score))
                    start = stop
                hit = np.flatnonzero(score)
                sides = batch.column(1).to_numpy(zero_copy_only=False)[hit // len(ids)]
                query = 2 * (hit % len(ids)) + sides
                able = score[hit] > least[query] - 2e-6  # with the same six digits the smaller id counts
                hit, query = hit[able], query[able]
                own = batch.column(0).to_numpy()[hit // len(ids)]
                kept = _k_best(np.concatenate([kept[0], query]), np.concatenate([kept[1], score[hit]]), np.concatenate([kept[2], own]), k)
                begin = np.flatnonzero(np.append(True, kept[0][1:] != kept[0][:-1])) if len(kept[0]) else np.zeros(0, np.int64)
                full = begin[np.diff(np.append(begin, len(kept[0]))) == k] + k - 1
                least[kept[0][full]] = kept[1][full]
        yield pa.RecordBatch.from_arrays([pa.array(ids[kept[0] // 2]), pa.array(kept[2]), pa.array(kept[1]), pa.array(kept[0] % 2 == 1)], names=["item_id", "doc_id", "score", "side"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return tokenised.mapInArrow(best, f"item_id long, doc_id {kind}, score double, side boolean").withColumn("score", F.round("score", 6))


def _k_best(item: np.ndarray, score: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k rows of each item with the best scores (of six digits), ties by document."""
    order = np.lexsort((doc, -np.floor(score * 1e6 + 0.5), item))
    item, score, doc = item[order], score[order], doc[order]
    begin = np.flatnonzero(np.append(True, item[1:] != item[:-1])) if len(item) else np.zeros(0, np.int64)
    place = np.arange(len(item)) - np.repeat(begin, np.diff(np.append(begin, len(item))))
    keep = place < k
    return item[keep], score[keep], doc[keep]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 1024) -> DataFrame:
    """(query_id, vec_id, dist, cosine) of the k vectors nearest by Euclidean distance.

    Blocks of queries go to every task, which reads ``block`` vectors at once and keeps
    its own k best for each query; only those are shuffled. Vectors that are null or not as long as the queries are
    never found."""
    spark = vectors.sparkSession
    rows = queries.select("query_id", "embedding").where("embedding is not null").toLocalIterator()
    found = None
    held: list = []

    def search(held: list) -> DataFrame:
        ids = np.array([r.query_id for r in held], np.int64)
        q = np.array([r.embedding for r in held], np.float64)
        shared = spark.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            long = (q**2).sum(1)
            kept = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0))  # query, distance, vector, cosine
            worst = np.full(len(ids), np.inf)
            for whole in batches:
                for low in range(0, whole.num_rows, block):
                    batch = whole.slice(low, block)
                    batch = batch.filter(pc.equal(pc.list_value_length(batch.column(1)), q.shape[1]))
                    if not batch.num_rows:
                        continue
                    own = batch.column(0).to_numpy().astype(np.int64)
                    x = batch.column(1).flatten().to_numpy().astype(np.float64).reshape(len(own), -1)
                    dots, square = q @ x.T, (x**2).sum(1)
                    dist = np.sqrt(np.maximum(long[:, None] + square[None, :] - 2 * dots, 0))
                    # those that may be among the k best: with the same six digits the smaller id counts
                    bound = np.minimum(worst, np.partition(dist, k - 1, axis=1)[:, k - 1] if len(own) > k else np.inf) + 2e-6
                    row, at = np.nonzero(~(dist > bound[:, None]))
                    norm = np.sqrt(long[row]) * np.sqrt(square[at])
                    cosine = np.divide(dots[row, at], norm, out=np.zeros_like(norm), where=norm > 0)
                    query, far, vector, cosine = (np.concatenate(c) for c in zip(kept, (row, dist[row, at], own[at], cosine), strict=True))
                    order = np.lexsort((vector, np.floor(far * 1e6 + 0.5), query))
                    query = query[order]
                    begin = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
                    many = np.diff(np.append(begin, len(query)))
                    place = np.arange(len(query)) - np.repeat(begin, many)
                    order = order[place < k]
                    query, kept = query[place < k], (query[place < k], far[order], vector[order], cosine[order])
                    last = place[place < k] == k - 1
                    worst[query[last]] = kept[1][last]
            yield pa.RecordBatch.from_arrays([pa.array(ids[kept[0]]), pa.array(kept[2]), pa.array(kept[1]), pa.array(kept[3])], names=["query_id", "vec_id", "dist", "cosine"])

        near = vectors.select("vec_id", "embedding").mapInArrow(run, "query_id long, vec_id long, dist double, cosine double")
        return top(near, "query_id", [F.round("dist", 6).asc(), F.asc("vec_id")], k)

    for r in rows:
        held.append(r)
        if len(held) == block:
            found, held = search(held) if found is None else found.union(search(held)), []
    if held or found is None:
        more = search(held) if held else spark.createDataFrame([], "query_id long, vec_id long, dist double, cosine double, rank int")
        found = more if found is None else found.union(more)
    return found


def similarity(distance: Column, legacy: bool = False) -> Column:
    """1 / (1 + distance), or 1 - distance and 0 from 1 on."""
    return F.when(distance < 1, 1 - distance).otherwise(0.0) if legacy else 1 / (1 + distance)


def fused(vector_hits: DataFrame, lexical_hits: DataFrame, texts: DataFrame, k: int = 10, mode: str = "weighted", weights: tuple[float, float] = (0.6, 0.4)) -> DataFrame:
    """(item_id, text, doc_id, score, rank) from two lists of (item_id, doc_id, score, rank).

    Hits of equal texts are one: the lowest-ranked gives the score, the smallest id
    the document. ``weighted``: the weighted sum, or the score of the only side that
    has the text. ``rrf``: weight / (60 + rank), a missing side ranking after its list."""

    def side(hits: DataFrame, name: str) -> DataFrame:
        h = hits.join(texts, "doc_id")
        return h.groupBy("item_id", "text").agg(F.max_by("score", "rank").alias(f"{name}_score"), F.max("rank").alias(f"{name}_rank"), F.min("doc_id").alias(f"{name}_doc"))

    both = side(vector_hits, "v").join(side(lexical_hits, "b"), ["item_id", "text"], "full_outer")
    if mode == "rrf":
        sizes = lambda hits, name: hits.groupBy("item_id").agg(F.count("*").alias(name))
        both = both.join(sizes(vector_hits, "nv"), "item_id", "left").join(sizes(lexical_hits, "nb"), "item_id", "left")
        after = lambda rank, n: F.coalesce(F.col(rank), F.coalesce(F.col(n), F.lit(0)) + 1)
        score = weights[0] / (60 + after("v_rank", "nv")) + weights[1] / (60 + after("b_rank", "nb"))
    else:
        score = F.when(F.col("v_score").isNull(), F.col("b_score")).when(F.col("b_score").isNull(), F.col("v_score")).otherwise(weights[0] * F.col("v_score") + weights[1] * F.col("b_score"))
    out = both.select("item_id", "text", F.least("v_doc", "b_doc").alias("doc_id"), F.round(score, 6).alias("score"))
    return top(out, "item_id", [F.desc("score"), F.asc("doc_id")], k)


def hybrid(docs: DataFrame, queries: DataFrame, vectors: DataFrame, k: int = 10, mode: str = "weighted") -> DataFrame:
    """Both sides over-fetch 2k hits, are fused and cut to k. ``vectors`` holds the
    documents' vectors by doc_id (vec_id) and the queries' by item_id."""
    asked = queries.select(F.col("item_id").alias("query_id")).join(vectors, F.col("query_id") == F.col("vec_id")).select("query_id", "embedding")
    near = nearest(vectors, asked, 2 * k).select(F.col("query_id").alias("item_id"), F.col("vec_id").alias("doc_id"), F.round(similarity(F.col("dist")), 6).alias("score"), "rank")
    lexical = bm25_topk(docs, queries, 2 * k)
    best = F.max("score").over(Window.partitionBy("item_id"))
    lexical = lexical.select("item_id", "doc_id", F.round(F.col("score") / best, 6).alias("score"), "rank")
    return fused(near, lexical, docs.select("doc_id", "text"), k, mode)


def exact_prefix(docs: DataFrame, queries: DataFrame, answered: DataFrame, prefix: int = 10) -> DataFrame:
    """(item_id, doc_id, hits, score) for queries without an answer: documents that
    contain the query's first characters, in any case.

    The prefixes (of the stated query set) are searched in one pass over each text; the
    score is least(0.75 + least(hits / 10, 0.15), 0.95)."""
    left = queries.join(answered.select("item_id").distinct(), "item_id", "left_anti")
    keys = left.select("item_id", F.substring(F.lower("text"), 1, prefix).alias("key")).where("key <> ''")
    hits = occurrences(docs.select("doc_id", F.lower("text").alias("text")), keys).withColumnRenamed("n", "hits")
    return hits.withColumn("score", F.round(F.least(0.75 + F.least(F.col("hits") / 10, F.lit(0.15)), F.lit(0.95)), 6))
