"""Phrase collocations per language.

A-Z count as a-z. A text is cut into pieces at ``[.,;:!?\\x0A-\\x0D]``, a piece
into words ``[^\\x20\\x09]+``. Everything is counted per language (null: ``und``):
n is the number of all words, f(phrase) that of all contiguous occurrences within
pieces, overlaps included.

1. For each length from 1 to MAX_WORDS the grams of that length become rows
   (lang, phrase, n), which are summed up by hash aggregation. Words are all
   counted. A longer gram is written only where both grams of one word less that it
   holds occur ``least`` times: it can't occur more often than they do, so no phrase
   that counts is lost. A Bloom filter of these grams, of at most BLOOM_BITS, goes to
   the tasks; what it lets through in error is counted and falls away.
2. Phrases that occur ``least`` times are candidates. Each of their cuts is joined
   with the counts of its two parts, which occur as often at least and so have been
   counted; the score floor(1000 * a * n / (l * r)) is a quotient of decimals of 38
   digits. The lowest score counts, ties to the shortest first part.
3. A candidate inside a longer one that is as frequent is dropped. It is enough to
   look at phrases of one word more: counts only fall as phrases grow.
4. A window ranks the rest by score, count and phrase.

Null and empty texts have no words. Rows that repeat count each. Words that are
pieces of punctuation alone don't exist, as punctuation cuts. An empty table, or one
without candidates, gives an empty result. Other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .minhash import bits_of, set_bits
from .shared import bounded_batches, drop_scratch, scratch
from .words import LOWER, Words, mix, words

MAX_WORDS, LEAST, TOP = 5, 100, 2000
#: Bits of the Bloom filter of frequent grams (16 MB) at most.
BLOOM_BITS = 1 << 27
#: Rows of grams in one batch that goes back to the JVM.
ROWS = 100_000

BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAP = BREAK.copy()
GAP[[0x20, 0x09]] = True
_PLACE = mix(np.arange(1, 64, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def word_numbers(w: Words) -> np.ndarray:
    """A number for each word of a slice, the same exactly for equal words: by
    hash, then by comparison of the bytes with those of the first such word."""
    _, first, number = np.unique(w.hash, return_index=True, return_inverse=True)
    size, like = w.end - w.start, first[number]
    same = bool((size == size[like]).all())
    if same and len(size):
        shift = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        data = LOWER[w.data]
        same = bool((data[np.repeat(w.start, size) + shift] == data[np.repeat(w.start[like], size) + shift]).all())
    if same:
        return number.astype(np.int64)
    known: dict[str, int] = {}
    return np.array([known.setdefault(w.text(k), len(known)) for k in range(len(w.hash))], np.int64)


def pieces(w: Words) -> np.ndarray:
    """The number of each word's piece, across the texts of a slice."""
    return np.cumsum(BREAK[w.data])[w.start] + np.repeat(np.arange(len(w.doc) - 1), np.diff(w.doc))


def gram_hashes(hashes: np.ndarray, langs: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each position on, and of the language; as many as
    there are whole grams, whatever the pieces."""
    many = max(0, len(hashes) - n + 1)
    out = langs[:many].copy()
    for j in range(n):
        out += hashes[j : j + many] * _PLACE[j]
    return mix(out)


def language_hashes(langs: pa.Array) -> np.ndarray:
    """A hash of each row's language (one that any process finds again)."""
    every = langs.dictionary_encode()
    if isinstance(every, pa.ChunkedArray):
        every = every.combine_chunks()
    of = np.array([int.from_bytes(str(x).encode()[:64], "little") * 0x9E3779B97F4A7C15 % (1 << 64) for x in every.dictionary.to_pylist()], np.uint64)
    return mix(of)[every.indices.to_numpy()] if len(of) else np.zeros(0, np.uint64)


def joined(w: Words, at: np.ndarray, n: int) -> pa.Array:
    """The phrases of n words from some positions on, words joined by a space."""
    word = (at[:, None] + np.arange(n)).reshape(-1)
    size = w.end[word] - w.start[word]
    room = size + 1
    room[n - 1 :: n] -= 1  # no space at a phrase's end
    to = np.cumsum(room) - room
    out = np.full(int(room.sum()), 0x20, np.uint8)
    shift = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(to, size) + shift] = LOWER[w.data[np.repeat(w.start[word], size) + shift]]
    ends = np.concatenate([[0], np.cumsum(room)[n - 1 :: n]]).astype(np.int32)
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(out))


def grams(n: int, bloom=None, bits: int = 0) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (lang, text) to (lang, phrase, n): the grams of n words of each
    slice and how often each occurs there, without those that hold a gram of n - 1
    words that isn't in ``bloom``."""

    def frequent(h: np.ndarray) -> np.ndarray:
        at = bits_of(h.view(np.int64), bits)
        return ((bloom.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = language_hashes(batch.column(0))
            code = batch.column(0).dictionary_encode()
            names, codes = code.dictionary, code.indices.to_numpy().astype(np.int64)
            for i, w in words(batch.column(1), space=GAP):
                many = len(w.hash) - n + 1
                if many <= 0:
                    continue
                doc = np.repeat(np.arange(len(w.doc) - 1) + i, np.diff(w.doc))
                piece = pieces(w)
                ok = piece[:many] == piece[n - 1 :]
                if bloom is not None:
                    known = frequent(gram_hashes(w.hash, own[doc], n - 1))
                    ok &= known[:many] & known[1 : many + 1]
                at = np.flatnonzero(ok)
                if not len(at):
                    continue
                number = word_numbers(w)
                key = codes[doc[at]]
                for j in range(n):  # a pair of numbers at a time, so that equal keys are equal grams
                    key = np.unique((key << 32) | number[at + j], return_inverse=True)[1]
                _, first, count = np.unique(key, return_index=True, return_counts=True)
                for low in range(0, len(first), ROWS):
                    of = at[first[low : low + ROWS]]
                    lang = pa.DictionaryArray.from_arrays(pa.array(codes[doc[of]].astype(np.int32)), names).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([lang, joined(w, of, n), pa.array(count[low : low + ROWS].astype(np.int64))], names=["lang", "phrase", "n"])

    return run


def hashed(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (lang, phrase) of n words to (id): the hashes of ``gram_hashes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = language_hashes(batch.column(0))
            for i, w in words(batch.column(1), space=GAP):
                h = gram_hashes(w.hash, own[np.repeat(np.arange(len(w.doc) - 1) + i, np.diff(w.doc))], n)
                yield pa.RecordBatch.from_arrays([pa.array(h[:: n].view(np.int64))], names=["id"])

    return run


def filter_of(found: DataFrame, n: int) -> tuple[object, int]:
    """The Bloom filter of phrases of n words, as a broadcast value, and its bits."""
    spark = found.sparkSession
    bits = min(BLOOM_BITS, 1 << (max(64, 16 * found.count()) - 1).bit_length())
    ids = found.select("lang", "phrase").mapInArrow(hashed(n), "id long")
    rows = ids.mapInArrow(set_bits(bits), "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    bloom = np.zeros(bits // 64, np.uint64)
    bloom[rows.column("word").to_numpy()] = rows.column("mask").to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(bloom), bits


def counts(docs: DataFrame, most: int = MAX_WORDS, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, n) of all phrases that occur ``least`` times and have
    ``most`` words at most; (lang, n) of all words), written to the shared folder."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text is not null")
    counted = lambda run: texts.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    single = scratch(counted(grams(1)), "words")
    total = scratch(single.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    level = scratch(single.where(F.col("n") >= least), "grams1")
    drop_scratch(single)
    levels, written = [level.withColumn("words", F.lit(1))], [level]
    for n in range(2, most + 1):
        if level.isEmpty():
            break
        bloom, bits = filter_of(level, n - 1)
        level = scratch(counted(grams(n, bloom, bits)).where(F.col("n") >= least), f"grams{n}")
        bloom.destroy()
        written.append(level)
        levels.append(level.withColumn("words", F.lit(n)))
    out = levels[0]
    for other in levels[1:]:
        out = out.union(other)
    out = out.select("lang", "phrase", "words", "n")
    out.levels = written
    return out, total


def part(phrase: Column, first: Column, many: Column) -> Column:
    """Some words of a phrase, from the first-th (from 1) on."""
    return F.array_join(F.slice(F.split(phrase, " "), first, many), " ")


def quotient(a: str, n: str, left: str, right: str) -> Column:
    """floor(1000 * a * n / (l * r)), exactly."""
    return F.expr(f"(cast({a} as decimal(19,0)) * cast({n} as decimal(19,0)) * cast(1000 as decimal(4,0))) div (cast({left} as decimal(19,0)) * cast({right} as decimal(19,0)))")


def collocations(docs: DataFrame, most: int = MAX_WORDS, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language."""
    found, total = counts(docs, most, least)
    phrases = found.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))
    holders = phrases.where("words > 2")
    held = holders.select("lang", "a", F.explode(F.array(part(F.col("phrase"), F.lit(1), F.col("words") - 1), part(F.col("phrase"), F.lit(2), F.col("words") - 1))).alias("phrase"))
    cut = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).withColumn("first", part(F.col("phrase"), F.lit(1), F.col("k"))).withColumn("rest", part(F.col("phrase"), F.col("k") + 1, F.col("words")))
    own = lambda key, name: found.select("lang", F.col("phrase").alias(key), F.col("n").alias(name))
    scored = cut.join(own("first", "l"), ["lang", "first"]).join(own("rest", "r"), ["lang", "rest"]).join(total, "lang").withColumn("score", quotient("a", "n", "l", "r"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("cut")).select("lang", "phrase", "cut.*")
    left = lowest.join(held, ["lang", "phrase", "a"], "left_anti")
    rank = F.expr("row_number() over (partition by lang order by score desc, a desc, phrase)").cast("long")
    out = scratch(left.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "phrases")
    drop_scratch(total, *found.levels)
    return out


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_GRAMS = "\n    UNION ALL ".join(f"SELECT lang, {n} words, array_to_string(ws[i:i + {n - 1}], ' ') phrase FROM (SELECT lang, ws, unnest(range(1, len(ws) - {n} + 2)) i FROM split)" for n in range(1, MAX_WORDS + 1))
_SCORE = "CAST((CAST(1000 AS HUGEINT) * p.a * t.n) // (CAST(x.n AS HUGEINT) * y.n) AS BIGINT)"
SQL_OP11 = f"""
WITH piece AS (
    SELECT coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) p
    FROM documents),
split AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda x: x <> '') ws FROM piece),
grams AS MATERIALIZED (
    SELECT lang, words, phrase, count(*) n FROM ({_GRAMS}) GROUP BY ALL),
total AS (SELECT lang, sum(n) n FROM grams WHERE words = 1 GROUP BY lang),
often AS MATERIALIZED (SELECT * FROM grams WHERE n >= {LEAST}),
p AS (SELECT lang, phrase, words, n a, string_split(phrase, ' ') ws FROM often WHERE words > 1),
cut AS (SELECT *, unnest(range(1, words)) k FROM p),
scored AS (
    SELECT p.lang, p.phrase, p.ws, p.words, p.a, p.k, x.n l, y.n r, t.n n, {_SCORE} score
    FROM cut p
    JOIN often x ON x.lang = p.lang AND x.phrase = array_to_string(p.ws[1:p.k], ' ')
    JOIN often y ON y.lang = p.lang AND y.phrase = array_to_string(p.ws[p.k + 1:], ' ')
    JOIN total t ON t.lang = p.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (
    SELECT DISTINCT p.lang, p.a, array_to_string(p.ws[i:i + m - 1], ' ') phrase
    FROM (SELECT *, unnest(range(2, words)) m FROM p) p, range(1, {MAX_WORDS}) s(i) WHERE i + m - 1 <= words),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) rank
    FROM lowest l WHERE NOT EXISTS (SELECT 1 FROM inner_parts q WHERE q.lang = l.lang AND q.phrase = l.phrase AND q.a >= l.a))
SELECT lang, rank, phrase, CAST(a AS BIGINT) a, CAST(l AS BIGINT) l, CAST(r AS BIGINT) r, CAST(n AS BIGINT) n, score
FROM ranked WHERE rank <= {TOP}
"""
