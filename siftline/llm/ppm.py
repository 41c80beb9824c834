"""Language identification by prediction with partial matching (PPM).

Each language has a byte context tree of orders 0 to ``ORDER`` with frozen
counts. The code length of a byte is that of the longest context that has seen
it, plus the escapes from the longer contexts that haven't (method C: in a
context with n symbols, d of them distinct, a symbol seen c times has probability
c / (n + d), an escape d / (n + d)); below order 0 all 256 bytes are equally
likely. A text's language is the one under whose statistics the whole text takes
the fewest bits; ties go to the first in alphabetical order. The score is the
posterior of that language, all being equally likely before.

Coded are the bytes of the text with A-Z as a-z and each run of other ASCII
characters as one space. Null texts and texts without a letter get ``und`` and
score 0; so does every text where nothing was learned. Long texts are coded
whole. Repeated rows give repeated results, an empty table an empty one; columns
other than those named are ignored.

The trees are fitted on a bounded sample: of the ``MOST_LANGUAGES`` most frequent
languages (ties by name) ``PER_LANGUAGE`` documents each, those with the smallest
hashes of their ids, of at most ``LONGEST_SAMPLE`` characters each and together at
most ``SAMPLE_CHARS`` a language. A document without an id isn't held out, and
doesn't teach.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import bounded_batches
from .words import LOWER, mix, slices

ORDER = 4
PER_LANGUAGE, LONGEST_SAMPLE, MOST_LANGUAGES, SAMPLE_CHARS = 400, 65_536, 200, 2_000_000

_CODED = LOWER.copy()
_CODED[[b for b in range(128) if not chr(b).isalpha()]] = 32
UND = "und"


def stream(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The coded bytes of a slice's texts and the start of each text in them."""
    x = _CODED[data]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
    first = at[:-1][at[:-1] < len(x)]
    keep[first] = True
    return x[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def grams(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each byte, it and the ORDER bytes before it as one number (the byte
    itself lowest); before a text's start stand spaces."""
    pos = np.arange(len(x)) - np.repeat(at[:-1], np.diff(at))
    key = x.astype(np.uint64)
    for j in range(1, ORDER + 1):
        before = np.full(len(x), 32, np.uint64)
        before[j:] = x[: len(x) - j]
        before[pos < j] = 32
        key |= before << np.uint64(8 * j)
    return key


class Table:
    """Rows of floats by 64-bit key, with linear probing."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
        self.at = np.zeros(1 << bits, np.int32)
        self.rows = np.vstack([rows, np.zeros((1, rows.shape[1]), np.float32)]).astype(np.float32)
        left, slot = np.arange(len(keys)), (mix(keys) >> self.shift).astype(np.int64)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.keys[slot] == np.iinfo(np.uint64).max
            _, one = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[one]
            self.keys[slot[put]], self.at[slot[put]] = keys[left[put]], left[put]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, slot = left[rest], (slot[rest] + 1) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers; -1 where the key isn't there."""
        slot = (mix(keys) >> self.shift).astype(np.int64)
        out = np.where(self.keys[slot] == keys, self.at[slot], -1)
        left = np.flatnonzero((out < 0) & (self.keys[slot] != np.iinfo(np.uint64).max))
        for k in range(1, self.probes):
            if not len(left):
                break
            s = (slot[left] + k) & self.mask
            hit = self.keys[s] == keys[left]
            out[left[hit]] = self.at[s[hit]]
            left = left[~hit & (self.keys[s] != np.iinfo(np.uint64).max)]
        return out


@dataclass
class Model:
    """costs[o]: bits of each seen (o bytes, byte) in each language, escapes
    included; escapes[o]: bits of an escape from each seen context of o bytes."""

    languages: list[str]
    costs: list[Table]
    escapes: list[Table]


def fit(samples: dict[str, list[str]]) -> Model | None:
    """A model of {language: texts}."""
    languages = sorted(k for k, texts in samples.items() if any(texts))
    if not languages:
        return None
    keys = []
    for language in languages:
        parts = [grams(*stream(data, at)) for _, data, at in slices(pa.array(samples[language], pa.string()))]
        keys.append(np.concatenate(parts))
    costs, escapes = [], []
    for order in range(ORDER + 1):
        low = np.uint64((1 << (8 * (order + 1))) - 1)
        counted = [np.unique(k & low, return_counts=True) for k in keys]
        every = np.unique(np.concatenate([k for k, _ in counted]))
        context = np.unique(every >> np.uint64(8))
        inside = np.searchsorted(context, every >> np.uint64(8))
        cost, escape = np.zeros((len(every), len(languages))), np.zeros((len(context), len(languages)))
        for j, (k, n) in enumerate(counted):
            count = np.zeros(len(every))
            count[np.searchsorted(every, k)] = n
            total, distinct = np.bincount(inside, count), np.bincount(inside, count > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape[:, j] = np.where(total > 0, np.log2((total + distinct) / distinct), 0)
                seen = np.log2((total + distinct)[inside] / count)
            shorter = costs[-1].rows[costs[-1].find(every & np.uint64((1 << (8 * order)) - 1)), j] if order else np.full(len(every), 8.0)
            cost[:, j] = np.where(count > 0, seen, escape[inside, j] + shorter)
        costs.append(Table(every, cost))
        escapes.append(Table(context, escape))
    return Model(languages, costs, escapes)


def bits(model: Model, x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code length of each text in each language."""
    n = len(model.languages)
    out = np.zeros((len(at) - 1, n))
    if not len(x):
        return out
    key = grams(x, at)
    cost = np.zeros((len(x), n), np.float32)
    left = np.arange(len(x))
    for order in range(ORDER, -1, -1):
        k = key[left] & np.uint64((1 << (8 * (order + 1))) - 1)
        row = model.costs[order].find(k)
        hit = row >= 0
        if order == ORDER:
            cost[hit] = model.costs[order].rows[row[hit]]
        else:
            cost[left[hit]] += model.costs[order].rows[row[hit]]
        left, k = left[~hit], k[~hit]
        if not len(left):
            break
        cost[left] += model.escapes[order].rows[model.escapes[order].find(k >> np.uint64(8))]
    else:
        cost[left] += 8
    some = np.flatnonzero(np.diff(at))
    out[some] = np.add.reduceat(cost, at[some], axis=0, dtype=np.float64)
    return out


def has_letter(texts: pa.Array, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each text of a slice has a letter of any script."""
    plain = ((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122))
    seen = np.concatenate([[0], np.cumsum(plain)])[at]
    out = np.diff(seen) > 0
    for d in np.flatnonzero(~out & (np.diff(at) > 0)):
        out[d] = any(c.isalpha() for c in texts[int(d)].as_py())
    return out


def scored(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (key, text) to (key, lang_pred, score, bits_per_byte)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        for batch in batches:
            for i, data, at in slices(batch.column(1)):
                n = len(at) - 1
                names, score, rate = [UND] * n, np.zeros(n), np.zeros(n)
                if model:
                    x, coded = stream(data, at)
                    cost = bits(model, x, coded)
                    best = cost.argmin(axis=1)
                    rest = np.exp2(np.maximum(cost.min(axis=1, keepdims=True) - cost, -1000)).sum(axis=1)
                    letter = has_letter(batch.column(1).slice(i, n), data, at)
                    names = [model.languages[b] if ok else UND for b, ok in zip(best.tolist(), letter.tolist(), strict=True)]
                    score = np.where(letter, 1 / rest, 0.0)
                    rate = np.where(letter, cost.min(axis=1) / np.maximum(np.diff(coded), 1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.array(names, pa.string()), pa.array(score), pa.array(rate)], names=["key", "lang_pred", "score", "bits_per_byte"])

    return run


def remainder(key: Column, of: int) -> Column:
    """crc32 of the key as text, modulo ``of``."""
    return F.crc32(key.cast("string").cast("binary")) % of


def sample(labelled: DataFrame) -> dict[str, list[str]]:
    """The bounded sample of (doc_id, text, lang) rows: a top-k per language over
    ids alone, and then the texts of those ids."""
    fitting = labelled.where(F.col("lang").isNotNull() & (F.length("text").between(1, LONGEST_SAMPLE)))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ranked = fitting.select("doc_id", "lang", F.length("text").alias("chars")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PER_LANGUAGE)
    upto = F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, 0))
    languages = fitting.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).select("lang")
    chosen = ranked.withColumn("upto", upto).where(F.col("upto") <= SAMPLE_CHARS).join(F.broadcast(languages), "lang", "left_semi").select("doc_id")
    rows = fitting.join(F.broadcast(chosen.distinct()), "doc_id", "left_semi").select("doc_id", "lang", "text")
    out: dict[str, list[str]] = {}
    for lang, _, text in sorted((r.lang, r.doc_id, r.text) for r in rows.collect()):
        out.setdefault(lang, []).append(text)
    return out


def identify(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, bits_per_byte) of every text."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(scored(shared), f"key {kind}, lang_pred string, score double, bits_per_byte double").withColumnRenamed("key", key)


#: A text that every learned language codes worse than this is in none of them.
MOST_BITS = 6.0


def passed(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches with a column ``text`` to those of their rows that are in a learned
    language; without a model every row passes."""
    score = scored(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared.value is None:
                yield batch
                continue
            texts = batch.column(batch.schema.get_field_index("text"))
            found = pa.Table.from_batches(list(score(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), texts], names=["key", "text"])]))))
            known = [name != UND and rate <= MOST_BITS for name, rate in zip(found["lang_pred"].to_pylist(), found["bits_per_byte"].to_pylist(), strict=True)]
            yield batch.filter(pa.array(known, pa.bool_()))

    return run


def in_known_languages(docs: DataFrame) -> DataFrame:
    """``docs`` (text, lang, doc_id and others) without the documents whose text
    has no letter or is in no language that their own labels teach."""
    bounded_batches(docs.sparkSession)
    model = fit(sample(docs.select("doc_id", "text", "lang")))
    return docs.mapInArrow(passed(docs.sparkSession.sparkContext.broadcast(model)), docs.schema)


def trained(docs: DataFrame) -> Model | None:
    """A model from the documents that aren't held out."""
    return fit(sample(docs.select("doc_id", "text", "lang").where(remainder(F.col("doc_id"), 4) != 2)))


def op6_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, trained(docs))
    return found.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_byte")
