"""Byte-level BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last 16 bytes cuts texts where their content says so:
texts that share a passage share its chunks, wherever the passage stands. A
worker encodes each chunk once while it stays in a cache of bounded bytes, and
then repairs the joins between chunks. A join needs no repair where the cut is
one at which pre-tokens always part (a single space between two other
characters, before the space); otherwise the text around the join is encoded
again between the nearest such places on both sides, and the stretch grows until
both chunks' token borders agree with its own. The ids are those of encoding the
whole text at once, whatever the cache holds.

Null texts count as empty and give no ids. Texts are encoded whole; a special
token's string becomes the special id, as with the tokenizers library. Columns of
the input other than the key and the text are ignored, whatever their names.
Repeated rows give repeated results; an empty table gives an empty one.
"""

from __future__ import annotations

import json
import re
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches
from .words import LOWER, mix, slices

VOCABULARY = "byte_bpe_50k.json"
#: The pre-tokens of byte-level BPE, as the tokenizers library has them built in.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Mean bytes of a chunk, a power of two, and the bytes within which a cut moves to a place where pre-tokens part.
CHUNK_BYTES, SNAP_BYTES = 512, 128
#: A chunk is at most so long.
LONGEST = 16 * CHUNK_BYTES
CACHE_BYTES = 48 << 20

_GEAR = mix(np.arange(256, dtype=np.uint64) + np.uint64(0xC0FFEE)).astype(np.uint32)
_PARTS = re.compile(rb"[^\x00-\x20\x80-\xff](?= [^\x00-\x20\x80-\xff])")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of() -> dict[str, int]:
    """The printable character that byte-level BPE writes for each byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Codec:
    """Encoder and decoder of one vocabulary file of the tokenizers library."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte_of = _byte_of()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.special = special
        self.engine = tiktoken.Encoding("chunks", pat_str=PRE_TOKENS, mergeable_ranks=vocab, special_tokens=special)
        table = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in vocab.items():
            table[i] = token
        for token, i in special.items():
            table[i] = token.encode()
        self.size = np.array([len(t) for t in table], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.flat = np.frombuffer(b"".join(table), np.uint8)
        self.marks = [s.encode() for s in special]
        self.cache: OrderedDict[bytes, np.ndarray] = OrderedDict()
        self.room = self.cache_bytes = cache_bytes

    def _plain(self, text: bytes) -> np.ndarray:
        return self.engine.encode_to_numpy(text.decode(), allowed_special="all").astype(np.int32)

    def _chunk(self, chunk: bytes) -> np.ndarray:
        ids = self.cache.get(chunk)
        if ids is None:
            ids = self.cache[chunk] = self._plain(chunk)
            self.room -= len(chunk) + 4 * len(ids) + 200
            while self.room < 0:
                old, gone = self.cache.popitem(last=False)
                self.room += len(old) + 4 * len(gone) + 200
        return ids

    def encode(self, text: bytes, cuts: list[int]) -> np.ndarray:
        """Ids of a UTF-8 text that ``cuts`` divide into chunks."""
        if any(mark in text for mark in self.marks):  # a special string may lie across a cut
            return self._plain(text)
        out: list[np.ndarray] = []
        begin = 0
        for cut, end in zip(cuts, [*cuts[1:], len(text)], strict=False):
            if cut - begin < 2:
                continue
            if _parts(text, cut):
                out.append(self._chunk(text[begin:cut]))
                begin = cut
            else:
                stretch = self._repaired(text, begin, cut, end)
                if stretch is not None:
                    ids, begin = stretch
                    out.append(ids)
        if begin < len(text):
            out.append(self._chunk(text[begin:]))
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def _repaired(self, text: bytes, begin: int, cut: int, end: int) -> tuple[np.ndarray, int] | None:
        """Ids from ``begin`` up to a place after ``cut`` where the encodings on
        both sides of the join agree with that of the stretch over it, and the
        place; None if there is no such place (the chunks are then one)."""
        right = _PARTS.search(text, cut, end)
        if not right:
            return None
        b = right.end()
        left = [begin + m.end() for m in _PARTS.finditer(text[begin:cut])]
        a = left[-1] if left else begin
        whole = self._chunk(text[begin:cut])
        borders = np.concatenate([[0], np.cumsum(self.size[whole])]) + begin
        k = int(np.searchsorted(borders, a))
        if borders[k] != a:
            return None
        return np.concatenate([whole[:k], self._chunk(text[a:b])]), b

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all tokens, one after the other."""
        size = self.size[ids]
        total = int(size.sum())
        shift = np.repeat(self.first[ids] - (np.cumsum(size) - size), size)
        return self.flat[shift + np.arange(total)].tobytes()


_codecs: dict[str, Codec] = {}


def codec_of(path: str) -> Codec:
    """The codec of a vocabulary and its cache, one for all tasks of a Python worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _parts(text: bytes, cut: int) -> bool:
    """Whether pre-tokens always part before ``cut``: a single space of ASCII
    text stands there, between bytes that are neither white space nor part of a
    longer character (of which some are white space)."""
    return 0 < cut < len(text) - 1 and text[cut] == 32 and 32 < text[cut - 1] < 128 and 32 < text[cut + 1] < 128


def cut_places(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cuts of all texts of a slice, as ascending byte positions."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    h = _GEAR[LOWER[data]]
    for step in (1, 2, 4, 8):  # after them h covers 16 bytes
        h[step:] += h[:-step] << np.uint32(step)
    hit = np.flatnonzero((h >> np.uint32(32 - (CHUNK_BYTES - 1).bit_length())) == 0)
    doc = np.searchsorted(at, hit, "right") - 1
    hit = hit[hit - at[doc] >= 16]
    bounds = np.unique(np.concatenate([hit, np.arange(0, n, LONGEST)[1:]]))
    plain = (data > 32) & (data < 128)
    safe = np.zeros(n, bool)
    safe[1:-1] = (data[1:-1] == 32) & plain[:-2] & plain[2:]
    place = np.flatnonzero(safe)
    if len(place):
        k = np.minimum(np.searchsorted(place, bounds), len(place) - 1)
        near = (place[k] >= bounds) & (place[k] < bounds + SNAP_BYTES)
        bounds = np.where(near, place[k], bounds)
    inside = (data[bounds] & 0xC0) == 0x80
    while inside.any():  # not within a character
        bounds = bounds - inside
        inside = (data[bounds] & 0xC0) == 0x80
    return np.unique(bounds)


def encoded(path: str, decode: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (key, text) to (key, ids[, decoded])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for batch in batches:
            for i, data, at in slices(batch.column(1)):
                cuts, raw = cut_places(data, at), data.tobytes()
                edge = np.searchsorted(cuts, at, "right")
                ids = [codec.encode(raw[at[d] : at[d + 1]], [c for c in (cuts[edge[d] : edge[d + 1]] - at[d]).tolist() if c < at[d + 1] - at[d]]) for d in range(len(at) - 1)]
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                off = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                columns = [batch.column(0).slice(i, len(ids)), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))]
                if decode:
                    columns.append(decoded(codec, flat, off))
                yield pa.RecordBatch.from_arrays(columns, names=["key", "ids", "decoded"][: len(columns)])

    return run


def decoded(codec: Codec, flat: np.ndarray, off: np.ndarray) -> pa.Array:
    """The texts of lists of ids; bytes that are no UTF-8 become U+FFFD."""
    raw = codec.decode(flat)
    ends = np.concatenate([[0], np.cumsum(codec.size[flat])])[off]
    try:
        raw.decode()
        if not any((raw[e] & 0xC0) == 0x80 for e in ends[:-1].tolist() if e < len(raw)):
            return pa.Array.from_buffers(pa.string(), len(off) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(raw)])
    except UnicodeDecodeError:
        pass
    return pa.array([raw[a:b].decode(errors="replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string())


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, decode: bool = False) -> DataFrame:
    """(key, ids array<int>[, decoded string]) of every text."""
    bounded_batches(docs.sparkSession)
    path = vocabulary or vocabulary_path()
    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(encoded(path, decode), f"key {kind}, ids array<int>" + ", decoded string" * decode)
    return out.withColumnRenamed("key", key)


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    out = encode(docs, vocabulary=vocabulary, decode=True)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
