"""Files of token ids, compressed by an adaptive context-mixing range coder.

A file set is a table of blocks in ascending document order, each complete in
itself: header, document ids and lengths, coded ids, and a CRC-32 of all of it and
of the ids. A block holds whole documents, together at most BLOCK_TOKENS ids or one
document, and starts from a fresh model.

Within a block the ids are dealt into lanes of about STEPS ids that advance
together; lanes have a range coder each and share one model, which learns from all
of them after every step. The model mixes three distributions of the next id:

    P(x) = w2 * P2(x | last two ids) + w1 * P1(x | last id) + w0 * P0(x).

P2 and P1 hold up to two ids a context with their counts, P0 the adaptive
frequencies of all ids. The weights belong to how much is known in the two contexts;
each is its share of the probability of the ids that came, averaged with decay. An
id is coded in one step by its interval in the mixture, whose parts are whole
numbers in the order of the ids.

A document's ids are those of its whole text and one end id. Null texts count as
empty. Null document ids come last; rows that repeat an id are kept, in the order
of their texts. An empty table gives no block. Other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .shared import bounded_batches, scratch_dir
from .words import CACHED_BYTES, mix, power, slices

END_ID = 0
BLOCK_TOKENS, STEPS = 1 << 20, 128
MAGIC = b"SLT2"
_HEAD = struct.Struct("<4sIIIIII")  # magic, documents, ids, alphabet, words of code, crc of the ids, crc of the rest
_TOP, _BOTTOM, _WORD, _SHIFT = np.uint64(1 << 48), np.uint64(1 << 32), np.uint64(16), np.uint64(48)
#: Bits of the table of pairs, of the frequencies of order 0, and of the mixture.
_PAIRS, _CUM, _TOTAL = 18, 20, 28
#: Steps between renewals of the order-0 frequencies, and what an id adds to its own.
_RENEW, _ADD = 8, 32
#: What the weights keep of a step, and the share that order 0 has at least.
_KEEP, _LEAST = 0.98, 2 / 256
#: Classes of the sum of a context's two counts (15 at most each), and its reciprocal.
_KNOWN = np.array([0, 1, 2, 3, 3, *[4] * 6, *[5] * 20], np.int64)
_CLASSES = 6
_SHARE = np.concatenate([[0.0], 1 / np.arange(1, 31)]).astype(np.float32)


class Model:
    """The mixture for ids under ``size`` (65,536 at most), for all lanes at once. A
    slot of a context is an id times 16 and its count; of a context's two slots the
    first has the greater count."""

    def __init__(self, size: int, lanes: int):
        if size > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        self.size = size
        self.two, self.one = [np.zeros(1 << _PAIRS, np.int32) for _ in range(2)], [np.zeros(size + 1, np.int32) for _ in range(2)]
        known2, known1 = np.divmod(np.arange(_CLASSES**2), _CLASSES)
        self.weight = np.stack([15.0 * (known2 > 0), 15.0 * (known1 > 0), np.full(_CLASSES**2, 50.0)])
        self.frequency = np.ones(size, np.int64)
        self.last = self.before = np.full(lanes, size, np.int32)
        self.step = 0
        self.waiting: list[np.ndarray] = []
        self.every, self.names = np.arange(size + 1, dtype=np.int32), np.arange(size, dtype=np.uint16)
        self.renew()

    def renew(self) -> None:
        """``below[x]``: the frequencies under x, scaled to 2**_CUM, 1 at least each."""
        if self.waiting:
            self.frequency += _ADD * np.bincount(np.concatenate(self.waiting), minlength=self.size)
            self.waiting = []
        below = np.concatenate([[0], np.cumsum(self.frequency)])
        room = (1 << _CUM) - self.size
        self.below = (below * (room / below[-1])).astype(np.int32)
        self.below[-1] = room
        self.below += self.every
        self.places: np.ndarray | None = None

    def predict(self) -> None:
        share = (self.weight * ((1 << _TOTAL) * (1 - _LEAST) / self.weight.sum(axis=0))).astype(np.float32)
        self.pair = (((self.before.view(np.uint32) * np.uint32(40503) + self.last.view(np.uint32)) * np.uint32(2654435761)) >> np.uint32(32 - _PAIRS)).astype(np.intp)
        self.single = self.last.astype(np.intp)
        self.slots = [t.take(self.pair) for t in self.two] + [t.take(self.single) for t in self.one]
        self.counts, self.ids = [s & 15 for s in self.slots], [s >> 4 for s in self.slots]
        n2, n1 = self.counts[0] + self.counts[1], self.counts[2] + self.counts[3]
        self.known = _KNOWN.take(n2) * _CLASSES + _KNOWN.take(n1)
        each2, each1 = share[0].take(self.known) * _SHARE.take(n2), share[1].take(self.known) * _SHARE.take(n1)
        self.mass = [(e * c.astype(np.float32)).astype(np.int32) for e, c in zip((each2, each2, each1, each1), self.counts, strict=True)]
        # what the slots leave, in whole units of order 0's frequencies
        mass = self.mass
        self.rest = (1 << (_TOTAL - _CUM)) - ((mass[0] + mass[1] + mass[2] + mass[3] + ((1 << _CUM) - 1)) >> _CUM)

    def span(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, size) of each lane's id."""
        first = self.below.take(x)
        begin = self.rest * first
        for y, m in zip(self.ids, self.mass, strict=True):
            begin += m * (y < x)
        self.same = [y == x for y in self.ids]
        parts = [m * s for m, s in zip(self.mass, self.same, strict=True)]
        self.parts = (parts[0] + parts[1], parts[2] + parts[3], self.rest * (self.below.take(x + 1) - first))
        self.width = self.parts[0] + self.parts[1] + self.parts[2]
        return begin, self.width

    def find(self, at: np.ndarray) -> np.ndarray:
        """The id in whose interval each place lies: one of the slots', or after the
        slots of smaller ids are taken off, that of order 0."""
        if self.places is None:
            self.places = np.repeat(self.names, np.diff(self.below))
        ids, mass, rest = self.ids, self.mass, self.rest
        under, equal = {}, {}
        for i in range(4):
            for j in range(i + 1, 4):
                under[i, j], under[j, i] = ids[i] < ids[j], ids[j] < ids[i]
                equal[i, j] = equal[j, i] = ids[i] == ids[j]
        passed, found = np.zeros(len(at), np.int32), np.full(len(at), -1, np.int32)
        for j in range(4):
            begin, end = rest * self.below.take(ids[j]), rest * self.below.take(ids[j] + 1)
            for i in range(4):
                if i != j:
                    part = mass[i] * under[i, j]
                    begin += part
                    end += part
                    end += mass[i] * equal[i, j]
            end += mass[j]
            over = end <= at
            passed += mass[j] * over
            np.copyto(found, ids[j], where=(begin <= at) & ~over)
        # both are under 2**53, so the quotient's whole part is exact
        place = ((at - passed) / rest).astype(np.intp)
        return np.where(found < 0, self.places.take(place, mode="clip").astype(np.int32), found)

    def learn(self, x: np.ndarray) -> None:
        one = 1.0 / self.width
        self.weight = self.weight * _KEEP + np.stack([np.bincount(self.known, weights=p * one, minlength=_CLASSES**2) for p in self.parts])
        new = (x << 4) | 1
        for tables, place, k in ((self.two, self.pair, 0), (self.one, self.single, 2)):
            a, b, n, m = self.slots[k], self.slots[k + 1], self.counts[k], self.counts[k + 1]
            hit_a, hit_b = self.same[k] & (n > 0), self.same[k + 1] & (m > 0)
            # a miss weakens the second slot, or takes its place
            second = np.where(hit_b, b + 1, np.where(hit_a, b, np.where(m <= 1, new, b - 1)))
            first = np.where(n == 0, new, np.where(hit_a, a + (n < 15), a))
            second = np.where(n == 0, b, second)
            swap, full = hit_b & (m >= n), hit_b & (m == 15)
            tables[0][place] = np.where(full, b, np.where(swap, second, first))
            tables[1][place] = np.where(full, a - 1, np.where(swap, first, second))
        self.before, self.last = self.last, x
        self.waiting.append(x)
        self.step += 1
        if self.step % _RENEW == 0 or self.step < _RENEW:
            self.renew()


class Coder:
    """What encoder and decoder share: a carry-less range coder a lane, whose low
    end and width are 64 bits and leave in words of 16."""

    def __init__(self, lanes: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, np.iinfo(np.uint64).max, np.uint64)

    def narrow(self, part: np.ndarray, below: np.ndarray, own: np.ndarray) -> None:
        low = self.low + part * below
        width = part * own
        self.low, self.range = low, width
        lane = np.flatnonzero(((low ^ (low + width)) < _TOP) | (width < _BOTTOM))
        while len(lane):
            a, w = low[lane], width[lane]
            settled = (a ^ (a + w)) < _TOP
            w = np.where(settled, w, (~a + np.uint64(1)) & (_BOTTOM - np.uint64(1)))
            self.shift(lane, a)
            a, w = a << _WORD, w << _WORD
            low[lane], width[lane] = a, w
            lane = lane[((a ^ (a + w)) < _TOP) | (w < _BOTTOM)]


class Encoder(Coder):
    def __init__(self, lanes: int, room: int):
        super().__init__(lanes)
        self.out, self.size = np.zeros(lanes * room, np.uint16), np.zeros(lanes, np.int64)  # word by word, lane by lane

    def put(self, begin: np.ndarray, width: np.ndarray) -> None:
        self.narrow(self.range >> np.uint64(_TOTAL), begin.astype(np.uint64), width.astype(np.uint64))

    def shift(self, lane: np.ndarray, low: np.ndarray) -> None:
        size = self.size[lane]
        self.out[size * len(self.low) + lane] = low >> _SHIFT
        self.size[lane] = size + 1

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        """(words of all lanes, number of each lane's)."""
        every = np.arange(len(self.low))
        value = (self.low + (_BOTTOM - np.uint64(1))) & ~(_BOTTOM - np.uint64(1))  # inside, as the width is never less
        for _ in range(2):
            self.shift(every, value)
            value = value << _WORD
        longest = int(self.size.max())
        words = self.out[: longest * len(every)].reshape(longest, -1).T
        return words[np.arange(longest)[None, :] < self.size[:, None]], self.size


class Decoder(Coder):
    def __init__(self, words: np.ndarray, size: np.ndarray):
        super().__init__(len(size))
        longest = int(size.max())
        each = np.zeros((len(size), longest + 3), np.uint16)  # what was left out at the end is zero
        each[np.arange(longest + 3)[None, :] < size[:, None]] = words
        self.words = np.ascontiguousarray(each.T).reshape(-1).astype(np.uint64)
        self.next = np.arange(len(size))
        self.code = np.zeros(len(size), np.uint64)
        for _ in range(4):
            self.code = (self.code << _WORD) | self.words[self.next]
            self.next += len(size)

    def place(self) -> np.ndarray:
        self.part = self.range >> np.uint64(_TOTAL)
        return np.minimum((self.code - self.low) // self.part, np.uint64((1 << _TOTAL) - 1)).astype(np.int32)

    def take(self, begin: np.ndarray, width: np.ndarray) -> None:
        self.narrow(self.part, begin.astype(np.uint64), width.astype(np.uint64))

    def shift(self, lane: np.ndarray, low: np.ndarray) -> None:
        at = self.next[lane]
        self.code[lane] = (self.code[lane] << _WORD) | self.words[at]
        self.next[lane] = at + len(self.low)


def shape(n: int) -> tuple[int, int]:
    """(lanes, steps) of n ids."""
    lanes = -(-n // STEPS)
    return lanes, -(-n // lanes)


def compress(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, number of each lane's) of at least one id under ``size``."""
    lanes, steps = shape(len(ids))
    x = np.zeros(lanes * steps, np.int32)
    x[: len(ids)] = ids
    x = np.ascontiguousarray(x.reshape(lanes, steps).T)
    model, coder = Model(size, lanes), Encoder(lanes, 3 * steps + 8)
    for own in x:
        model.predict()
        coder.put(*model.span(own))
        model.learn(own)
    return coder.finish()


def expand(words: np.ndarray, number: np.ndarray, n: int, size: int) -> np.ndarray:
    """The n ids that ``compress`` was given."""
    lanes, steps = shape(n)
    model, coder = Model(size, lanes), Decoder(words, number)
    out = np.empty((steps, lanes), np.int32)
    for step in range(steps):
        model.predict()
        x = out[step] = model.find(coder.place())
        coder.take(*model.span(x))
        model.learn(x)
    return out.T.reshape(-1)[:n]


def pack(keys: np.ndarray, known: np.ndarray, lengths: np.ndarray, ids: np.ndarray, size: int) -> bytes:
    """A block of documents: ids (``known`` says which aren't null), lengths, tokens."""
    words, number = compress(ids, size)
    body = b"".join(a.tobytes() for a in (keys.astype("<i8"), known.astype(np.uint8), lengths.astype("<u4"), number.astype("<u2"), words.astype("<u2")))
    head = (len(keys), len(ids), size, len(words), zlib.crc32(ids.astype("<u4").tobytes()))
    return _HEAD.pack(MAGIC, *head, zlib.crc32(body, zlib.crc32(struct.pack("<5I", *head)))) + body


def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, known, lengths, ids) of a block; ValueError if it is damaged."""
    if len(block) < _HEAD.size or block[:4] != MAGIC:
        raise ValueError("no block of token ids")
    _, docs, n, size, words, crc_ids, crc = _HEAD.unpack_from(block)
    if zlib.crc32(block[_HEAD.size :], zlib.crc32(struct.pack("<5I", docs, n, size, words, crc_ids))) != crc:
        raise ValueError("a block of token ids is damaged")
    at = _HEAD.size

    def part(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(block, kind, count, at)
        at += out.nbytes
        return out

    keys, known, lengths, number = part("<i8", docs), part("u1", docs), part("<u4", docs), part("<u2", shape(n)[0])
    ids = expand(part("<u2", words), number.astype(np.int64), n, size).astype("<u4")
    if zlib.crc32(ids.tobytes()) != crc_ids:
        raise ValueError("the ids of a block are not those that were written")
    return keys, known.astype(bool), lengths.astype(np.int64), ids


class Units:
    """Encodes texts by their distinct units: stretches between the places where
    pre-tokens always part (before a single space between two characters that are
    no white space). A unit is encoded once while the cache, of at most ``MOST``
    units, holds it."""

    MOST, SLOTS = 600_000, 1 << 21
    #: First bytes of longer characters among which there is white space.
    _DOUBTFUL = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])

    def __init__(self, codec: bpe.Codec):
        self.codec = codec
        self.clear()

    def clear(self) -> None:
        # an open hash table of the units' hashes (0: free) and their rows
        self.keys, self.rows = np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.int32)
        self.count = 0
        self.first, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.flat, self.used = np.zeros(1 << 18, np.int32), 0

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(65 - self.SLOTS.bit_length())).astype(np.intp)

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """The rows of hashes, -1 for those that aren't there."""
        at = self._slot(h)
        key = self.keys.take(at)
        row = np.where(key == h, self.rows.take(at), -1)
        open_ = np.flatnonzero((key != h) & (key != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (self.SLOTS - 1)
            key = self.keys[at[open_]]
            hit = key == h[open_]
            row[open_[hit]] = self.rows[at[open_[hit]]]
            open_ = open_[~hit & (key != 0)]
        return row

    def _insert(self, h: np.ndarray, row: np.ndarray) -> None:
        at = self._slot(h)
        todo = np.arange(len(h))
        while len(todo):
            free = todo[self.keys[at[todo]] == 0]
            self.keys[at[free]] = h[free]
            done = self.keys[at[todo]] == h[todo]  # of several for one place, one has got it
            self.rows[at[todo[done]]] = row[todo[done]]
            todo = todo[~done]
            at[todo] = (at[todo] + 1) & (self.SLOTS - 1)

    def add(self, hashes: np.ndarray, units: list[bytes]) -> None:
        """Encode new units. Those that begin with a space are encoded as one text,
        in which pre-tokens part between them, and its ids are dealt out again."""
        inner = [k for k, u in enumerate(units) if u[0] == 32]
        text = b"".join([units[k] for k in inner])
        ids = self.codec._plain(text)
        ends = np.cumsum(self.codec.size[ids])
        cuts = np.searchsorted(ends, np.cumsum([len(units[k]) for k in inner]), "right") if inner else np.zeros(0, np.int64)
        lengths = np.diff(cuts, prepend=0).tolist()
        other = [k for k, u in enumerate(units) if u[0] != 32]
        alone = [self.codec._plain(units[k]) for k in other]
        ids = np.concatenate([ids, *alone])
        n, at = self.count, self.used
        while n + len(units) > len(self.first):
            self.first, self.length = np.resize(self.first, 2 * len(self.first)), np.resize(self.length, 2 * len(self.length))
        while at + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[at : at + len(ids)] = ids
        size = np.array(lengths + [len(x) for x in alone], np.int64)
        self.length[n : n + len(size)] = size
        self.first[n : n + len(size)] = at + np.cumsum(size) - size
        self.used += len(ids)
        self.count += len(size)
        self._insert(hashes[np.array(inner + other, np.int64)], np.arange(n, n + len(size), dtype=np.int32))

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of a slice's texts one after the other, where each text's begin)."""
        raw = data.tobytes()
        n = len(data)
        if any(mark in raw for mark in self.codec.marks):
            each = [self.codec._plain(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            return np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        doubt = self._DOUBTFUL[data]
        solid = data > 32
        solid &= ~doubt
        solid[1:] &= ~doubt[:-1]
        solid[2:] &= ~doubt[:-2]
        solid &= data != 127
        start = np.zeros(n, bool)
        start[1:-1] = (data[1:-1] == 32) & solid[:-2] & solid[2:]
        start[at[:-1][at[:-1] < n]] = True
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], n)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(_UNIT[data] * power("r", n)[:n], out=total[1:])
        h = mix((total[end] - total[begin]) * power("i", n)[begin]) | np.uint64(1)
        if self.count > self.MOST:
            self.clear()
        where = self.look_up(h)
        missing = np.flatnonzero(where < 0)
        if len(missing):
            keys, sample = np.unique(h[missing], return_index=True)
            for low in range(0, len(keys), self.MOST):  # more than the table holds only if a slice has so many units
                place = missing[sample[low : low + self.MOST]]
                self.add(keys[low : low + self.MOST], [raw[a:b] for a, b in zip(begin[place].tolist(), end[place].tolist(), strict=True)])
            where[missing] = self.look_up(h[missing])
        size = self.length[where]
        stop = np.cumsum(size)
        ids = self.flat[np.repeat(self.first[where] - (stop - size), size) + np.arange(stop[-1])]
        return ids, np.concatenate([[0], stop])[np.searchsorted(begin, at)]


_UNIT = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x7071))
_units: dict[str, Units] = {}


def units_of(path: str) -> Units:
    """The units of a vocabulary that this Python worker has met, over all its tasks."""
    if path not in _units:
        _units[path] = Units(bpe.codec_of(path))
    return _units[path]


def blocks_of(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (key, text), in order, to (part, seq, tokens, block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part, seq = context.partitionId() if context else 0, 0
        units = units_of(path)
        size = len(units.codec.size)
        keys: list[int | None] = []
        held: list[np.ndarray] = []
        count = 0

        def block() -> pa.RecordBatch:
            nonlocal seq, count
            ids = np.concatenate(held)
            known = np.array([k is not None for k in keys])
            body = pack(np.array([k or 0 for k in keys], np.int64), known, np.array([len(x) for x in held]), ids, size)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([count], pa.int64()), pa.array([body], pa.binary())], names=["part", "seq", "tokens", "block"])
            seq, count = seq + 1, 0
            keys.clear()
            held.clear()
            return out

        for batch in batches:
            for i, data, at in slices(batch.column(1), CACHED_BYTES):
                ids, begin = units.encode(data, at)
                for d, key in enumerate(batch.column(0).slice(i, len(at) - 1).to_pylist()):
                    own = np.append(ids[begin[d] : begin[d + 1]], END_ID)
                    if held and count + len(own) > BLOCK_TOKENS:
                        yield block()
                    keys.append(key)
                    held.append(own)
                    count += len(own)
        if held:
            yield block()

    return run


def read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (part, seq, block) to (part, seq, doc_id, offset, n_tokens, ids)."""
    for batch in batches:
        for part, seq, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            keys, known, lengths, ids = unpack(block)
            edge = np.concatenate([[0], np.cumsum(lengths)])
            raw = ids.tobytes()
            n = len(keys)
            off = pa.py_buffer((edge * 4).astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, seq, np.int32)), pa.array(keys.astype(np.int64), mask=~known), pa.array(edge[:-1]), pa.array(lengths), pa.Array.from_buffers(pa.large_binary(), n, [None, off, pa.py_buffer(raw)]).cast(pa.binary())],
                names=["part", "seq", "doc_id", "offset", "n_tokens", "ids"],
            )


def write(docs: DataFrame, path: str, vocabulary: str | None = None) -> None:
    """Write the documents' ids to a file set: Parquet rows (part, seq, tokens,
    block), whose order by part and seq is that of the documents' ids."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), F.col("text"))
    order = [F.col("key").asc_nulls_last(), F.col("text").asc_nulls_first()]
    rows = rows.repartitionByRange(F.col("key").asc_nulls_last()).sortWithinPartitions(*order)
    rows.mapInArrow(blocks_of(vocabulary or bpe.vocabulary_path()), "part int, seq int, tokens long, block binary").write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(part, seq, doc_id, offset, n_tokens, ids) of every document of a file set;
    ids are little-endian unsigned 32-bit integers."""
    blocks = spark.read.schema("part int, seq int, tokens long, block binary").parquet(path)
    return blocks.select("part", "seq", "block").mapInArrow(read_blocks, "part int, seq int, doc_id long, offset long, n_tokens long, ids binary")


def starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, seq, before): the ids of all blocks before each."""
    blocks = spark.read.schema("part int, seq int, tokens long, block binary").parquet(path).select("part", "seq", "tokens")
    parts = blocks.groupBy(F.col("part").alias("p")).agg(F.sum("tokens").alias("all"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("p", F.coalesce(F.sum("all").over(earlier(Window.orderBy("p"))), F.lit(0)).alias("parts_before"))
    within = blocks.withColumn("blocks_before", F.coalesce(F.sum("tokens").over(earlier(Window.partitionBy("part").orderBy("seq"))), F.lit(0)))
    return within.join(parts, F.col("part") == F.col("p")).select("part", "seq", (F.col("parts_before") + F.col("blocks_before")).alias("before"))


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = f"{scratch_dir(spark)}/siftline-tokens-{uuid.uuid4().hex}"
    write(docs, path, vocabulary)
    found = read(spark, path).select("part", "seq", "doc_id", "offset", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return found.join(starts(spark, path), ["part", "seq"]).select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def op5_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
