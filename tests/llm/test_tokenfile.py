import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from siftline.llm import bpe, tokenfile

from .test_bpe import ODD


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 1000, 70_000])
def test_round_trip_of_ids(n):
    rng = np.random.default_rng(n)
    for size, ids in [(50257, rng.zipf(1.3, n) % 50257), (50257, np.full(n, 50256)), (2, rng.integers(0, 2, n)), (300, np.arange(n) % 300), (50257, rng.integers(0, 50257, n))]:
        words, number = tokenfile.compress(ids, size)
        assert (tokenfile.expand(words, number, n, size) == ids).all()


def bits(ids, size=50257):
    """Bits an id, lengths of the lanes included."""
    words, number = tokenfile.compress(ids, size)
    return 16 * (len(words) + len(number)) / len(ids)


def entropy(ids):
    p = np.bincount(ids)
    p = p[p > 0] / len(ids)
    return -(p * np.log2(p)).sum()


def test_contexts_code_real_ids_in_less_than_their_entropy():
    units = tokenfile.Units(bpe.Codec(bpe.vocabulary_path()))
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet").column("text").combine_chunks().slice(0, 2000)
    ids = np.concatenate([units.encode(data, at)[0] for _, data, at in tokenfile.slices(texts)])[: 1 << 20]
    assert len(ids) > 900_000 and bits(ids) < entropy(ids) - 0.4


def test_it_compresses_what_can_be_foreseen():
    rng = np.random.default_rng(1)
    text = rng.zipf(1.4, 200_000) % 50257
    assert bits(text) < entropy(text) + 1  # nothing but frequencies to learn
    assert bits(np.tile(text[:3000], 60)) < 5
    after = rng.integers(0, 300, 300)
    chain = [0]
    for noise in rng.random(200_000).tolist():  # half follows the last id, half doesn't
        chain.append(int(after[chain[-1]]) if noise < 0.5 else int(noise * 1e6) % 300)
    assert bits(np.array(chain), 300) < entropy(np.array(chain)) - 1.5


def test_damage_is_seen():
    block = tokenfile.pack(np.arange(3), np.ones(3), np.array([2, 0, 5]), np.arange(7), 100)
    keys, known, lengths, ids = tokenfile.unpack(block)
    assert (keys.tolist(), known.tolist(), lengths.tolist(), ids.tolist()) == ([0, 1, 2], [True] * 3, [2, 0, 5], list(range(7)))
    for k in (0, 5, 20, 30, len(block) - 1):
        bad = bytearray(block)
        bad[k] ^= 4
        with pytest.raises(ValueError):
            tokenfile.unpack(bytes(bad))
    with pytest.raises(ValueError):
        tokenfile.unpack(block[:10])


def test_units_give_the_librarys_ids():
    library = Tokenizer.from_file(bpe.vocabulary_path())
    units = tokenfile.Units(bpe.Codec(bpe.vocabulary_path()))
    texts = ODD[:5] + ODD[7:] + pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    for group in (texts, ODD):
        for i, data, at in tokenfile.slices(pa.array(group, pa.string())):
            ids, begin = units.encode(data, at)
            for d in range(len(at) - 1):
                assert ids[begin[d] : begin[d + 1]].tolist() == library.encode(group[i + d] or "", add_special_tokens=False).ids


def test_a_worker_keeps_its_codec_and_units():
    path = bpe.vocabulary_path()
    assert bpe.codec_of(path) is bpe.codec_of(path) is tokenfile.units_of(path).codec
    codec = bpe.codec_of(path)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words that two tasks share " * 40] * 2)], names=["key", "text"])
    run = bpe.encoded(path, False)
    list(run(iter([batch])))
    held = {k: id(v) for k, v in codec.cache.items()}
    list(run(iter([batch])))
    assert held and {k: id(codec.cache[k]) for k in held} == held  # the second task encoded nothing again


def check(rows, got):
    library = Tokenizer.from_file(bpe.vocabulary_path())
    start, want = 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_query(spark, monkeypatch):
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pydict()
    check(list(zip(table["doc_id"], table["text"])), tokenfile.op5_tokenfile(spark, "/root/testdata/sf0.001").collect())


def test_odd_rows(spark):
    rows = [(5, "b a"), (5, "a b"), (-3, None), (None, "z"), (7, ""), (9, "x y " * 30000), (9, "x y " * 30000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, key int")
    check(rows, tokenfile.round_trip(docs).collect())
    assert tokenfile.round_trip(docs.limit(0)).count() == 0
