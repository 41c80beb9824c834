import hashlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from siftline.llm import bpe

ODD = [None, "", " ", "a", "  two  spaces ", "it's we'll they're", "x <|endoftext|> y<|endoftext|>", "日本語のテキスト" * 400, " a b 　c" * 300, "a" * 40000, "\n\n\n  x" * 3000, "é' l'été 's 'll " * 900, "🙂👍🏽 " * 900, "12 345  67.8" * 700, "don'" + "t" * 9000, "x\r\n\ty" * 2000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.vocabulary_path())


def run(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["key", "text"])
    return pa.Table.from_batches(list(bpe.encoded(bpe.vocabulary_path(), True)(iter([batch])))).to_pydict()


def test_ids_and_texts_are_the_librarys(library):
    import pyarrow.parquet as pq

    texts = ODD + pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    got = run(texts)
    for text, ids, back in zip(texts, got["ids"], got["decoded"], strict=True):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ids == want
        assert back == library.decode(want, skip_special_tokens=False)


def test_random_texts_with_cuts_anywhere(library):
    rng = np.random.default_rng(1)
    codec = bpe.Codec(bpe.vocabulary_path())
    letters = list("ab '’stl1.\n\t é日 ") + [" "] * 6
    for _ in range(400):
        text = "".join(rng.choice(letters, rng.integers(1, 80)))
        raw = text.encode()
        cuts = sorted({int(c) for c in rng.integers(1, len(raw) + 1, 4) if c < len(raw) and raw[c] & 0xC0 != 0x80})
        assert codec.encode(raw, cuts).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_small_cache_changes_nothing(library):
    codec = bpe.Codec(bpe.vocabulary_path(), cache_bytes=10)
    text = ("some shared passage of words, and more " * 60).encode()
    assert codec.encode(text, list(range(40, len(text), 97))).tolist() == library.encode(text.decode(), add_special_tokens=False).ids


def test_invalid_bytes_decode_as_the_library_does(library):
    codec = bpe.Codec(bpe.vocabulary_path())
    ids = [x for x in range(120, 250)]
    got = bpe.decoded(codec, np.array(ids, np.int32), np.array([0, len(ids)], np.int32)).to_pylist()
    assert got == [library.decode(ids, skip_special_tokens=False)]


def test_query(spark, library):
    rows = [(7, "one two", 1, "k"), (7, "one two", 1, "k"), (8, None, 2, "ids")]
    got = bpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string, ids int, key string")).collect()
    ids = library.encode("one two", add_special_tokens=False).ids
    want = (7, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(b"one two").hexdigest())
    none = hashlib.sha256(b"").hexdigest()
    assert sorted(map(tuple, got)) == [want, want, (8, 0, none, none)]
    assert bpe.round_trip(spark.createDataFrame([], "doc_id long, text string")).count() == 0
