import math

import pyarrow as pa
import pyarrow.parquet as pq

from siftline.llm import ppm
from siftline.llm.words import slices


def brute(samples, text):
    """Bits of a text by walking each language's tree, a byte at a time."""
    def coded(t):
        out = bytearray()
        for b in t.encode():
            c = int(ppm._CODED[b])
            if not (c == 32 and out and out[-1] == 32):
                out.append(c)
        return bytes(out)

    trees = {}
    for lang, texts in samples.items():
        tree = {}
        for t in texts:
            x = b" " * ppm.ORDER + coded(t)
            for i in range(ppm.ORDER, len(x)):
                for o in range(ppm.ORDER + 1):
                    seen = tree.setdefault(x[i - o : i], {})
                    seen[x[i]] = seen.get(x[i], 0) + 1
        trees[lang] = tree
    out = {}
    for lang, tree in trees.items():
        x, total = b" " * ppm.ORDER + coded(text), 0.0
        for i in range(ppm.ORDER, len(x)):
            for o in range(ppm.ORDER, -1, -1):
                seen = tree.get(x[i - o : i])
                if seen is None:
                    continue
                n, d = sum(seen.values()), len(seen)
                if x[i] in seen:
                    total -= math.log2(seen[x[i]] / (n + d))
                    break
                total -= math.log2(d / (n + d))
            else:
                total += 8
        out[lang] = total
    return out


SAMPLES = {"en": ["The cat sat on the mat, and the dog ran.", "then there was a thing"], "fr": ["Le chat est très content de l'été.", "où est la maison"]}


def test_code_lengths_against_a_walk():
    model = ppm.fit(SAMPLES)
    for text in ["the cat", "où est le chat ???  12", "zzzz", "", "日本語", "é" * 50]:
        for _, data, at in slices(pa.array([text])):
            got = ppm.bits(model, *ppm.stream(data, at))[0]
        want = brute(SAMPLES, text)
        for lang, value in zip(model.languages, got, strict=True):
            assert math.isclose(value, want[lang], rel_tol=1e-4, abs_tol=1e-3)


def test_held_out_accuracy(spark):
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pandas()
    got = {r.doc_id: r for r in ppm.op6_ppm(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(table)
    held = [(got[d].lang_pred, lang) for d, lang in zip(table.doc_id, table.lang) if got[d].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_odd_rows(spark):
    rows = [(1, None, "en", 0), (2, "", "en", 0), (3, "123 !!", "fr", 0), (4, "éé", None, 0), (4, "éé", None, 0), (5, "the cat sat there", "en", 0), (6, "le chat est là " * 9000, "fr", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, key int")
    got = [(r.doc_id, r.lang_pred) for r in ppm.identify(docs, ppm.fit(SAMPLES)).collect()]
    assert sorted(got) == [(1, "und"), (2, "und"), (3, "und"), (4, "fr"), (4, "fr"), (5, "en"), (6, "fr")]
    empty = docs.limit(0)
    assert ppm.identify(empty, ppm.trained(empty)).count() == 0
    assert {r.lang_pred for r in ppm.identify(docs, None).collect()} == {"und"}


def test_no_id_and_ties(spark, monkeypatch):
    text = "the same words in both of the languages"
    rows = [(k, text, lang) for k, lang in enumerate(["b", "a"] * 20)] + [(None, text, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(ppm, "PER_LANGUAGE", 3)
    model = ppm.trained(docs)
    found = ppm.identify(docs.limit(1), model).first()
    assert found.lang_pred == "a" and abs(found.score - 0.5) < 0.2  # the first by name
    path = "/root/testdata/sf0.001"
    monkeypatch.setattr(ppm, "MOST_LANGUAGES", 1)
    assert set(ppm.sample(docs)) == {"a"} or set(ppm.sample(docs)) == {"b"}
    monkeypatch.setattr(ppm, "SAMPLE_CHARS", len(text) * 2)
    assert [len(v) for v in ppm.sample(docs).values()] == [2]
    assert not any(r.held_out is None for r in ppm.op6_ppm(spark, path).collect())
