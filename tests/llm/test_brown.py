import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from siftline.llm import brown


def toks(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 10 == 0


def check_base(rows, got):
    count = Counter()
    for d, t in rows:
        if not held(d):
            count.update([*toks(t), None])
    n, v = sum(count.values()), len(count)
    for r, (d, t) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id)), sorted(rows, key=lambda r: (r[0] is None, r[0])), strict=True):
        tokens = [*toks(t), None]
        base = sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens)
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (d, held(d), len(tokens), sum(count[x] > 0 for x in tokens), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("hot", [200, 131_072])
def test_query_against_plain_counts(spark, monkeypatch, hot):
    monkeypatch.setattr(brown, "HOT_WORDS", hot)
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pydict()
    got = brown.op8_brown(spark, "/root/testdata/sf0.001").collect()
    check_base(list(zip(table["doc_id"], table["text"])), got)
    assert all(r.score < 0 for r in got)
    if hot > 200:  # the classes say more than the words alone, on what they haven't seen too
        tokens = sum(r.n_tokens for r in got if r.held_out)
        assert sum(r.score for r in got if r.held_out) / tokens > sum(r.base_score for r in got if r.held_out) / tokens


def likelihood(pairs, own):
    k = own.max() + 1
    m = np.zeros((len(pairs), k))
    m[np.arange(len(pairs)), own] = 1
    t = m.T @ pairs @ m
    f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    return f(t) - f(t.sum(0)) - f(t.sum(1))


def test_exchange_finds_classes_and_never_loses_likelihood(monkeypatch):
    monkeypatch.setattr(brown, "CLASS_WORDS", 30)
    rng = np.random.default_rng(0)
    true = np.arange(30) % 3
    pairs = np.array([[rng.poisson(40 if (true[x] + 1) % 3 == true[y] else 1) for y in range(30)] for x in range(30)])
    start = np.arange(30) % 4
    own = brown.exchange(pairs, classes=4, rounds=8)
    assert likelihood(pairs, own) >= likelihood(pairs, start)
    shuffled = rng.permutation(30)
    own = brown.exchange(pairs[np.ix_(shuffled, shuffled)], classes=3, rounds=20)
    assert all(len(set(own[true[shuffled] == c])) == 1 for c in range(3))
    history = [likelihood(pairs, brown.exchange(pairs, classes=5, rounds=r)) for r in range(5)]
    assert all(b >= a - 1e-6 for a, b in zip(history, history[1:]))


def test_gains_are_those_of_the_likelihood():
    rng = np.random.default_rng(5)
    k, classes = 6, 4  # the last word leaves the last class, which holds the one before it too
    pairs = rng.integers(0, 20, (10, 10))
    pairs[8:, 8:] = 0
    own = np.array([0, 1, 2, 3, 0, 1, 2, 4, 5, 5])
    m = np.eye(k)[own]
    around = np.concatenate([m.T @ pairs[:, 9], m.T @ pairs[9]])
    got = brown.gains(m.T @ pairs @ m, np.zeros(2 * k, int), np.arange(2 * k), around, classes)[0]
    want = np.array([likelihood(pairs, np.append(own[:9], c)) for c in range(classes)])
    assert np.allclose(got - got[0], want - want[0])


def test_words_beyond_the_most_frequent_get_the_class_of_their_context(spark):
    rng = np.random.default_rng(3)
    share = 1 / np.arange(20, 1620)
    draw = lambda: rng.choice(1600, 60, p=share / share.sum())
    rows = [(i, " ".join(f"a{x} b{y}" for x, y in zip(draw(), draw()))) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("text")
    counts = docs.mapInArrow(brown.counted, "word long, n long").groupBy("word").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")
    hot, _ = brown.hot_words(counts)
    pairs = np.zeros(2 * brown.ALPHABET**2, np.int64)
    found = docs.selectExpr("text", "0L AS half").mapInArrow(brown.paired(spark.sparkContext.broadcast(hot)), "pair long, n long").groupBy("pair").agg({"n": "sum"}).toArrow()
    pairs[found.column(0).to_numpy()] = found.column(1).to_numpy()
    own, _ = brown.all_classed(docs, hot, pairs.reshape(2, brown.ALPHABET, -1)[0])
    name = next(w for _, w in brown.words(pa.array([" ".join(f"a{x}" for x in range(1600))])))
    a = np.isin(np.arange(len(hot.count)), hot.table.find(name.hash))
    assert len(hot.count) > brown.CLASS_WORDS + 300 and own.letter.max() < brown.CLASSES
    tail = np.arange(len(a)) >= brown.CLASS_WORDS
    of = [set(own.letter[~tail & side].tolist()) for side in (a, ~a)]
    right = np.array([x in of[0] if s else x in of[1] for x, s in zip(own.letter[tail].tolist(), a[tail])])
    assert right.mean() > 0.95 and not of[0] & of[1]


def test_transitions_and_emissions_sum_to_one():
    from siftline.llm.ppm import Table

    rng = np.random.default_rng(2)
    count = np.sort(rng.integers(5, 900, 1000))[::-1]
    letter = np.minimum(np.arange(1000), brown.CLASS_WORDS + 3)
    hot = brown.Hot(Table(np.arange(1, 1001, dtype=np.uint64), np.zeros((1000, 1))), count, letter)
    m = brown.fit(hot, rng.integers(0, 3, (2, brown.ALPHABET, brown.ALPHABET)), 7)
    assert np.allclose((10**m.step).sum(axis=1), 1)
    own = m.kind[letter]
    assert all(math.isclose((10 ** m.emit[own == c]).sum(), 1) for c in set(own.tolist()))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "A a\tb"), (3, "A a\tb"), (4, "x " * 60000), (None, "b c")]
    docs = spark.createDataFrame([(*r, 5, "z") for r in rows], "doc_id long, text string, n int, word string")
    check_base(rows, brown.scores(docs).collect())
    assert brown.scores(docs.limit(0)).count() == 0
    only = next(x for x in range(1000) if held(x))
    check_base([(only, "a b")], brown.scores(docs.limit(0).union(spark.createDataFrame([(only, "a b", 1, "z")], docs.schema))).collect())


def test_scores_against_plain_counts_of_classes(spark):
    """Everything but the choice of classes, by dictionaries over the words."""
    from pyspark.sql import functions as F

    table = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pydict()
    rows = list(zip(table["doc_id"], table["text"]))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = brown.learn(docs.select("doc_id", (brown.remainder(F.col("doc_id"), 10) == 0).alias("held_out"), "text"), 10).model
    count = Counter(x for d, t in rows if not held(d) for x in toks(t))
    vocabulary = sorted(count)
    hashes = next(w for _, w in brown.words(pa.array([" ".join(vocabulary)]))).hash
    found = model.hot.table.find(hashes)
    rare = "rare"
    own = {w: (int(model.hot.letter[r]) if r >= 0 else rare) for w, r in zip(vocabulary, found.tolist())}
    assert all((own[w] == rare) == (count[w] == 1) for w in vocabulary)  # few enough words to hold all others

    def classes(text):
        return ["end", *(own.get(w, rare) for w in toks(text)), "end"]

    halves = [Counter(), Counter()]
    for d, t in rows:
        if not held(d):
            c = classes(t)
            halves[zlib.crc32(str(d).encode()) % 20 // 10].update(zip(c, c[1:]))
    names = [*range(brown.CLASSES), "end", rare]
    matrix = [np.array([[h[a, b] for b in names] for a in names], float) for h in halves]
    share = lambda m: (m.sum(0) + 0.5) / (m.sum() + 0.5 * len(m))
    smooth = lambda m, w: (m + w * share(m)) / (m.sum(1, keepdims=True) + w)
    weight = max((10.0**e for e in range(10)), key=lambda w: (matrix[1] * np.log(smooth(matrix[0], w))).sum())
    step = smooth(matrix[0] + matrix[1], weight)
    at = {c: k for k, c in enumerate(names)}
    total = Counter()
    for w, n in count.items():
        total[own[w]] += n
    rare_words = sum(c == rare for c in own.values())
    got = {r.doc_id: r.score for r in brown.op8_brown(spark, "/root/testdata/sf0.001").collect()}
    for d, t in rows:
        c, want = classes(t), 0.0
        for a, b in zip(c, c[1:]):
            want += math.log10(step[at[a], at[b]])
        for w in toks(t):
            if own.get(w, rare) == rare:
                want += math.log10((count[w] + 0.1) / (total[rare] + 0.1 * (rare_words + 1)))
            else:
                want += math.log10(count[w] / total[own[w]])
        assert math.isclose(got[d], want, rel_tol=1e-9)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_classes_say_more_of_held_out_documents_than_words_alone(spark, sf):
    got = [r for r in brown.op8_brown(spark, f"/root/testdata/{sf}").collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
