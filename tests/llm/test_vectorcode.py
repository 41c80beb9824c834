import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException

from siftline.llm import vectorcode
from tests.oracle import compare

SCHEMA = "vec_id long, label int, embedding array<float>, code int, whole string"


def brute(rows, entries=64, rounds=2):
    ok = [(d, label, [math.floor(256 * float(np.float32(x))) for x in v]) for d, label, v in rows if v and len(v) % 16 == 0 and all(x is not None and math.isfinite(x) for x in v)]
    ok.sort(key=lambda r: (r[0] is None, r[0], r[2]))
    ok = [r for r in ok if len(r[2]) == len(ok[0][2])]
    if not ok:
        return []
    width = len(ok[0][2]) // 16
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[part(v, p) for _, _, v in ok[:entries]] for p in range(16)]
    near = lambda p, v: min((sum((x - y) ** 2 for x, y in zip(part(v, p), e)), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        own = [[near(p, v)[1] for p in range(16)] for _, _, v in ok]
        for p in range(16):
            for i in range(len(books[p])):
                mine = [part(v, p) for (_, _, v), o in zip(ok, own) if o[p] == i]
                if mine:
                    books[p][i] = [sum(c) // len(mine) for c in zip(*mine)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    done = []
    for d, label, v in ok:
        best = [near(p, v) for p in range(16)]
        done.append((d, label, "".join(f"{i:02x}" for _, i in best), sum(e for e, _ in best)))
    return [(d, c, e, sum(x[3] for x in done if x[1] == label), digest) for d, label, c, e in done]


def run(spark, rows, **how):
    docs = spark.createDataFrame([(d, label, v, 1, "x") for d, label, v in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, vectorcode.codes(docs, **how).collect()), key=str)


def test_tree_finds_the_nearest_entry_with_the_lowest_index():
    rng = np.random.default_rng(4)
    for many, spread in ((1, 5), (5, 3), (64, 2), (64, 6), (64, 300), (200, 4)):
        book = rng.integers(-spread, spread + 1, (many, 3))  # with equal entries and many ties
        points = rng.integers(-spread - 2, spread + 3, (800, 3))
        square = ((points[:, None] - book[None]) ** 2).sum(axis=2)
        index, least = vectorcode.nearest(vectorcode.tree(book), book, points)
        assert (index == square.argmin(axis=1)).all() and (least == square.min(axis=1)).all()


def test_against_plain_rounds(spark):
    rng = random.Random(6)
    rows = [(i * 7 % 101, rng.choice([0, 1, None]), [rng.gauss(0, 0.3) for _ in range(32)]) for i in range(101)]
    rows += [(i, 2, [rng.choice([-0.5, 0.0, 0.25]) for _ in range(32)]) for i in range(200, 260)]
    assert run(spark, rows) == sorted(brute(rows), key=str)
    assert run(spark, rows[:10]) == sorted(brute(rows[:10]), key=str)
    assert run(spark, rows, entries=5, rounds=3) == sorted(brute(rows, 5, 3), key=str)


def test_odd_rows(spark):
    v = [0.1] * 16
    rows = [(5, 1, v), (5, 1, v), (5, None, [-0.1] * 16), (None, None, [0.3] * 16), (1, 1, None), (2, 1, []), (3, 1, [None] * 16), (4, 1, [float("nan")] * 16), (6, 1, [float("inf")] * 16), (7, 1, [0.1] * 17), (8, 2, [0.1] * 32)]
    assert run(spark, rows) == sorted(brute(rows), key=str)
    assert run(spark, []) == [] and run(spark, [(1, 1, None)]) == []
    with pytest.raises(PySparkException):
        run(spark, [(1, 1, [1e30] * 16)])


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_query_against_sql(spark, sf):
    assert not compare(spark, vectorcode.op13_codes, vectorcode.SQL_OP13, f"/root/testdata/sf{sf}")
