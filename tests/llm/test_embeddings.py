import math
from collections import Counter

import numpy as np
import pytest

from siftline.llm import embeddings
from tests.oracle import compare

SCHEMA = "vec_id long, label int, embedding array<float>, n int, low string"


def brute(rows, least=0.93):
    """[(id, links, smallest reachable id)] of every row, by comparing all pairs."""
    good = [v is not None and len(v) > 0 and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, label, v in rows]
    near = [[] for _ in rows]
    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if g else None for (_, _, v), g in zip(rows, good)]
    for i in range(len(rows)):
        for j in range(i):
            if good[i] and good[j] and rows[i][1] == rows[j][1] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                near[i].append(j), near[j].append(i)
    out = []
    for i, (d, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for k in near[todo.pop()]:
                if k not in seen:
                    seen.add(k), todo.append(k)
        out.append((d, len(near[i]), min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)))
    return out


def run(spark, rows):
    got = embeddings.near_vectors(spark.createDataFrame([(d, label, v, 1, "x") for d, label, v in rows], SCHEMA)).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)  # also of nulls
    return Counter((r.vec_id, r.n_links, r.component_id) for r in got)


def test_pairs_about_the_threshold(spark, monkeypatch):
    """Uniform vectors, each with partners at a cosine from 0.9 to 0.96, in many small lists and blocks."""
    monkeypatch.setattr(embeddings, "LIST_SIZE", 40)
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(1)
    rows = []
    for label in (0, 1):
        for _ in range(500):
            x = rng.normal(size=32)
            x /= np.linalg.norm(x)
            rows.append(x)
            for c in rng.uniform(0.9, 0.96, rng.integers(0, 3)):
                y = rng.normal(size=32)
                y -= (y @ x) * x
                rows.append(c * x + math.sqrt(1 - c * c) * y / np.linalg.norm(y))
    rows = [(int(d), i % 2, (v * rng.uniform(0.1, 9)).tolist()) for i, (d, v) in enumerate(zip(rng.permutation(len(rows)) * 3, rows))]
    rows = [(d, k if rng.random() < 0.1 else 0, v) for d, k, v in rows]
    want, got = Counter(brute(rows)), run(spark, rows)
    links = lambda c: sum(k[1] * n for k, n in c.items())
    assert links(want) > 500 and 0.99 * links(want) <= links(got) <= links(want)


def test_dense_group_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 32)
    monkeypatch.setattr(embeddings, "LIST_SIZE", 64)
    rng = np.random.default_rng(2)
    base = rng.normal(size=64)
    group = [base + rng.normal(size=64) * 0.15 for _ in range(200)] + [base] * 50
    rows = [(i, 5, v.tolist()) for i, v in enumerate(group + [rng.normal(size=64) for _ in range(150)])]
    assert run(spark, rows) == Counter(brute(rows))


def test_odd_rows(spark):
    a, b = [1.0, 0.0, 0.0], [0.99, 0.1, 0.0]
    rows = [(1, 1, a), (1, 1, b), (2, 1, a), (3, None, a), (4, None, a), (5, 1, None), (6, 1, []), (7, 1, [0.0, 0.0, 0.0]), (8, 1, [1.0, None, 0.0]), (9, 1, [float("nan"), 0.0, 0.0]), (10, 1, [float("inf"), 0.0, 0.0]), (11, 1, [1.0, 0.0]), (12, 2, a), (None, 1, [-1.0, 0.0, 0.0]), (None, 2, a), (13, 1, [3e38, 1e37, 0.0]), (14, 1, [1e-44, 0.0, 0.0])]
    assert run(spark, rows) == Counter(brute(rows))
    assert embeddings.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    nothing = [(1, 1, None), (None, 1, [])]
    assert sorted(map(tuple, embeddings.near_vectors(spark.createDataFrame([(*r, 1, "x") for r in nothing], SCHEMA)).collect()), key=str) == [(1, 0, 1, True), (None, 0, None, True)]
    assert embeddings.near_vectors(spark.createDataFrame([(1, 1, None, 1, "x")], SCHEMA)).first() == (1, 0, 1, True)


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_query_against_sql(spark, sf):
    assert not compare(spark, embeddings.op12_vectors, embeddings.SQL_OP12, f"/root/testdata/sf{sf}")
