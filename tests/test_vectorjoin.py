"""The two-sided similarity join against all pairs."""

import numpy as np

from siftline.operators import vectorjoin
from siftline.plans.registered import QUERIES, SQL

from .oracle import compare


def clustered(rng, many, width, centres):
    x = rng.normal(size=(centres, width))[rng.integers(0, centres, many)]
    return x + rng.normal(size=(many, width)) * rng.choice([0.05, 0.2, 0.5], (many, 1))


def plain(left, right, least):
    out = {}
    for q, x in left:
        best, n = None, 0
        for v, y in right:
            if x is None or y is None or len(x) != 12 or len(y) != 12 or any(c is None or not np.isfinite(c) for c in x + y) or not any(x) or not any(y):
                continue
            cos = float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y))
            if cos >= least:
                n += 1
                best = min(best or (9, 0), (-round(cos, 9), v))
        out[q] = (n, best and best[1])
    return out


def test_links_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(4)
    points = clustered(rng, 900, 12, 9)
    points[600:700] = points[600]  # copies
    points[700:800] = points[700] + rng.normal(size=(100, 12)) * 0.01  # a dense group
    rows = [(i, x.tolist()) for i, x in enumerate(points)]
    odd = [None, [], [0.0] * 12, [float("nan")] * 12, [1.0, None] + [0.0] * 10, [1.0, 2.0]]
    left = rows[:400] + rows[550:850] + [(2000 + i, x) for i, x in enumerate(odd)]
    right = rows[200:] + [(3000 + i, x) for i, x in enumerate(odd)]
    as_table = lambda x, key: spark.createDataFrame(x, f"{key} long, embedding array<double>")
    got = vectorjoin.links(as_table(left, "query_id"), as_table(right, "vec_id"), block=32)
    found = {r.query_id: (r.n_links, r.vec_id) for r in got.collect()}
    assert found == plain(left, right, 0.85) and len(found) == len(left)
    assert 0 < got.compared < got.pairs / 2  # clusters let windows fall out
    for a, b in ((left, []), ([], right), (left, [(1, None)])):
        some = vectorjoin.links(as_table(a, "query_id"), as_table(b, "vec_id")).collect()
        assert len(some) == len(a) and all(r.n_links == 0 and r.vec_id is None for r in some)


def test_query_equals_its_sql_at_the_next_size(spark):
    assert not compare(spark, QUERIES["semantic_links"], SQL["semantic_links"], "/root/testdata/sf0.01")


def test_vectors_are_sent_to_groups_of_windows(spark, monkeypatch):
    """Vectors without structure meet all windows, but aren't copied to each."""
    frame, rng = type(spark.range(0)), np.random.default_rng(8)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(600, 12)))]
    table = lambda key: spark.createDataFrame(rows, f"{key} long, embedding array<double>")
    sent, grouped = [], frame.groupBy
    monkeypatch.setattr(frame, "groupBy", lambda df, *c: (sent.append(df) if [x for x in c if isinstance(x, str)] in (["g", "s"], ["g", "r", "s"]) else None) or grouped(df, *c))
    got = vectorjoin.links(table("query_id"), table("vec_id"), block=8)
    assert {r.query_id: (r.n_links, r.vec_id) for r in got.collect()} == plain(rows, rows, 0.85)
    assert len(sent) == 2 and got.compared > got.pairs / 6 and all(df.count() <= 12 * 600 for df in sent)
