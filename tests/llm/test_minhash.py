import random
import re

import pyarrow.parquet as pq

from siftline.llm import minhash


def sets(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent=80):
    """{doc_id: (set size, smallest reachable id)} by comparing every pair."""
    own = {d: sets(t, k) for d, t in rows}
    root = {d: d for d in own}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(own)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = own[a], own[b]
            if x and y and 10 * min(len(x), len(y)) >= 8 * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: (len(own[d]), find(d)) for d in ids}


def same(got, want):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_query_against_all_pairs(spark):
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    want = brute(list(zip(table["doc_id"], table["text"])), 2)
    assert any(v[1] != d for d, v in want.items())
    same(minhash.op3_minhash(spark, "/root/testdata/sf0.01").collect(), want)


def test_chains_odd_texts_and_hostile_middles(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0

    def add(text):
        nonlocal n
        rows.append((n, text))
        n += 1

    base = [rng.choice(vocabulary) for _ in range(60)]
    for _ in range(80):  # a random walk of small edits, about the threshold
        for _ in range(rng.randint(1, 4)):
            base[rng.randrange(60)] = rng.choice(vocabulary)
        add(" ".join(base))
    centre = [rng.choice(vocabulary) for _ in range(50)]
    for _ in range(60):  # every copy differs from every other by about the threshold
        own = list(centre)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(50)] = rng.choice(vocabulary)
        add(" ".join(own))
    for text in [None, "", "  \n", "one", "ONE", "one two", "One\tTwo", "two one", "x " * 5000, "x " * 7000, "É é", "é é"]:
        add(text)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for k in (2, 5):
        same(minhash.near_duplicates(docs, k).collect(), brute(rows, k))


def test_tiles_find_every_pair(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 5)
    monkeypatch.setattr(minhash, "CLUSTER_TILE", 4)
    rng = random.Random(8)
    centre = [f"w{rng.randrange(90)}" for _ in range(40)]
    rows = []
    for d in range(70):
        own = list(centre)
        for _ in range(rng.randint(0, 7)):
            own[rng.randrange(40)] = f"w{rng.randrange(90)}"
        rows.append((d, " ".join(own)))
    same(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect(), brute(rows, 2))


def test_nulls_repeats_and_clashing_names(spark):
    rows = [(1, "a b c d", "x", 1), (1, "a b c d", "x", 1), (2, "A b c d", "x", 2), (None, "a b c d", "x", 3), (3, None, "x", 4), (4, "", "y", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, label int")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, 2).collect())
    assert got == [(0, 3, None, True), (1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 0, 3, True), (4, 0, 4, True)]
    kept = minhash.deduplicated(docs, 2)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "3", "4", "None"]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_estimates_are_corrected_for_chance(spark):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    rows, want = [], {}
    for d in range(40):
        a = [rng.randrange(10**9) for _ in range(600)]
        share = rng.randint(100, 600)
        b = a[:share] + [rng.randrange(10**9) for _ in range(600 - share)]
        x, y = " ".join(map(str, a)), " ".join(map(str, b))
        rows += [(2 * d, x), (2 * d + 1, y)]
        want[2 * d] = len(sets(x, 2) & sets(y, 2)) / len(sets(x, 2) | sets(y, 2))
    s = minhash.sketches(spark.createDataFrame(rows, "doc_id long, text string"), 2).select("doc_id", "packed")
    pairs = s.alias("x").join(s.alias("y"), (F.col("x.doc_id") % 2 == 0) & (F.col("y.doc_id") == F.col("x.doc_id") + 1))
    got = pairs.select(F.col("x.doc_id"), minhash.likeness(F.col("x.packed"), F.col("y.packed")).alias("j")).collect()
    errors = [r.j - want[r.doc_id] for r in got]
    assert abs(sum(errors) / len(errors)) < 0.02 and max(map(abs, errors)) < minhash.MARGIN


def test_what_dense_groups_write_grows_with_their_documents(spark, monkeypatch):
    """Near copies of one text, linked all over, in many partitions."""
    rng = random.Random(9)
    centre = [f"w{rng.randrange(5000)}" for _ in range(120)]

    def copies(n):
        rows = []
        for d in range(n):
            own = list(centre)
            for _ in range(rng.randint(0, 9)):
                own[rng.randrange(120)] = f"v{rng.randrange(10**6)}"
            rows.append((d, " ".join(own)))
        return spark.createDataFrame(rows, "doc_id long, text string").repartition(16)

    written, plain = {}, minhash.scratch

    def counted(df, name):
        out = plain(df, name)
        written[name] = written.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(minhash, "scratch", counted)
    seen = []
    for n in (200, 800):
        written.clear()
        minhash.near_duplicates(copies(n), 2).count()
        seen.append(dict(written))
    few, many = seen
    for name in ("pairs", "edges", "links", "clusters"):
        assert many.get(name, 0) <= 6 * max(few.get(name, 0), 200), (name, seen)
