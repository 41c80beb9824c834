import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftline.operators import bm25index, retrieve, vectorindex
from siftline.plans.registered import QUERIES, SQL
from siftline.sources import tables

from .oracle import compare

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet")


@pytest.fixture(scope="module")
def index(spark, vectors):
    path = tables.new_folder(spark, "index")
    vectorindex.build(vectors, path, lists=16)
    yield path
    tables.delete(spark, path)
    assert not tables.exists(spark, path)


def test_recall_of_the_vector_index(spark, vectors, index):
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    want = {(r.query_id, r.vec_id) for r in retrieve.nearest(vectors, asked).collect()}
    shares = []
    for probes in (1, 4, 12):
        got = {(r.query_id, r.vec_id) for r in vectorindex.search(spark, index, asked, probes=probes).collect()}
        shares.append(len(got & want) / len(want))
    assert len(want) == 1000 and shares == sorted(shares) and shares[-1] >= 0.9, shares
    assert {(r.query_id, r.vec_id) for r in vectorindex.search(spark, index, asked, probes=2, exact=True).collect()} == want


def test_a_search_reads_only_the_probed_lists(spark, vectors, index):
    one = vectors.where("vec_id = 40").select(F.col("vec_id").alias("query_id"), "embedding")
    found = vectorindex.search(spark, index, one, probes=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    model = vectorindex.model_of(spark, index)
    q = np.array(one.first().embedding, float)
    wanted = np.argsort(((model.centres - q) ** 2).sum(axis=1))[:2]
    assert set(re.findall(r"IN \(([\d,]+)\)", filters)[0].split(",")) == {str(x) for x in wanted}
    assert found.first().vec_id == 40 and found.first().dist == 0


def test_added_vectors_and_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, list string, code int"
    rows = [(i, [float(i % 7), float(i % 5), 1.0], "x", 1) for i in range(100)]
    odd = [(200, None, "x", 1), (201, [], "x", 1), (202, [1.0, None, 1.0], "x", 1), (203, [float("nan"), 0.0, 0.0], "x", 1), (204, [1.0, 2.0], "x", 1), (None, [0.0, 0.0, 9.0], "x", 1)]
    path = tables.new_folder(spark, "index")
    vectorindex.build(spark.createDataFrame(rows[:60] + odd, schema), path, lists=5)
    vectorindex.add(spark.createDataFrame(rows[60:], schema), path)
    asked = spark.createDataFrame([(1, [3.0, 2.0, 1.0]), (2, [1.0]), (3, None), (4, [0.0, 0.0, 9.5])], "query_id long, embedding array<float>")
    got = vectorindex.search(spark, path, asked, 5, probes=1, exact=True).collect()
    want = retrieve.nearest(spark.createDataFrame(rows, schema), asked.where("size(embedding) = 3"), 5).collect()
    key = lambda r: (r.query_id, r.rank, r.vec_id, round(r.dist, 9), round(r.cosine, 9))
    assert sorted(map(str, map(key, got))) == sorted(map(str, map(key, want)))
    empty = tables.new_folder(spark, "index")
    vectorindex.build(spark.createDataFrame([], schema), empty)
    assert vectorindex.search(spark, empty, asked).collect() == []


def test_blocks_pack_and_unpack():
    rng = np.random.default_rng(8)
    doc = rng.integers(0, 900, 20_000)
    term = np.minimum(rng.geometric(0.02, 20_000), 300)
    length = np.bincount(doc, minlength=1000)
    own = bm25index.blocks("s", pa.array([f"t{i}" for i in range(301)]), doc, term, length).to_pylist()
    want = {}
    for t, d in zip(term.tolist(), doc.tolist()):
        want[f"t{t}", d] = want.get((f"t{t}", d), 0) + 1
    shard = bm25index.Shard(length.astype(float), 20.0)
    for r in own:
        shard.terms.setdefault(r["term"], []).append(tuple(r[c] for c in ("n", "first", "last", "max_tf", "min_dl", "gap_bits", "tf_bits", "data")))
    got = {}
    for t, rows in shard.terms.items():
        for k, b in enumerate(rows):
            docs, part = shard.block(t, k)
            assert len(docs) == b[0] <= bm25index.BLOCK and docs[0] == b[1] and docs[-1] == b[2] and b[4] == length[docs].min()
            tf = np.round(part * shard.norm[docs] / (2.5 - part)).astype(int)  # from its part of the score
            assert tf.max() == b[3]
            got |= {(t, d): n for d, n in zip(docs.tolist(), tf.tolist())}
    assert got == want
    assert sum(len(r["data"]) for r in own) < 3 * len(want)


def test_bm25_index_skips_blocks_and_takes_new_documents(spark, monkeypatch):
    rng = random.Random(9)
    common = [f"c{i}" for i in range(30)]
    text = lambda i: " ".join(rng.choices(common, k=rng.randint(3, 60)) + (["rare"] * rng.randint(1, 9) if i % 1000 < 20 else []))
    docs = [(i * 3 % 7001, text(i)) for i in range(7000)] + [(9000, None), (9001, ""), (None, "rare c1"), (5, "rare rare c2")]
    items = [(1, "rare c1 c2"), (2, "c3 c3 c4 nowhere"), (3, "nowhere"), (4, None), (5, "rare c0 c1 c2 c3 c4 c5 c6 c7")]
    schema = "doc_id long, text string, rank int"
    frame = lambda rows: spark.createDataFrame([(*r, 1) for r in rows], schema).coalesce(2)
    asked = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(bm25index, "SHARD_DOCS", 1500)
    path = tables.new_folder(spark, "postings")
    bm25index.add(frame(docs[:4000]), path)
    bm25index.add(frame(docs[4000:]), path)
    rows = lambda df: sorted((r.item_id, r["rank"], r.score, str(r.doc_id)) for r in df.collect())
    known = lambda df: df.where("doc_id is not null")
    assert rows(known(bm25index.search(path, asked, 10))) == rows(retrieve.bm25_topk(frame(docs).where("doc_id is not null or text is not null").fillna(10**9, ["doc_id"]), asked, 10))
    seen = bm25index.search(path, asked.where("item_id = 1"), 10, report=True).agg(F.sum("blocks"), F.sum("opened")).first()
    assert 0 < seen[1] < 0.6 * seen[0]
    tables.delete(spark, path)


def test_an_empty_bm25_index(spark):
    path = tables.new_folder(spark, "postings")
    bm25index.add(spark.createDataFrame([(1, None)], "doc_id long, text string"), path)
    assert bm25index.search(path, spark.createDataFrame([(1, "a b"), (2, "word")], "item_id long, text string")).collect() == []
    assert bm25index.search(path, spark.createDataFrame([(1, None)], "item_id long, text string")).collect() == []


@pytest.mark.parametrize("name", ["vector_index_topk", "bm25_index_topk"])
def test_against_sql_at_a_larger_size(spark, name):
    assert not compare(spark, QUERIES[name], SQL[name], SF)
