"""Queries of stored indexes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.operators import bm25index, vectorindex, vectorjoin
from siftline.plans.queries import BM25, NEAR, RANKED, query, read
from siftline.sources import tables


@query(f"""WITH {NEAR.format(q='(SELECT * FROM embeddings WHERE vec_id % 20 = 0)')}
SELECT query_id, vec_id, round(dist, 5) AS dist, round(cosine, 5) AS cosine, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 6), vec_id) AS INTEGER) AS rank FROM near) WHERE rank <= 10""")
def vector_index_topk(spark, sf_dir):
    """The exact search of an index of all vectors, for those whose id 20 divides."""
    vectors, path = read(spark, sf_dir, "embeddings"), tables.new_folder(spark, "vectors")
    try:
        vectorindex.build(vectors, path)
        asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
        found = vectorindex.search(spark, path, asked, exact=True)
        return tables.written(found.select("query_id", "vec_id", F.round("dist", 5).alias("dist"), F.round("cosine", 5).alias("cosine"), "rank"), "hits")
    finally:
        tables.delete(spark, path)


@query(f"WITH {BM25} SELECT item_id, doc_id, score, rank FROM (SELECT *, CAST({RANKED} AS INTEGER) AS rank FROM bm) WHERE rank <= 10")
def bm25_index_topk(spark, sf_dir):
    """The search of a stored index of all documents, which was made of the English
    ones and has taken the others since."""
    docs, items = read(spark, sf_dir, "documents", "benchmark")
    path = tables.new_folder(spark, "postings")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    try:
        bm25index.add(docs.where(english), path)
        bm25index.add(docs.where(~english), path)
        return tables.written(bm25index.search(path, items), "hits")
    finally:
        tables.delete(spark, path)


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.v, b.v), 9) AS c FROM e a, e b WHERE list_cosine_similarity(a.v, b.v) >= 0.85)
SELECT query_id, count(*) AS n_links, arg_min(vec_id, {'c': -c, 'v': vec_id}) AS vec_id, round(max(c), 5) AS cosine FROM p GROUP BY query_id""")
def semantic_links(spark, sf_dir):
    """All vectors against all, each with itself among its links."""
    vectors = read(spark, sf_dir, "embeddings")
    found = vectorjoin.links(vectors.select(F.col("vec_id").alias("query_id"), "embedding"), vectors)
    try:
        return tables.written(found.withColumn("cosine", F.round("cosine", 5)), "links")
    finally:
        tables.delete(spark, *found.paths)
