"""Canonical exact digests of texts, with DataFrame and SQL functions only.

The canonical form of a text is its compatibility composition (NFKC), case-folded
and composed again, with every run of white space as one space and none at the
ends. Canonical texts are grouped by two 64-bit xxhash values under different
seeds. Inside equal buckets of documents the canonical bytes are compared, edited
texts by the SHA-256 of theirs; where a bucket holds different contents, a number
after the hash tells them apart. So two fingerprints are equal exactly if the
canonical texts are. A fingerprint says nothing of partly equal texts: likeness is
1 for equal fingerprints, else 0.

Null texts count as empty. A null doc_id comes after all others. Rows that repeat
a doc_id each get a result; where the next id has several texts, the next document
is the one with the smallest hash. A single document follows itself; an empty
table gives an empty one. Other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import numbered, scratch

SEEDS = (20_011, 70_001)
#: Stands for a null doc_id in the order.
LAST = (1 << 63) - 1


def normalised(text: Column) -> Column:
    """NFKC, through the ICU library that Spark has on its class path."""
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))


def folded(text: Column) -> Column:
    return F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), text, F.lit(True))


def canonical(text: Column) -> Column:
    plain = normalised(folded(normalised(F.coalesce(text, F.lit("")))))
    return F.trim(F.regexp_replace(plain, r"(?U)\s{2,}|[^\S ]", " "))


def wide(canon: Column) -> Column:
    """128 bits of xxhash."""
    return F.struct(*(F.xxhash64(F.lit(seed), canon).alias(f"h{k}") for k, seed in enumerate(SEEDS)))


def shown(hash128: Column) -> Column:
    return F.lower(F.concat(*(F.lpad(F.hex(hash128[f"h{k}"]), 16, "0") for k in range(len(SEEDS)))))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next) of every row."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    first = scratch(
        rows.withColumn("canon", canonical(F.col("text"))).select("k", F.length("text").alias("n"), wide(F.col("canon")).alias("hash"), F.unhex(F.sha2(F.col("canon").cast("binary"), 256)).alias("content")),
        "hashes",
    )
    following = scratch(order(first), "order")

    near = rows.join(following.select(F.col("next_k").alias("k"), F.col("k").alias("before"), "half", "several"), "k")
    rank = F.when(F.col("several"), wide(canonical(F.col("text")))).otherwise(F.struct(*(F.lit(0).cast("long").alias(f"h{k}") for k in range(len(SEEDS)))))
    heads = near.select("before", F.struct(rank.alias("rank"), F.substring("text", F.lit(1), F.col("half")).alias("head")).alias("own")).groupBy("before").agg(F.min("own").alias("own")).select("before", "own.head")
    whole = rows.join(following, "k").join(heads, F.col("k") == F.col("before"))
    cut = whole.withColumn("n", F.length("text")).withColumn("own", F.floor(F.col("n") / 2).cast("int"))
    edited = cut.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n") - F.col("own")), F.substring("head", F.lit(1), F.col("own"))))
    canon = edited.withColumn("canon", canonical(F.col("text"))).withColumn("edited_canon", canonical(F.col("edited")))
    digests = scratch(
        canon.select(
            F.when(F.col("k") != LAST, F.col("k")).alias("doc_id"),
            F.col("n").cast("long").alias("n_chars"),
            F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
            wide(F.col("canon")).alias("hash"),
            F.unhex(F.sha2(F.col("canon").cast("binary"), 256)).alias("content"),
            wide(F.col("edited_canon")).alias("edited_hash"),
            F.unhex(F.sha2(F.col("edited_canon").cast("binary"), 256)).alias("edited_content"),
            "next_hash",
            "next_content",
            F.when(F.col("shared"), F.col("canon")).alias("bytes"),
        ),
        "digests",
    )
    return told_apart(digests).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        like("edited_hash", "edited_content").alias("near_edited"),
        like("next_hash", "next_content").alias("near_next"),
    )


def like(hash128: str, content: str) -> Column:
    return ((F.col("hash") == F.col(hash128)) & (F.col("content") == F.col(content))).cast("double")


def order(first: DataFrame) -> DataFrame:
    """For each key: the next key with its hash and content, half the key's
    longest text, whether the next key has several rows, and whether the key's hash is
    in a bucket with others."""
    bucket = first.groupBy("hash").agg(F.count("*").alias("size")).where("size > 1").select("hash")
    shared = first.join(bucket, "hash", "left_semi").select("k").distinct().withColumn("shared", F.lit(True))
    keys = first.groupBy("k").agg(F.max("n").alias("n"), F.min(F.struct("hash", "content")).alias("own"), (F.count("*") > 1).alias("several")).select("k", F.floor(F.col("n") / 2).cast("int").alias("half"), "own", "several")
    at = scratch(numbered(keys, ["k"]), "numbered")
    total = at.agg(F.count("*").alias("total"))
    after = at.select(F.col("idx").alias("next_idx"), F.col("k").alias("next_k"), F.col("own.hash").alias("next_hash"), F.col("own.content").alias("next_content"), F.col("several").alias("next_several"))
    here = at.crossJoin(F.broadcast(total)).withColumn("next_idx", (F.col("idx") + 1) % F.col("total"))
    return here.join(after, "next_idx").join(shared, "k", "left").select("k", "half", "next_k", "next_hash", "next_content", F.col("next_several").alias("several"), F.coalesce("shared", F.lit(False)).alias("shared"))


def told_apart(digests: DataFrame) -> DataFrame:
    """``digests`` with the fingerprints; a number follows where one bucket holds
    several contents."""
    by_bytes = digests.where("bytes is not null").groupBy("hash").agg(F.min("bytes").alias("x"), F.max("bytes").alias("y")).where("x <> y").select("hash")
    contents = digests.select("hash", "content").union(digests.select("edited_hash", "edited_content"))
    by_content = contents.groupBy("hash").agg(F.min("content").alias("x"), F.max("content").alias("y")).where("x <> y").select("hash")
    clashes = scratch(by_bytes.union(by_content).distinct(), "clashes")
    plain = digests.withColumn("fingerprint", shown(F.col("hash"))).withColumn("edited_fingerprint", shown(F.col("edited_hash")))
    if clashes.isEmpty():
        return plain
    number = F.dense_rank().over(Window.partitionBy("hash").orderBy("content"))
    told = contents.join(clashes, "hash", "left_semi").distinct().withColumn("number", number)
    own = told.select(F.col("hash").alias("a"), F.col("content").alias("b"), F.col("number").alias("own_number"))
    other = told.select(F.col("hash").alias("c"), F.col("content").alias("d"), F.col("number").alias("edited_number"))
    wide_rows = plain.join(own, (F.col("hash") == F.col("a")) & (F.col("content") == F.col("b")), "left").join(other, (F.col("edited_hash") == F.col("c")) & (F.col("edited_content") == F.col("d")), "left")
    numbered_print = lambda name, n: F.concat_ws("-", name, n)
    return wide_rows.withColumn("fingerprint", numbered_print("fingerprint", "own_number")).withColumn("edited_fingerprint", numbered_print("edited_fingerprint", "edited_number"))


def op10_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
