"""The research plan: retrieve, rerank, classify, validate, reconcile and cite, for a
table of questions at once. Model calls are columns that the caller supplies (here
labels); nothing is decided row by row on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import lexical_overlap
from siftline.operators import evidence, retrieve, rules


def sub_tasks(tasks: DataFrame) -> DataFrame:
    """(item_id, priority, sub_query) of tasks (item_id, text): the three that a plan
    falls back on."""
    parts = F.array(*(F.struct(F.lit(k).alias("priority"), F.concat("text", F.lit(s)).alias("sub_query")) for k, s in enumerate(("", " market", " data"), 1)))
    return tasks.select("item_id", F.inline(parts))


def materials(docs: DataFrame, tasks: DataFrame, labels: DataFrame, k: int = 5) -> DataFrame:
    """(item_id, doc_id, rerank_rank, rerank_score, relevance, validation_score, text):
    each task's hits after rerank by label, with the class of the task's best hit, and
    those that share words with it."""
    hits = retrieve.bm25_topk(docs, tasks, 2 * k).join(labels, "doc_id", "left").withColumn("label", F.coalesce("label", F.lit("partly")))
    ranked = rules.reranked(hits.select("item_id", "doc_id", "rank", "label"), k=k)
    best = ranked.groupBy("item_id").agg(F.max("rerank_score").alias("best")).select("item_id", rules.relevance(F.col("best")).alias("relevance"))
    full = ranked.join(best, "item_id").join(docs.select("doc_id", "text"), "doc_id").join(tasks.select("item_id", F.col("text").alias("task")), "item_id")
    score = F.round(lexical_overlap(F.col("text"), F.col("task")), 6)
    return full.withColumn("validation_score", score).where((F.length(F.trim("text")) >= 15) & (F.col("validation_score") >= 0.1)).select("item_id", "doc_id", "rerank_rank", "rerank_score", "relevance", "validation_score", "text")


def research(docs: DataFrame, tasks: DataFrame, labels: DataFrame) -> DataFrame:
    """(item_id, next_stage, n_materials, relevance, n_numbers, unsupported): where
    each task goes from here, and how many numbers of its materials no other material
    of all tasks supports."""
    found = materials(docs, tasks, labels)
    own = found.select(F.col("doc_id").alias("id"), "text").dropDuplicates(["id"])
    numbers = evidence.report_numbers(own)
    checked = evidence.supported(numbers, docs.select(F.col("doc_id").alias("ord"), "text"))
    by_doc = numbers.join(checked, "number").groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("n_numbers"), F.count_if(F.col("confidence") <= 0.5).alias("unsupported"))
    counted = found.join(by_doc, "doc_id", "left").groupBy("item_id").agg(F.count("*").alias("n_materials"), F.first("relevance").alias("relevance"), F.coalesce(F.sum("n_numbers"), F.lit(0)).alias("n_numbers"), F.coalesce(F.sum("unsupported"), F.lit(0)).alias("unsupported"))
    every = tasks.select("item_id").join(counted, "item_id", "left")
    none = lambda kind: F.lit(None).cast(kind)
    control = every.withColumns({
        "error_message": none("string"), "terminate_reason": none("string"), "mode": F.lit("auto"), "breaker": none("boolean"), "timeout": none("boolean"), "plan_retries": F.lit(2),
        "materials": F.col("n_materials").isNotNull(), "effective": F.coalesce("n_materials", F.lit(0)),
    })
    return control.select("item_id", rules.route("analyse").alias("next_stage"), F.col("effective").alias("n_materials"), F.coalesce("relevance", F.lit("irrelevant")).alias("relevance"), F.coalesce("n_numbers", F.lit(0)).cast("long").alias("n_numbers"), F.coalesce("unsupported", F.lit(0)).cast("long").alias("unsupported"))
