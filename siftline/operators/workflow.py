"""Steps of the research workflow around its operators: where documents come from,
what stands in for a model's answer, rounds of searching, and what leaves as text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.prompts import joined
from siftline.operators import lookup, order, validation, web
from siftline.operators.rules import search_mode, web_query

# The outline of a task whose plan can't be read; {task} is the task.
FALLBACK_OUTLINE = (
    '[{"level": 1, "title": "概述", "main_argument": {task}, "supporting_evidence": [], "subsections": []}, '
    '{"level": 1, "title": "核心分析", "main_argument": "深入分析", "supporting_evidence": [], "subsections": '
    '[{"level": 2, "title": "关键发现", "argument": "主要发现", "evidence_indices": [], "paragraph_plan": "列举关键发现并引用证据"}]}, '
    '{"level": 1, "title": "结论与建议", "main_argument": "总结与建议", "supporting_evidence": [], "subsections": []}]'
)
# Rounds of a second search, and hits of each of its searches.
SECOND_ROUNDS, SECOND_HITS = 2, 3


def ingestion(mode: Column, parsed: Column, indexed: Column, path: Column, cached: Column) -> Column:
    """Where a task's chunks come from: ``none`` (a mode without documents, or no
    document), ``state`` (parsed and indexed before), ``index`` (parsed before, to be
    indexed), ``kept`` (indexed before), ``cache`` or ``parse``."""
    on = lambda c: F.coalesce(c, F.lit(False))
    out = F.when(search_mode(mode) == "web_only", "none").when(on(parsed) & on(indexed), "state").when(on(parsed), "index").when(on(indexed), "kept")
    return out.when(F.coalesce(path, F.lit("")) == "", "none").when(on(cached), "cache").otherwise("parse")


def outline(answer: Column, task: Column) -> Column:
    """The sections of a model's outline (JSON text), or the outline to fall back on."""
    sections = F.get_json_object(answer, "$.sections")
    about = F.to_json(F.struct(F.concat(F.lit("关于'"), task, F.lit("'的总体分析")).alias("t")))
    quoted = F.substring(about, F.lit(6), F.length(about) - 6)
    return F.coalesce(sections, F.replace(F.lit(FALLBACK_OUTLINE), F.lit("{task}"), quoted))


def stream_finished(chunk: Column) -> Column:
    """Whether a piece of a model's stream (JSON text) is its last, in any of the
    providers' formats."""
    said = lambda path: F.get_json_object(chunk, path)
    given = lambda path: said(path).isNotNull()
    return (
        given("$.choices[0].finish_reason") | F.coalesce(said("$.type") == "message_stop", F.lit(False)) | F.coalesce(said("$.done") == "true", F.lit(False))
        | given("$.usage_metadata") | given("$.response_metadata.finish_reason") | F.coalesce(said("$.response_metadata.done") == "true", F.lit(False))
    )


def by_label(items: DataFrame) -> DataFrame:
    """(label, first, place, value) of items (ord, label, value): each label's values
    with their places in it from 1 (by ord, then value), and the label's first ord, by
    which labels are ordered. Null labels are one label. One row an item: a label
    of a third of the items is dealt over as many tasks. The result's ``path`` is for
    the caller to delete."""
    rows = order.numbered(items.select("label", "ord", "value"), "label", "ord", "value")
    begins = rows.groupBy("label").agg(F.min("ord").alias("first"), F.min("number").alias("begin")).withColumnRenamed("label", "own")
    out = rows.join(begins, F.col("label").eqNullSafe(F.col("own"))).select("label", "first", (F.col("number") - F.col("begin") + 1).alias("place"), "value")
    out.path = rows.path
    return out


def source_of(quantities: DataFrame, materials: DataFrame, prefix: int = 20) -> DataFrame:
    """(id, ord) for quantities (id, raw): the first material (ord, text) that contains
    the first characters of the raw match; null if none does, and for null or empty
    matches. Keys and materials may both be large (``lookup.first_holders``)."""
    rows = quantities.select("id", F.substring("raw", 1, prefix).alias("key"))
    return rows.join(lookup.first_holders(rows, materials, prefix), "key", "left").select("id", "ord")


def effective(materials: DataFrame) -> DataFrame:
    """(task_id, effective): the materials (task_id, text) that aren't blank."""
    return materials.groupBy("task_id").agg(F.count_if(F.trim(F.coalesce("text", F.lit(""))) != "").alias("effective"))


def searched_again(
    tasks: DataFrame, sub_tasks: DataFrame, materials: DataFrame, search: Callable[[DataFrame], DataFrame], trusted: list[str], low: list[str], rounds: int = SECOND_ROUNDS
) -> DataFrame:
    """``materials`` (task_id, ord, text, url) with what further searches found.

    In each round the tasks (task_id, mode) that the web is open to, that have fewer
    than two materials and a missing sub-topic search for the first two of those.
    ``search`` maps (task_id, query) to (task_id, pos, url, content). Hits of low
    quality and those whose url a task has are left out; the others follow its
    materials. Rounds end when no task asks; the loop runs over tables."""
    for _ in range(rounds):
        enough = materials.groupBy("task_id").agg(F.count("*").alias("passed"))
        open_tasks = tasks.where(search_mode(F.col("mode")) != "pdf_only").join(enough, "task_id", "left").where(F.coalesce("passed", F.lit(0)) < 2).select("task_id")
        missing = validation.missing_topics(sub_tasks.join(open_tasks, "task_id", "left_semi"), materials)
        if missing.isEmpty():
            break
        asked = missing.select("task_id", web_query(F.col("sub_query"), F.lit(2), F.lit(True)).alias("query"))
        hits = search(asked).where(F.col("pos") < SECOND_HITS)
        new = web.unseen(hits, materials.select("task_id", "url"))
        found = web.results(new.withColumn("round", F.lit(1)), trusted, low)
        last = materials.groupBy("task_id").agg(F.max("ord").alias("last"))
        more = found.join(last, "task_id", "left").select("task_id", (F.coalesce("last", F.lit(-1)) + F.col("place")).cast("long").alias("ord"), "text", F.col("source_url").alias("url"))
        materials = materials.select("task_id", "ord", "text", "url").unionByName(more)
    return materials


def report_text(sections: DataFrame, titles: DataFrame, default: str = "分析报告") -> DataFrame:
    """(report_id, text): a report as Markdown, from ordered sections (report_id,
    place, key, body) and titles (report_id, title)."""
    part = F.concat(F.lit("## "), F.col("key"), F.lit("\n\n"), F.col("body"))
    body = joined(sections, "report_id", "place", part, "\n\n")
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit(default))
    return body.join(titles, "report_id", "left").select("report_id", F.concat(F.lit("# "), title, F.lit("\n\n"), "text").alias("text"))


def events(rows: DataFrame, stage: str, key: str = "task_id") -> DataFrame:
    """(key, event): a stage's rows as lines of a stream of server-sent events."""
    payload = F.to_json(F.struct(F.lit(stage).alias("stage"), *[c for c in rows.columns]))
    return rows.select(key, F.concat(F.lit("data: "), payload, F.lit("\n\n")).alias("event"))
