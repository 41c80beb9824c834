"""Plans of tasks: gates by search mode, proposals of a model, and what to fall back on.

``tasks`` has (item_id, text, mode, has_document, plan); plan is a model's answer as
text, or null. Modes are auto, disabled (documents only) and enabled (web only), in
any case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.intents import needs_web
from siftline.operators.rules import safe_json, search_mode

# The three sub-tasks of a task without a plan.
FALLBACK = ["行业概况与背景分析：", "核心维度分析：", "延伸分析："]
FALLBACK_REASON = "兜底方案：route_tag="
# Fixed value: the priority of a sub-task that names none.
LAST = 999
PLAN = "struct<sub_tasks:array<struct<sub_query:string,route_tag:string,judge_reason:string,priority:int>>>"


def forced_route(mode: Column, has_document: Column) -> Column:
    """The route that a mode forces on all sub-tasks; null where they choose."""
    m = F.lower(F.coalesce(mode, F.lit("auto")))
    return F.when((m == "enabled") | ((m == "auto") & ~has_document), "web_only").when(m == "disabled", "pdf_only")


def stopped(task: Column, mode: Column, has_document: Column) -> Column:
    """Why a task can't be planned in its mode; null if it can."""
    only = F.lower(F.coalesce(mode, F.lit("auto"))) == "disabled"
    return F.when(only & ~has_document, "NO_PDF_IN_PDF_ONLY_MODE").when(only & needs_web(task), "MODE_CONFLICT")


def fallback(task: Column, route: Column) -> Column:
    """The sub-tasks of a task without a plan, an array of structs."""
    route = F.coalesce(route, F.lit("web_only"))
    one = lambda k, head: F.struct(F.concat(F.lit(head), task).alias("sub_query"), route.alias("route_tag"), F.concat(F.lit(FALLBACK_REASON), route).alias("judge_reason"), F.lit(k).alias("priority"))
    return F.array(*(one(k, head) for k, head in enumerate(FALLBACK, 1)))


def planned(tasks: DataFrame) -> DataFrame:
    """(item_id, pos, sub_query, route_tag, judge_reason, priority): the sub-tasks of
    the tasks that may go on, by priority, ties as proposed. Empty tasks and stopped
    ones have none."""
    route = forced_route(F.col("mode"), F.col("has_document"))
    go = tasks.where((F.coalesce("text", F.lit("")) != "") & stopped(F.col("text"), F.col("mode"), F.col("has_document")).isNull())
    proposed = F.from_json(safe_json(F.col("plan")), PLAN)["sub_tasks"]
    rows = go.withColumn("forced", route).withColumn("proposed", proposed)
    subs = F.when(F.size("proposed") > 0, F.col("proposed")).otherwise(fallback(F.col("text"), F.col("forced")))
    keyed = F.transform(subs, lambda x, i: F.struct(F.coalesce(x["priority"], F.lit(LAST)).alias("p"), i.alias("i"), x.alias("s")))
    each = rows.select("item_id", "forced", F.posexplode(F.array_sort(keyed)).alias("pos", "x"))
    return each.select("item_id", "pos", "x.s.sub_query", F.coalesce("forced", "x.s.route_tag").alias("route_tag"), "x.s.judge_reason", "x.s.priority")


def route_conflict(route: Column, mode: Column) -> Column:
    """Whether a sub-task's route can't be taken in a mode."""
    m = search_mode(mode)
    return ((route == "web_only") & (m == "pdf_only")) | ((route == "pdf_only") & (m == "web_only"))


def relevance_counts(classes: DataFrame) -> DataFrame:
    """(relevant, insufficient, irrelevant, all_irrelevant) of rows with a class
    ``relevance``; one row, also for an empty table."""
    n = lambda name: F.count_if(F.col("relevance") == name).alias(name)
    return classes.agg(n("relevant"), n("insufficient"), n("irrelevant"), F.coalesce(F.bool_and(F.col("relevance") == "irrelevant"), F.lit(False)).alias("all_irrelevant"))


def merged_hits(internal: DataFrame, web: DataFrame, by: str = "item_id", keep: int = 12) -> DataFrame:
    """Hits (by, doc_id, score, rank) of both origins in one list a task, internal ones
    first, cut to ``keep``; each side is in the order of its ranks, none is dropped as
    a repetition."""
    return placed(internal.withColumn("origin", F.lit("pdf")).unionByName(web.withColumn("origin", F.lit("web"))), by, keep)


def placed(both: DataFrame, by: str = "item_id", keep: int = 12) -> DataFrame:
    """``merged_hits`` of hits that have their origin (pdf or web) beside them."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(by).orderBy("origin", "rank", "doc_id"))
    return both.withColumn("place", place).where(F.col("place") <= keep)
