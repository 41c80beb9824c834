"""Queries of intents, plans and control, with their SQL. Their tasks are texts that
reach every pattern, dealt to the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import intents
from siftline.operators import planning, retrieve
from siftline.plans.queries import BM25, RANKED, query, read

TASKS = [
    "总结 文件", "概括报告要点", "提取 资料", "梳理 文档", "翻译文档", "全文摘要", "概括全文", "提取全文", "梳理报告", "总结这个文件", "总结一下文档", "总结这份PDF", "PDF总结",
    "总结文章", "概括 文章", "提取全部内容", "梳理全文", "总结一下全文", "概括一下全文", "提取其中内容", "写出一份摘要", "生成摘要", "摘要这个文件", "摘要一下文档",
    "查一下数据", "查数字", "找出论据", "提取指标", "定向查询", "具体数字", "精准检索", "查询参数", "告诉我一下数据", "有多少", "什么是市场", "是否可行", "列出全部数据", "数字大概是", "市场份额", "利润率", "利润率高",
    "最新行业", "行业现状", "市场预测", "竞品对比", "竞争格局", "海外政策", "补充外部资料", "外部来源", "最新进展", "全球趋势", "国际市场", "宏观经济", "对标公司", "行业调研",
    "禁止联网", "仅用PDF原文", "不要搜索", "无需联网", "纯PDF模式", "仅基于PDF", "不联网查市场份额", "只用原文总结全文", "只看PDF", "PDF的原文", "不要外部数据", "仅用本地文件",
    "查资料", "宏观政策", "竞品格局", "随便聊聊", "", "   ", "这份材料如何", "该产品", "基于本文件", "根据PDF内容", "解读一下材料", "解读这篇", "整篇的要点", "介绍有哪些", "基于这份材料", "根据报告写内容", "梳理PDF的内容",
    "针对该报告", "2026年展望", "IPO进展", "融资与并购", "概述这篇", "概括这篇材料", "中心思想", "这是一句很长很长的话所以不会是短句场景里的那一种提问", "Market Overview", "LATEST ipo",
]
#: A plan as a model answers, one without sub-tasks, and none.
PLAN = '好的 {"sub_tasks": [{"sub_query": "甲", "route_tag": "pdf_web", "judge_reason": "r", "priority": 2}, {"sub_query": "乙", "route_tag": "web_only"}, {"sub_query": "丙", "route_tag": "pdf_only", "judge_reason": "s", "priority": 1}]} 完'
PLANS = [None, "没有计划", '{"sub_tasks": []}', PLAN, PLAN]
MODES = ["auto", "disabled", "enabled", "AUTO"]


def _list(words) -> str:
    return "[" + ", ".join("NULL" if w is None else "'" + w.replace("'", "''") + "'" for w in words) + "]"


def _dealt(words, step: str = "o_orderkey") -> str:
    return f"{_list(words)}[CAST({step} % {len(words)} + 1 AS INTEGER)]"


def _first(text: str, patterns: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{p}') THEN '{p}'" for p in patterns) + " END"


def _contained(text: str, words: list[str]) -> str:
    return f"list_filter({_list(words)}, lambda w: contains({text}, w))[1]"


def _tasks(spark, sf_dir):
    k = F.col("o_orderkey")
    dealt = lambda words, step: F.element_at(F.array(*map(F.lit, words)), (step % len(words) + 1).cast("int"))
    step = F.floor(k / len(TASKS))
    return read(spark, sf_dir, "orders").select(
        k.alias("item_id"), dealt(TASKS, k).alias("text"), dealt(MODES, step).alias("mode"), (F.floor(step / 4) % 2 == 0).alias("has_document"), dealt(PLANS, k).alias("plan")
    )


ROWS = f"""t AS (SELECT o_orderkey AS item_id, {_dealt(TASKS)} AS text, {_dealt(MODES, f"(o_orderkey // {len(TASKS)})")} AS mode, (o_orderkey // {4 * len(TASKS)}) % 2 = 0 AS has_document, o_orderkey % {len(PLANS)} AS plan FROM orders)"""
INTENT = f"""i AS (SELECT *, trim(lower(text)) AS low, {_first('trim(lower(text))', intents.EXPLICIT_PDF_ONLY_PATTERNS)} IS NOT NULL AS explicit,
    {", ".join(f"{_first('trim(lower(text))', patterns)} AS {name}" for name, patterns, _ in intents.LADDER)} FROM t)"""


@query(f"""WITH {ROWS}, {INTENT}
SELECT item_id, CASE WHEN low = '' THEN 'general' {" ".join(f"WHEN {n} IS NOT NULL THEN '{n}'" for n, _, _ in intents.LADDER)} ELSE 'general' END AS intent, CASE WHEN low = '' THEN false WHEN document_local IS NOT NULL THEN true ELSE explicit END AS explicit_pdf_only,
  CASE WHEN low = '' THEN '' ELSE coalesce({", ".join(n for n, _, _ in intents.LADDER)}, '') END AS matched_pattern, CASE WHEN low = '' THEN 1.0 {" ".join(f"WHEN {n} IS NOT NULL THEN {c}" for n, _, c in intents.LADDER)} ELSE 0.5 END::DOUBLE AS confidence FROM i""")
def intent(spark, sf_dir):
    return _tasks(spark, sf_dir).select("item_id", intents.intent(F.col("text")).alias("i")).select("item_id", "i.*")


@query(f"""WITH {ROWS}, {INTENT}, n AS (SELECT item_id, CASE WHEN low = '' THEN false ELSE explicit END AS explicit, CASE WHEN low = '' THEN 'general' {" ".join(f"WHEN {n} IS NOT NULL THEN '{n}'" for n, _, _ in intents.LADDER)} ELSE 'general' END AS intent FROM i)
SELECT item_id, intent IN ('document_local', 'full_summary') OR explicit AS force_pdf_only, intent IN ('document_local', 'full_summary') AS skip_sufficiency, intent = 'precise_qa' AS skip_min_chunks,
  CASE intent WHEN 'document_local' THEN 'force_pdf_only' WHEN 'general' THEN CASE WHEN explicit THEN 'force_pdf_only' ELSE 'general' END ELSE intent END AS strategy FROM n""")
def intent_policy(spark, sf_dir):
    return _tasks(spark, sf_dir).select("item_id", intents.policy(intents.intent(F.col("text"))).alias("p")).select("item_id", "p.*")


SUMMARY = f"""s AS (SELECT item_id, mode, trim(text) AS t, has_document, {_contained('text', intents.SUMMARY_WORDS)} AS word, {_first('trim(text)', intents.SUMMARY_PATTERNS)} AS pattern,
    CASE WHEN has_document AND length(trim(text)) <= 20 THEN {_contained('text', intents.SHORT_WORDS)} END AS short FROM t),
  r AS (SELECT *, t <> '' AND coalesce(word, pattern, short) IS NOT NULL AS is_summary, CASE WHEN t = '' THEN '' ELSE coalesce(word, pattern, short, '') END AS matched FROM s)"""


@query(f"""WITH {ROWS}, {SUMMARY}
SELECT item_id, is_summary, matched, CASE WHEN NOT is_summary THEN 0.0 WHEN word IS NOT NULL THEN 0.95 WHEN pattern IS NOT NULL THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence, len(list_filter({_list(intents.NEED_WEB_WORDS)}, lambda w: contains(lower(t), w))) > 0 AS needs_web FROM r""")
def summary_intent(spark, sf_dir):
    rows = _tasks(spark, sf_dir)
    return rows.select("item_id", intents.summary_intent(F.col("text"), F.col("has_document")).alias("s"), intents.needs_web(F.col("text")).alias("needs_web")).select("item_id", "s.*", "needs_web")


@query(f"""WITH {ROWS}, {SUMMARY}, a AS (SELECT *, is_summary AND lower(mode) NOT IN ('disabled', 'pdf_only', 'enabled', 'web_only') AS suggested FROM r)
SELECT item_id, false AS override, CASE WHEN suggested THEN 'disabled' ELSE mode END AS new_mode, suggested AS suggest_switch, matched, is_summary AS forced, CASE WHEN is_summary THEN 'disabled' ELSE mode END AS forced_mode FROM a""")
def mode_advice(spark, sf_dir):
    advice = lambda force: intents.mode_advice(F.col("text"), F.col("has_document"), F.col("mode"), force)
    rows = _tasks(spark, sf_dir).select("item_id", advice(False).alias("a"), advice(True).alias("b"))
    return rows.select("item_id", "a.*", F.col("b.override").alias("forced"), F.col("b.new_mode").alias("forced_mode"))


GATES = f"""g AS (SELECT *, CASE WHEN lower(mode) = 'disabled' AND NOT has_document THEN 'NO_PDF_IN_PDF_ONLY_MODE' WHEN lower(mode) = 'disabled' AND len(list_filter({_list(intents.NEED_WEB_WORDS)}, lambda w: contains(lower(text), w))) > 0 THEN 'MODE_CONFLICT' END AS reason,
    CASE WHEN lower(mode) = 'enabled' OR (lower(mode) = 'auto' AND NOT has_document) THEN 'web_only' WHEN lower(mode) = 'disabled' THEN 'pdf_only' END AS forced FROM t)"""


@query(f"WITH {ROWS}, {GATES} SELECT item_id, reason AS terminate_reason, forced AS forced_route FROM g")
def plan_gates(spark, sf_dir):
    args = (F.col("mode"), F.col("has_document"))
    return _tasks(spark, sf_dir).select("item_id", planning.stopped(F.col("text"), *args).alias("terminate_reason"), planning.forced_route(*args).alias("forced_route"))


@query(f"""WITH {ROWS}, {GATES}, go AS (SELECT * FROM g WHERE reason IS NULL AND text <> ''),
  s AS (SELECT item_id, forced, unnest([{{'i': 0, 'q': '甲', 'r': 'pdf_web', 'j': 'r', 'p': 2}}, {{'i': 1, 'q': '乙', 'r': 'web_only', 'j': NULL, 'p': NULL}}, {{'i': 2, 'q': '丙', 'r': 'pdf_only', 'j': 's', 'p': 1}}]) AS x FROM go WHERE plan >= 3
    UNION ALL SELECT item_id, forced, unnest([{{'i': 0, 'q': '行业概况与背景分析：' || text, 'r': coalesce(forced, 'web_only'), 'j': '兜底方案：route_tag=' || coalesce(forced, 'web_only'), 'p': 1}}, {{'i': 1, 'q': '核心维度分析：' || text, 'r': coalesce(forced, 'web_only'), 'j': '兜底方案：route_tag=' || coalesce(forced, 'web_only'), 'p': 2}}, {{'i': 2, 'q': '延伸分析：' || text, 'r': coalesce(forced, 'web_only'), 'j': '兜底方案：route_tag=' || coalesce(forced, 'web_only'), 'p': 3}}]) FROM go WHERE plan < 3)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY coalesce(x.p, 999), x.i) - 1 AS INTEGER) AS pos, x.q AS sub_query, coalesce(forced, x.r) AS route_tag, x.j AS judge_reason, CAST(x.p AS INTEGER) AS priority FROM s""")
def plan_tasks(spark, sf_dir):
    return planning.planned(_tasks(spark, sf_dir))


ROUTES, ROUTE_MODES = ["web_only", "pdf_only", "pdf_web"], ["auto", "disabled", "web-only", "PDF_ONLY", "enabled", "pdf_web"]


@query(f"""WITH r AS (SELECT o_orderkey AS id, {_dealt(ROUTES)} AS route, replace(lower({_dealt(ROUTE_MODES, "(o_orderkey // 3)")}), '-', '_') AS mode FROM orders)
SELECT id, (route = 'web_only' AND mode IN ('disabled', 'pdf_only')) OR (route = 'pdf_only' AND mode IN ('enabled', 'web_only')) AS conflict FROM r""")
def route_conflicts(spark, sf_dir):
    k = F.col("o_orderkey")
    dealt = lambda words, step: F.element_at(F.array(*map(F.lit, words)), (step % len(words) + 1).cast("int"))
    return read(spark, sf_dir, "orders").select(k.alias("id"), planning.route_conflict(dealt(ROUTES, k), dealt(ROUTE_MODES, F.floor(k / 3))).alias("conflict"))


@query(f"""WITH {BM25}, t AS (SELECT * FROM (SELECT *, {RANKED} AS rank FROM bm) WHERE rank <= 10), m AS (SELECT max(score) AS top FROM t), b AS (SELECT item_id, round(max(round(score / top, 6)), 6) AS best FROM t, m GROUP BY item_id)
SELECT count(*) FILTER (best >= 0.7) AS relevant, count(*) FILTER (best >= 0.5 AND best < 0.7) AS insufficient, count(*) FILTER (best < 0.5) AS irrelevant, coalesce(bool_and(best < 0.5), false) AS all_irrelevant FROM b""")
def relevance_counts(spark, sf_dir):
    from siftline.plans.queries import QUERIES

    return planning.relevance_counts(QUERIES["relevance_class"](spark, sf_dir))


@query(f"""WITH {BM25}, p AS (SELECT *, {RANKED} AS rank FROM bm JOIN documents USING (doc_id) WHERE lang = 'en'), w AS (SELECT *, {RANKED} AS rank FROM bm JOIN documents USING (doc_id) WHERE lang IS DISTINCT FROM 'en'),
  u AS (SELECT item_id, doc_id, score, rank, 'pdf' AS origin FROM p WHERE rank <= 12 UNION ALL SELECT item_id, doc_id, score, rank, 'web' FROM w WHERE rank <= 6),
  o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY origin, rank, doc_id) AS place FROM u)
SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank, origin, CAST(place AS INTEGER) AS place FROM o WHERE place <= 12""")
def merged_hits(spark, sf_dir):
    docs, items = read(spark, sf_dir, "documents", "benchmark")
    hits = retrieve.bm25_topk(docs, items, 12, F.col("lang") == "en")
    best = hits.where(F.col("rank") <= F.when(F.col("side"), 12).otherwise(6))  # one pass for both sides
    return planning.placed(best.select("item_id", "doc_id", "score", "rank", F.when(F.col("side"), "pdf").otherwise("web").alias("origin")))


