"""What a task asks for: pattern lists, tested list by list against the task."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of each intent. They meet the lower-cased task as they
# stand, so those with capitals never match.
DOCUMENT_LOCAL_PATTERNS = [
    r"总结\s*(PDF|文件|文档|全文|报告|资料)",
    r"概括\s*(PDF|文件|文档|全文|报告|资料)",
    r"提取\s*(PDF|文件|文档|全文|报告|资料)",
    r"梳理\s*(PDF|报告|文件|文档|资料)",
    r"翻译\s*(PDF|文件|文档)",
    r"全文\s*(总结|概括|摘要|翻译)",
    r"总结\s*[这那].*PDF",
    r"PDF\s*总结",
    r"概括全文",
    r"提取全文",
    r"梳理报告",
    r"翻译\s*PDF",
    r"总结.*文件",
    r"总结.*文档",
]
FULL_SUMMARY_PATTERNS = [
    r"总结\s*(PDF|文件|文档|全文|报告|资料|文章)",
    r"概括\s*(PDF|文件|文档|全文|报告|资料|文章)",
    r"提取\s*(全文|全部内容|所有内容)",
    r"全文\s*(总结|概括|摘要|翻译)",
    r"梳理\s*(报告|文件|文档|全文)",
    r"总结.*全文",
    r"概括.*全文",
    r"提取.*内容",
    r"写出.*摘要",
    r"生成.*摘要",
    r"摘要.*PDF",
    r"摘要.*文件",
    r"摘要.*文档",
]
PRECISE_QA_PATTERNS = [
    r"查\s*(一下|找|看|询)?\s*(数字|数据|统计|指标|参数)",
    r"找\s*(出|到)?\s*(数据|数字|信息|资料|内容|观点|论据)",
    r"提取\s*(数据|信息|数字|指标|参数|内容)",
    r"定向\s*(提问|查询|查找|检索)",
    r"具体\s*(数据|数字|信息|内容|指标|参数)",
    r"精准\s*(查询|查找|检索|提问)",
    r"查询\s*(数据|信息|数字|指标|参数)",
    r"告诉\s*我.*(数据|数字|信息|指标|参数)",
    r"多少|多久|多远|多高|多大|多长",
    r"什么\s*(是|叫|称)",
    r"是否|是否.*有",
    r"列出.*(数据|信息|内容|观点|要素)",
    r"数字.*(多少|是|为)",
    r"占比|比例|率$|增长率|渗透率|市场份额",
]
EXPANSION_RESEARCH_PATTERNS = [
    r"最新\s*(行业|市场|数据|动态|趋势|报告|新闻)",
    r"行业\s*(数据|报告|分析|动态|趋势|现状)",
    r"市场\s*(预测|趋势|分析|报告|数据|动态)",
    r"竞品\s*(对比|分析|比较|情况|信息)",
    r"竞争\s*(格局|分析|对比|情况)",
    r"海外\s*(政策|市场|动态|趋势|情况|信息)",
    r"补充\s*(外部|额外|更多|其他)\s*(信息|资料|数据)",
    r"外部\s*(信息|数据|资料|来源)",
    r"最新\s*(动态|进展|情况|消息)",
    r"全球\s*(市场|趋势|数据|报告|情况)",
    r"国际\s*(市场|趋势|数据|报告|情况)",
    r"宏观\s*(经济|环境|趋势|数据|分析)",
    r"对标\s*(分析|公司|企业|案例)",
    r"行业\s*(调研|研究|调查)",
]
EXPLICIT_PDF_ONLY_PATTERNS = [
    r"禁止\s*联网",
    r"仅[用使].*PDF\s*(原文|内容|信息|资料)",
    r"不要.*(联网|网页|网络|搜索|外部)",
    r"无需.*(联网|搜索|网络)",
    r"纯\s*PDF\s*(模式|检索|分析)",
    r"仅(基于|使用|根据|依靠)\s*PDF",
    r"不离线|不联网|不搜索|不查网",
    r"只用.*原文",
    r"只.*PDF",
    r"PDF.*原文",
    r"不要.*外部.*(信息|数据|网页|网络)",
    r"仅.*(本地|内部|已有|上传)",
]
# Words and patterns that ask for a summary of a document, which meet
# the task in its own case, and words of short ones.
SUMMARY_WORDS = [
    "总结文件", "概述文档", "基于本文件", "根据PDF内容", "根据 PDF 内容", "文档内信息", "梳理文件内容", "针对这份材料",
    "总结全文", "总结文档", "总结报告", "总结内容", "概括全文", "概括文档", "概括内容", "概述全文", "概述内容",
    "文档大意", "文章大意", "全文大意", "内容摘要", "内容总结", "解读这份文件", "解读文档", "解读报告", "解读一下",
    "文章讲了什么", "文档讲了什么", "报告讲了什么", "这篇文章说什么", "这份文件说什么", "主要内容是什么",
    "梳理文档观点", "梳理观点", "梳理内容", "梳理全文", "讲什么", "说的什么", "什么内容",
    "核心观点", "核心内容", "主要观点", "主要论述", "主题思想", "中心思想",
]
SUMMARY_PATTERNS = [
    r"总结.*(?:全文|文档|报告|内容|PDF|文件|这篇|材料)",
    r"概括.*(?:全文|文档|报告|内容|PDF|文件|这篇|材料)",
    r"概述.*(?:全文|文档|报告|内容|PDF|文件|这篇|材料)",
    r"解读.*(?:文件|文档|报告|PDF|内容|这篇|材料)",
    r"(?:全文|整篇|文档|报告|这份材料).*(?:总结|概括|概述|大意|要点)",
    r"(?:讲|说|介绍).*(?:什么|哪些|内容|要点)",
    r"基于.*(?:本文件|PDF|文档|报告|材料)",
    r"根据.*(?:PDF|文档|文件|报告|材料).*内容",
    r"梳理.*(?:文件|文档|PDF|报告|材料).*内容",
    r"针对.*(?:这份|该|这个).*(?:材料|文件|文档|报告|PDF)",
]
SHORT_WORDS = ["这", "该", "这个", "这个文件", "这份文件", "这篇文章", "这份报告", "这个PDF", "这个文档", "该文档", "该文件", "该报告"]
# Words that only the web can answer; they meet the lower-cased task.
NEED_WEB_WORDS = [
    "最新", "趋势", "动态", "近期", "当前", "现状", "政策", "法规", "监管", "合规", "标准", "竞争格局", "市场竞争", "行业排名", "头部企业", "市场占有率",
    "增长率", "增速", "同比增长", "市场份额", "占比", "融资", "上市", "IPO", "投资", "并购", "2025", "2026", "2027", "2028", "2029", "2030", "预测", "展望", "未来", "前景", "机遇",
]

#: Intents in the order in which they are tried, with their confidence.
LADDER = [("document_local", DOCUMENT_LOCAL_PATTERNS, 0.95), ("full_summary", FULL_SUMMARY_PATTERNS, 0.9), ("expansion_research", EXPANSION_RESEARCH_PATTERNS, 0.85), ("precise_qa", PRECISE_QA_PATTERNS, 0.8)]


def matched(text: Column, patterns: list[str]) -> Column:
    """The first pattern of a list that occurs in the text; null if none does."""
    return F.coalesce(*(F.when(text.rlike(f"(?U){p}"), F.lit(p)) for p in patterns))


def contained(text: Column, words: list[str]) -> Column:
    """The first word of a list that the text contains; null if none."""
    return F.get(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)), F.lit(0))


def intent(task: Column) -> Column:
    """struct(intent, explicit_pdf_only, matched_pattern, confidence) of a task, by the
    first list that has a match. A blank or null task is general for certain."""
    t = F.trim(F.lower(F.coalesce(task, F.lit(""))))
    explicit = matched(t, EXPLICIT_PDF_ONLY_PATTERNS).isNotNull()
    out = F.when(t == "", _intent("general", F.lit(False), F.lit(""), 1.0))
    for name, patterns, sure in LADDER:
        found = matched(t, patterns)
        out = out.when(found.isNotNull(), _intent(name, F.lit(True) if name == "document_local" else explicit, found, sure))
    return out.otherwise(_intent("general", explicit, F.lit(""), 0.5))


def _intent(name: str, explicit: Column, pattern: Column, sure: float) -> Column:
    return F.struct(F.lit(name).alias("intent"), explicit.alias("explicit_pdf_only"), pattern.alias("matched_pattern"), F.lit(sure).alias("confidence"))


def policy(i: Column) -> Column:
    """struct(force_pdf_only, skip_sufficiency, skip_min_chunks, strategy) of an intent."""
    name, explicit = i["intent"], i["explicit_pdf_only"]
    local = name.isin("document_local", "full_summary")
    strategy = F.when(name == "document_local", "force_pdf_only").when(name != "general", name).when(explicit, "force_pdf_only").otherwise("general")
    return F.struct((local | explicit).alias("force_pdf_only"), local.alias("skip_sufficiency"), (name == "precise_qa").alias("skip_min_chunks"), strategy.alias("strategy"))


def summary_intent(task: Column, has_document: Column) -> Column:
    """struct(is_summary, matched, confidence): whether a task asks to summarise its
    document, and by which word or pattern."""
    t = F.trim(F.coalesce(task, F.lit("")))
    word, pattern, short = contained(t, SUMMARY_WORDS), matched(t, SUMMARY_PATTERNS), contained(t, SHORT_WORDS)
    is_ = lambda yes, by, sure: F.struct(F.lit(yes).alias("is_summary"), by.alias("matched"), F.lit(sure).alias("confidence"))
    return (
        F.when(t == "", is_(False, F.lit(""), 0.0))
        .when(word.isNotNull(), is_(True, word, 0.95))
        .when(pattern.isNotNull(), is_(True, pattern, 0.7))
        .when(has_document & (F.length(t) <= 20) & short.isNotNull(), is_(True, short, 0.5))
        .otherwise(is_(False, F.lit(""), 0.0))
    )


def needs_web(task: Column) -> Column:
    """Whether a task asks for what only the web can tell."""
    return contained(F.lower(F.coalesce(task, F.lit(""))), NEED_WEB_WORDS).isNotNull()


def mode_advice(task: Column, has_document: Column, mode: Column, force: bool = False) -> Column:
    """struct(override, new_mode, suggest_switch, matched): what a summary task says
    about its search mode. Only the mixed mode is advised to drop the web; ``force``
    overrides every mode instead."""
    s = summary_intent(task, has_document)
    mixed = ~F.lower(F.coalesce(mode, F.lit("auto"))).isin("disabled", "pdf_only", "enabled", "web_only")
    override, suggest = (s["is_summary"], F.lit(False)) if force else (F.lit(False), s["is_summary"] & mixed)
    return F.struct(override.alias("override"), F.when(override | suggest, "disabled").otherwise(mode).alias("new_mode"), suggest.alias("suggest_switch"), s["matched"].alias("matched"))
