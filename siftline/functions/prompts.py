"""Texts for models and readers: materials with their sources, outlines, conflicts.

Labels and marks are fixed values; each stands where it is used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.operators.retrieve import top

# The order of a report's sections, and marks of origins.
SECTIONS = [
    "摘要", "执行摘要", "研究背景", "调研概述", "行业现状", "市场规模", "竞争格局", "产品与价格趋势", "商业模式",
    "行业挑战与风险", "总结与展望", "总结", "结论", "建议", "引用来源", "竞品分析", "机会与风险", "信息来源附录",
]
TITLES = ["标题", "title"]
INTERNAL, WEB, RULE = "📄【文档资料】", "🌐【公开网络信息】", "\n\n---\n\n"


def _plain(number: Column) -> Column:
    return F.rtrim(F.format_string("%.1f", number))


def joined(rows: DataFrame, by: str, order: str, text: Column, sep: str, name: str = "text") -> DataFrame:
    """(by, name): the rows' texts in order, with ``sep`` between; rows whose text is
    null are left out."""
    parts = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct(F.col(order).alias("o"), text.alias("t"))))).alias("parts"))
    return parts.select(by, F.array_join(F.col("parts")["t"], sep).alias(name))


def source_note(internal_only: bool = False) -> Column:
    """What a material's citation says of its source, from source_type, doc_name,
    page_num, url, confidence_weight and trust_tier; empty for other origins."""
    weight = F.concat(F.lit(" | 置信权重: "), _plain(F.col("confidence_weight")))
    page = F.when(F.coalesce("page_num", F.lit(0)) > 0, F.concat(F.lit("，第"), F.col("page_num"), F.lit("页"))).otherwise("")
    inner = F.concat(F.lit(INTERNAL), F.coalesce("doc_name", F.lit("内部文档")), page, weight, F.when(F.col("confidence_weight") >= 0.9, " (高置信度)").otherwise(" (中置信度)"))
    warn = F.when(F.col("trust_tier") == "unverified", " | ⚠️ 未经验证，仅供交叉验证").when(F.col("trust_tier") == "low_quality", " | ❌ 低质量来源，禁止引用").otherwise("")
    outer = F.concat(F.lit(WEB), F.coalesce("url", F.lit("")), weight, F.when(F.col("confidence_weight") >= 0.6, " (中置信度)").otherwise(" (低置信度)"), warn)
    origin = F.lit("pdf") if internal_only else F.col("source_type")
    return F.when(origin == "pdf", inner).when(origin == "web", outer).otherwise("")


def conflict_lines(conflicts: DataFrame) -> DataFrame:
    """(task_id, text) of conflicts (task_id, ord, topic, status, pdf_statement,
    web_statement, resolution): the head of a prompt."""
    c = F.col
    line = F.when(c("status") == "conflict", F.concat(F.lit("🔴 冲突主题「"), c("topic"), F.lit("」：\n  📄【内部文档】"), c("pdf_statement"), F.lit("\n  🌐【公开网络】"), c("web_statement"), F.lit("\n  ⚖️ 处理："), c("resolution")))
    line = line.otherwise(F.concat(F.lit("🟢 一致主题「"), c("topic"), F.lit("」："), c("pdf_statement")))
    return joined(conflicts, "task_id", "ord", line, "\n").withColumn("text", F.concat(F.lit("【信源冲突说明】以下素材中存在信息冲突：\n"), "text", F.lit("\n---")))


def material_prompt(materials: DataFrame, conflicts: DataFrame | None = None, most: int = 1200, internal_only: bool = False) -> DataFrame:
    """(task_id, text) of materials (task_id, ord from 0, text, trust_tier and what
    ``source_note`` needs): numbered, each with its source, after the conflicts."""
    trust = F.when(F.col("trust_tier") != "verified", F.concat(F.lit(" trust_tier="), F.col("trust_tier"))).otherwise("")
    part = F.concat(F.lit("【S"), F.col("ord") + 1, F.lit("】("), source_note(internal_only), trust, F.lit(")\n"), F.substring(F.coalesce("text", F.lit("")), 1, most))
    out = joined(materials, "task_id", "ord", part, RULE)
    if conflicts is None:
        return out
    head = conflict_lines(conflicts).withColumnRenamed("text", "head")
    return out.join(head, "task_id", "left").select("task_id", F.concat_ws(RULE, "head", "text").alias("text"))


def conflict_section(conflicts: DataFrame) -> DataFrame:
    """(task_id, text): the conflicts as a block of Markdown."""
    c = F.col
    own = F.concat(F.lit("🔴 **冲突预警 — "), c("topic"), F.lit("**\n\n- 📄 **内部文档观点**: "), c("pdf_statement"), F.lit("\n\n- 🌐 **外网公开信息**: "), c("web_statement"), F.lit("\n\n- ⚖️ **处理方式**: "), c("resolution"))
    same = F.concat(F.lit("🟢 **信息一致 — "), c("topic"), F.lit("**\n\n- "), c("pdf_statement"))
    line = F.concat(F.when(c("status") == "conflict", own).otherwise(same), F.lit("\n\n\n---\n"))
    return joined(conflicts, "task_id", "ord", line, "\n").withColumn("text", F.concat(F.lit("## 信源冲突预警\n\n\n"), "text"))


OUTLINE = "array<struct<level:int,title:string,main_argument:string,supporting_evidence:array<string>,subsections:array<struct<level:int,title:string,argument:string,evidence_indices:array<string>,paragraph_plan:string>>>>"


def outline_text(outline: Column) -> Column:
    """An outline (JSON text) as indented lines; empty for none."""
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    indent = lambda level: F.repeat(F.lit("  "), F.greatest(level - 1, F.lit(0)))
    proof = lambda items: F.when(F.size(items) > 0, F.concat(F.lit(" [证据: "), F.array_join(items, ", "), F.lit("]"))).otherwise("")

    def sub(x: Column) -> Column:
        pad = indent(F.coalesce(x["level"], F.lit(2)))
        return F.concat_ws(
            "\n",
            F.concat(pad, F.lit("- "), F.coalesce(x["title"], F.lit("")), proof(x["evidence_indices"])),
            F.when(filled(x["argument"]), F.concat(pad, F.lit("  论点: "), x["argument"])),
            F.when(filled(x["paragraph_plan"]), F.concat(pad, F.lit("  段落规划: "), x["paragraph_plan"])),
        )

    def section(x: Column) -> Column:
        level = F.coalesce(x["level"], F.lit(1))
        pad, bar = indent(level), F.repeat(F.lit("="), F.greatest(3 - level, F.lit(0)))
        head = F.concat(pad, F.lit("【"), bar, F.lit(" "), F.coalesce(x["title"], F.lit("")), F.lit(" "), bar, F.lit("】"), proof(x["supporting_evidence"]))
        subs = F.transform(F.coalesce(x["subsections"], F.array().cast(x_type)), sub)
        return F.concat_ws("\n", head, F.when(filled(x["main_argument"]), F.concat(pad, F.lit("  核心论点: "), x["main_argument"])), F.when(F.size(subs) > 0, F.array_join(subs, "\n")))

    x_type = OUTLINE[OUTLINE.index("subsections:") + len("subsections:") : -2]
    return F.coalesce(F.array_join(F.transform(F.from_json(outline, OUTLINE), section), "\n"), F.lit(""))


def web_entry(title: Column, url: Column, content: Column) -> Column:
    """A web hit as a link and its text; the text alone without a title or a url."""
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    body = F.coalesce(content, F.lit(""))
    return F.when(given(title) & given(url), F.concat(F.lit("["), title, F.lit("]("), url, F.lit(")\n"), body)).otherwise(body)


def merged_sections(hits: DataFrame) -> DataFrame:
    """(task_id, text) of hits (task_id, ord, origin, text): the web's, then those of
    documents; a side without hits has no section."""
    web = joined(hits.where("origin = 'web'"), "task_id", "ord", F.col("text"), "\n\n", "web")
    internal = joined(hits.where("origin = 'pdf'"), "task_id", "ord", F.col("text"), " | ", "internal")
    both = web.join(internal, "task_id", "full_outer")
    return both.select("task_id", F.concat_ws("\n\n", F.concat(F.lit("【网络搜索结果】\n"), "web"), F.concat(F.lit("【PDF 参考材料】\n"), "internal")).alias("text"))


def tagged(source: Column, page: Column, text: Column) -> Column:
    """A retrieved passage with its source and page."""
    return F.concat(F.lit("["), source, F.lit(" - 页 "), page, F.lit("] "), text)


def message_text(answer: Column) -> Column:
    """The text of a model's answer: plain, or JSON with content (text, or a list of
    texts and parts) or text."""
    parts = "array<struct<text:string>>"
    obj = F.from_json(answer, "struct<content:string,text:string>")
    content = F.coalesce(obj["content"], obj["text"])
    listed = F.when(F.substring(F.ltrim(content), 1, 1) == "[", F.array_join(F.transform(F.from_json(content, parts), lambda p: F.coalesce(p["text"], F.lit(""))), " "))
    return F.when(F.substring(F.ltrim(answer), 1, 1) == "{", F.coalesce(listed, content, answer)).otherwise(answer)


def ordered_sections(sections: DataFrame, first: list[str] = SECTIONS) -> DataFrame:
    """(report_id, place, key, body): a report's sections but its title, those that are
    named first in that order, then the others by name; empty ones have no place."""
    from pyspark.sql import Window

    at = F.array_position(F.array(*map(F.lit, first)), F.col("key"))
    place = F.row_number().over(Window.partitionBy("report_id").orderBy(F.when(at > 0, at).otherwise(len(first) + 1), "key"))
    return sections.where(~F.col("key").isin(TITLES) & (F.coalesce("body", F.lit("")) != "")).select("report_id", place.alias("place"), "key", "body")


def wrapped(text: Column, width: float) -> Column:
    """The lines of a text no wider than ``width``, an array: a wide character counts
    1, others a half; no character is split, line ends stay."""

    def line(x: Column) -> Column:
        start = F.struct(F.lit("").alias("held"), F.lit(0.0).alias("wide"), F.array().cast("array<string>").alias("out"))

        def step(acc: Column, c: Column) -> Column:
            own = F.when(F.octet_length(c) > 2, 1.0).otherwise(0.5)
            fits = (acc["wide"] + own <= width) | (acc["held"] == "")
            return F.when(fits, F.struct(F.concat(acc["held"], c).alias("held"), (acc["wide"] + own).alias("wide"), acc["out"].alias("out"))).otherwise(F.struct(c.alias("held"), own.alias("wide"), F.array_append(acc["out"], acc["held"]).alias("out")))

        return F.aggregate(F.split(x, ""), start, step, lambda acc: F.array_append(acc["out"], acc["held"]))

    return F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), line))


def scored(hits: DataFrame, by: str = "item_id", k: int = 5, default: int = 5) -> DataFrame:
    """Hits (by, rank, relevance) by a model's whole-number score, ``default`` where it
    gave none; ties as before."""
    return top(hits.withColumn("rerank_score", F.coalesce(F.col("relevance").cast("int"), F.lit(default))), by, [F.desc("rerank_score"), F.asc("rank")], k, "rerank_rank")
