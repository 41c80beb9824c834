"""Reports against their materials: totals, repairs, anchors of issues.

A report is a row (report_id, report) with JSON text; materials are rows (report_id,
ord, text) or, where stated, one text."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of a report's findings and of their evidence, and number tokens
# of materials.
FINDINGS, EVIDENCE = ("关键发现", "key_findings"), ("证据", "evidence")
MATERIAL_NUMBER, DIGITS = r"\d+\.?\d*[万亿千百十万%年]*", r"\d+\.?\d*"
# What an issue says, and what becomes of it without an anchor.
NO_SOURCE, NO_ANCHOR, CONTRADICTS = "无来源支撑", "锚点不存在", "与素材矛盾"
UNSUPPORTED, DROP_UNSUPPORTED, DROP_CONTRADICTION = "无来源支撑（锚点不存在）", "丢弃（无证据锚点）", "丢弃（无法锚定矛盾证据）"


def totals(checks: DataFrame) -> DataFrame:
    """(report_id, total, found, not_found, issue_ratio, passed, rewrite_scope) of
    checked numbers (report_id, ord, number, found): the ratio is a percentage."""
    scope = F.array_sort(F.collect_list(F.when(~F.col("found") & (F.col("number") != ""), F.struct("ord", "number"))))["number"]
    missing = F.count_if(~F.col("found"))
    return checks.groupBy("report_id").agg(
        F.count("*").alias("total"), F.count_if("found").alias("found"), missing.alias("not_found"),
        F.round(missing * 100 / F.count("*"), 1).alias("issue_ratio"), (missing == 0).alias("passed"), scope.alias("rewrite_scope"),
    )


def findings(report: Column) -> Column:
    """The findings of a report as an array of JSON texts; empty where there are none,
    null where the report is no JSON object."""
    kind = ", ".join(f"`{n}`: array<string>" for n in FINDINGS)
    found = F.from_json(report, f"struct<{kind}>")
    lists = [F.when(F.size(found[n]) > 0, found[n]) for n in FINDINGS]
    return F.when(F.substring(F.ltrim(report), 1, 1) == "{", F.coalesce(*lists, F.array().cast("array<string>")))


def evidence_count(report: Column) -> Column:
    """The evidence items of all findings, 1 at least."""
    kind = ", ".join(f"`{n}`: array<string>" for n in EVIDENCE)

    def items(finding: Column) -> Column:
        own = F.from_json(finding, f"struct<{kind}>")
        return F.greatest(F.coalesce(*(F.when(F.size(own[n]) > 0, F.size(own[n])) for n in EVIDENCE), F.lit(0)), F.lit(0))

    total = F.aggregate(F.transform(F.coalesce(findings(report), F.array().cast("array<string>")), items), F.lit(0), lambda s, n: s + n)
    return F.greatest(total, F.lit(1))


def critical_ratio(report: Column, issues: Column) -> Column:
    """The share of findings that contain the first 20 characters of a critical issue
    (an array of structs with sentence and impact); 0.5 for what is no JSON object."""
    keys = F.filter(F.transform(F.filter(issues, lambda i: i["impact"] == "critical"), lambda i: F.substring(i["sentence"], 1, 20)), lambda k: k != "")
    found = findings(report)
    hit = F.filter(found, lambda f: F.exists(keys, lambda k: F.contains(f, k)))
    return F.when(found.isNull(), 0.5).otherwise(F.size(hit) / F.greatest(F.size(found), F.lit(1)))


def passes(issues: Column) -> Column:
    """struct(severe, passed): how many issues (an array of texts) fail a report, and
    whether none does."""
    n = F.size(F.filter(issues, lambda i: F.contains(i, F.lit(NO_SOURCE)) | F.contains(i, F.lit(CONTRADICTS))))
    return F.struct(n.alias("severe"), (n == 0).alias("passed"))


def corrections(wrong: DataFrame, materials: DataFrame) -> DataFrame:
    """(report_id, ord, number, correct) for numbers (report_id, ord, number): the
    first number token of the report's materials with the same first run of digits;
    null where none has it. An equi-join on those runs."""
    tokens = materials.select("report_id", F.col("ord").alias("m"), F.posexplode(F.regexp_extract_all("text", F.lit(MATERIAL_NUMBER), F.lit(0))).alias("p", "token"))
    run = lambda c: F.regexp_extract(c, DIGITS, 0)
    first = tokens.withColumn("run", run("token")).groupBy("report_id", "run").agg(F.min_by("token", F.struct("m", "p")).alias("correct"))
    return wrong.withColumn("run", run("number")).join(first, ["report_id", "run"], "left").select("report_id", "ord", "number", "correct")


def repaired(text: Column, number: Column, correct: Column) -> Column:
    """A text with the first occurrence of a number replaced by the correct one; as it
    is where either is missing."""
    at = F.position(number, text)
    swapped = F.concat(F.substring(text, F.lit(1), at - 1), correct, F.substring(text, at + F.length(number), F.length(text)))
    return F.when((at > 0) & correct.isNotNull() & (F.length(number) > 0), swapped).otherwise(text)


def _replaced(value, pairs: list[tuple[str, str]]):
    if isinstance(value, str):
        for wrong, right in pairs:
            value = value.replace(wrong, right, 1)
        return value
    if isinstance(value, dict):
        return {k: _replaced(v, pairs) for k, v in value.items()}
    return [_replaced(v, pairs) for v in value] if isinstance(value, list) else value


def repaired_reports(reports: DataFrame, wrong: DataFrame, materials: DataFrame) -> DataFrame:
    """(report_id, report) with every string of the JSON, at any depth, repaired: each
    wrong number (report_id, ord, number) once a string, in order. What is no JSON
    stays as it is."""
    fixes = corrections(wrong, materials).where("correct is not null and correct <> number and number <> ''")
    lists = fixes.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("ord", "number", "correct"))).alias("fixes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for report, fixes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                try:
                    out.append(json.dumps(_replaced(json.loads(report), [(f["number"], f["correct"]) for f in fixes]), ensure_ascii=False) if fixes else report)
                except (TypeError, ValueError):
                    out.append(report)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["report_id", "report"])

    kind = reports.schema["report_id"].dataType.simpleString()
    return reports.select("report_id", "report").join(lists, "report_id", "left").mapInArrow(run, f"report_id {kind}, report string")


def anchored_issues(issues: DataFrame) -> DataFrame:
    """Issues (issue, suggestion, anchor, ...) after a look for their anchors (null or
    empty without one), with evidence_anchor. A missing source that is there after all
    is no issue; one that isn't, and a contradiction without an anchor, are to be
    dropped from the report."""
    said = lambda *words: F.coalesce(F.contains("issue", F.lit(words[0])) | F.contains("issue", F.lit(words[-1])), F.lit(False))
    found = F.coalesce("anchor", F.lit("")) != ""
    missing, contradicts = said(NO_SOURCE, NO_ANCHOR), said(CONTRADICTS)
    out = issues.where(~(missing & found))
    return out.withColumns({
        "suggestion": F.when(missing, DROP_UNSUPPORTED).when(contradicts & ~found, DROP_CONTRADICTION).otherwise(F.col("suggestion")),
        "issue": F.when(missing, UNSUPPORTED).otherwise(F.col("issue")),
        "evidence_anchor": F.when(~missing & contradicts & found, F.col("anchor")).otherwise(""),
    }).drop("anchor")


def anchor_report(method: Column) -> Column:
    """struct(matched, similarity, match_method) of the method that found an anchor."""
    kind = F.when(method.isNull(), "none").when(method == "entity", "entity").when(method == "semantic", "semantic").otherwise("exact")
    return F.struct(method.isNotNull().alias("matched"), F.when(kind == "exact", 1.0).when(kind == "none", 0.0).otherwise(0.9).alias("similarity"), kind.alias("match_method"))
