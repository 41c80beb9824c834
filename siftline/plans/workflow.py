"""Queries of the workflow's steps, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import prompts
from siftline.operators import evidence, workflow
from siftline.plans.queries import QUANTITIES, SIDE_ROWS, _sides, query, read
from siftline.sources import tables


@query("""WITH k AS (SELECT o_orderkey AS k, ['auto', 'disabled', 'web-only', 'ENABLED'][CAST(o_orderkey % 4 + 1 AS INTEGER)] AS mode FROM orders)
SELECT k AS id, CASE WHEN k % 4 >= 2 THEN 'none' WHEN k % 3 = 0 AND k % 5 = 0 THEN 'state' WHEN k % 3 = 0 THEN 'index' WHEN k % 5 = 0 THEN 'kept' WHEN k % 7 = 0 THEN 'none' WHEN k % 11 = 0 THEN 'cache' ELSE 'parse' END AS source FROM k""")
def ingestion_source(spark, sf_dir):
    k = F.col("o_orderkey")
    mode = F.element_at(F.array(*map(F.lit, ("auto", "disabled", "web-only", "ENABLED"))), (k % 4 + 1).cast("int"))
    return read(spark, sf_dir, "orders").select(k.alias("id"), workflow.ingestion(mode, k % 3 == 0, k % 5 == 0, F.when(k % 7 != 0, "p"), k % 11 == 0).alias("source"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '概述' END AS first, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '关于''' || p_name || '"''的总体分析' END AS argument FROM part""")
def outline_sections(spark, sf_dir):
    """Half of the outlines can't be read; the tasks have a quotation mark in them."""
    section = F.to_json(F.struct(F.array(F.struct(F.col("p_name").alias("title"), F.col("p_type").alias("main_argument"))).alias("sections")))
    answer = F.when(F.col("p_partkey") % 2 == 0, section).otherwise("no outline")
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), workflow.outline(answer, F.concat("p_name", F.lit('"'))).alias("o"))
    return rows.select("id", F.get_json_object("o", "$[0].title").alias("first"), F.get_json_object("o", "$[0].main_argument").alias("argument"))


CHUNKS = [
    '{"choices": [{"finish_reason": "stop"}]}', '{"choices": [{"finish_reason": null}]}', '{"type": "message_stop"}', '{"type": "delta"}', '{"done": true}', '{"done": false}',
    '{"usage_metadata": {"n": 1}}', '{"response_metadata": {"finish_reason": "length"}}', '{"response_metadata": {"done": true}}', '{"response_metadata": {}}', "no json", "{}",
]
_CHUNKS = ", ".join(f"'{c}'" for c in CHUNKS)


@query(f"""WITH c AS (SELECT o_orderkey AS id, [{_CHUNKS}][CAST(o_orderkey % {len(CHUNKS)} + 1 AS INTEGER)] AS t FROM orders), j AS (SELECT id, CASE WHEN json_valid(t) THEN t ELSE '{{}}' END AS t FROM c)
SELECT id, (t ->> '$.choices[0].finish_reason') IS NOT NULL OR coalesce((t ->> '$.type') = 'message_stop', false) OR coalesce((t ->> '$.done') = 'true', false) OR (t ->> '$.usage_metadata') IS NOT NULL
  OR (t ->> '$.response_metadata.finish_reason') IS NOT NULL OR coalesce((t ->> '$.response_metadata.done') = 'true', false) AS finished FROM j""")
def stream_finished(spark, sf_dir):
    k = F.col("o_orderkey")
    chunk = F.element_at(F.array(*map(F.lit, CHUNKS)), (k % len(CHUNKS) + 1).cast("int"))
    return read(spark, sf_dir, "orders").select(k.alias("id"), workflow.stream_finished(chunk).alias("finished"))


@query("""SELECT p_brand AS label, min(p_partkey) OVER (PARTITION BY p_brand) AS first, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS place, CAST(p_size AS VARCHAR) AS value FROM part""")
def items_by_label(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_brand").alias("label"), F.col("p_size").cast("string").alias("value"))
    found = workflow.by_label(parts)
    try:
        return tables.written(found, "labels")
    finally:
        tables.delete(spark, found.path)


@query(f"""WITH {SIDE_ROWS}, q AS ({QUANTITIES.format(t='l', label="'市场规模'")}), k AS (SELECT DISTINCT substring(raw, 1, 20) AS key FROM q), m AS (SELECT key, min(l.id) AS ord FROM k JOIN l ON contains(l.text, key) GROUP BY 1)
SELECT q.id, m.ord FROM q JOIN m ON m.key = substring(raw, 1, 20)""")
def quantity_sources(spark, sf_dir):
    left, _ = _sides(spark, sf_dir)
    return workflow.source_of(evidence.quantities(left), left.select(F.col("id").alias("ord"), "text"))


@query("""SELECT conv_id AS task_id, count(*) FILTER (turn % 3 <> 0 AND trim(text) <> '') AS effective FROM conversations GROUP BY conv_id""")
def effective_materials(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("task_id"), F.when(F.col("turn") % 3 != 0, F.col("text")).otherwise("  ").alias("text"))
    return workflow.effective(rows)


@query("""SELECT o_custkey AS report_id, '# ' || CASE WHEN o_custkey % 2 = 0 THEN 't' || o_custkey ELSE '分析报告' END || chr(10) || chr(10) || '## 摘要' || chr(10) || chr(10) || 's' || o_custkey || chr(10) || chr(10) || '## 结论' || chr(10) || chr(10) || 'c' || chr(10) || chr(10) || '## other' || chr(10) || chr(10) || 'o' AS text FROM (SELECT DISTINCT o_custkey FROM orders)""")
def report_text(spark, sf_dir):
    reports = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("report_id")).distinct()
    section = lambda key, body: F.struct(F.lit(key).alias("key"), body.alias("body"))
    rows = reports.select("report_id", F.inline(F.array(section("other", F.lit("o")), section("结论", F.lit("c")), section("title", F.lit("x")), section("摘要", F.concat(F.lit("s"), F.col("report_id"))))))
    titles = reports.select("report_id", F.when(F.col("report_id") % 2 == 0, F.concat(F.lit("t"), "report_id")).otherwise(" ").alias("title"))
    return workflow.report_text(prompts.ordered_sections(rows), titles)


@query("""SELECT p_partkey AS task_id, 'data: {"stage":"plan","task_id":' || p_partkey || ',"n":' || p_size || '}' || chr(10) || chr(10) AS event FROM part""")
def stage_events(spark, sf_dir):
    return workflow.events(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("task_id"), F.col("p_size").alias("n")), "plan")
