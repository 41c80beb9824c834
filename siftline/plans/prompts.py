"""Queries of texts for models and readers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import prompts
from siftline.plans.queries import BM25, RANKED, query, read


def _cited(spark, sf_dir):
    """Materials of tasks made from documents: six a task."""
    docs, d = read(spark, sf_dir, "documents"), F.col("doc_id")
    return docs.select(
        F.floor(d / 6).alias("task_id"), (d % 6).alias("ord"), "text", F.when(d % 3 == 0, "pdf").when(d % 3 == 1, "web").otherwise("other").alias("source_type"),
        F.concat(F.lit("doc-"), "source").alias("doc_name"), (d % 4).cast("int").alias("page_num"), F.concat(F.lit("http://example.org/"), "doc_id").alias("url"),
        F.when(d % 2 == 0, 0.9).otherwise(0.6).alias("confidence_weight"), F.when(d % 5 == 0, "verified").when(d % 5 == 1, "low_quality").otherwise("unverified").alias("trust_tier"),
    )


CITED = """c AS (SELECT doc_id // 6 AS task_id, doc_id % 6 AS ord, text, CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'web' ELSE 'other' END AS origin, 'doc-' || source AS doc, doc_id % 4 AS page, 'http://example.org/' || doc_id AS url, CASE WHEN doc_id % 2 = 0 THEN '0.9' ELSE '0.6' END AS w, CASE doc_id % 5 WHEN 0 THEN 'verified' WHEN 1 THEN 'low_quality' ELSE 'unverified' END AS tier FROM documents),
  n AS (SELECT *, CASE origin WHEN 'pdf' THEN '📄【文档资料】' || doc || CASE WHEN page > 0 THEN '，第' || page || '页' ELSE '' END || ' | 置信权重: ' || w || CASE WHEN w = '0.9' THEN ' (高置信度)' ELSE ' (中置信度)' END
    WHEN 'web' THEN '🌐【公开网络信息】' || url || ' | 置信权重: ' || w || ' (中置信度)' || CASE tier WHEN 'unverified' THEN ' | ⚠️ 未经验证，仅供交叉验证' WHEN 'low_quality' THEN ' | ❌ 低质量来源，禁止引用' ELSE '' END ELSE '' END AS note FROM c),
  p AS (SELECT task_id, string_agg('【S' || (ord + 1) || '】(' || note || CASE WHEN tier <> 'verified' THEN ' trust_tier=' || tier ELSE '' END || ')' || chr(10) || substring(text, 1, 1200), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY ord) AS text FROM n GROUP BY task_id)"""


def _conflicts(spark, sf_dir):
    """Conflicts made from parts: six a task."""
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(F.floor(k / 6).alias("task_id"), (k % 6).alias("ord"), F.col("p_brand").alias("topic"), F.when(k % 6 == 1, "consistent").otherwise("conflict").alias("status"), F.col("p_name").alias("pdf_statement"), F.col("p_type").alias("web_statement"), F.lit("r").alias("resolution"))


CONFLICTS = """k AS (SELECT p_partkey // 6 AS task_id, p_partkey % 6 AS ord, p_brand AS topic, p_partkey % 6 <> 1 AS conflict, p_name AS a, p_type AS b FROM part)"""


@query(f"""WITH {CITED}, {CONFLICTS}, h AS (SELECT task_id, '【信源冲突说明】以下素材中存在信息冲突：' || chr(10) || string_agg(CASE WHEN conflict THEN '🔴 冲突主题「' || topic || '」：' || chr(10) || '  📄【内部文档】' || a || chr(10) || '  🌐【公开网络】' || b || chr(10) || '  ⚖️ 处理：r' ELSE '🟢 一致主题「' || topic || '」：' || a END, chr(10) ORDER BY ord) || chr(10) || '---' AS head FROM k GROUP BY task_id)
SELECT task_id, CASE WHEN head IS NULL THEN text ELSE head || chr(10) || chr(10) || '---' || chr(10) || chr(10) || text END AS text FROM p LEFT JOIN h USING (task_id)""")
def cited_prompt(spark, sf_dir):
    return prompts.material_prompt(_cited(spark, sf_dir), _conflicts(spark, sf_dir))


@query(f"""WITH {CONFLICTS} SELECT task_id, '## 信源冲突预警' || chr(10) || chr(10) || chr(10) || string_agg(CASE WHEN conflict THEN '🔴 **冲突预警 — ' || topic || '**' || chr(10) || chr(10) || '- 📄 **内部文档观点**: ' || a || chr(10) || chr(10) || '- 🌐 **外网公开信息**: ' || b || chr(10) || chr(10) || '- ⚖️ **处理方式**: r'
  ELSE '🟢 **信息一致 — ' || topic || '**' || chr(10) || chr(10) || '- ' || a END || chr(10) || chr(10) || chr(10) || '---' || chr(10), chr(10) ORDER BY ord) AS text FROM k GROUP BY task_id""")
def conflict_alerts(spark, sf_dir):
    return prompts.conflict_section(_conflicts(spark, sf_dir))


@query("""SELECT p_partkey AS id, '【== ' || p_name || ' ==】 [证据: S1, S2]' || chr(10) || '  核心论点: ' || p_type || chr(10) || '  - ' || p_brand || ' [证据: S' || p_size || ']' || chr(10) || '    论点: x' || chr(10) || '    段落规划: y' || chr(10) || '  - z' || chr(10) || '  【= t =】' AS text FROM part""")
def outline_text(spark, sf_dir):
    parts = read(spark, sf_dir, "part")
    sub = F.struct(F.lit(2).alias("level"), F.col("p_brand").alias("title"), F.lit("x").alias("argument"), F.array(F.concat(F.lit("S"), "p_size")).alias("evidence_indices"), F.lit("y").alias("paragraph_plan"))
    bare = F.struct(F.lit(2).alias("level"), F.lit("z").alias("title"), F.lit("").alias("argument"), F.array().cast("array<string>").alias("evidence_indices"), F.lit("").alias("paragraph_plan"))
    section = F.struct(F.lit(1).alias("level"), F.col("p_name").alias("title"), F.col("p_type").alias("main_argument"), F.array(F.lit("S1"), F.lit("S2")).alias("supporting_evidence"), F.array(sub, bare).alias("subsections"))
    return parts.select(F.col("p_partkey").alias("id"), prompts.outline_text(F.concat(F.lit("["), F.to_json(section), F.lit(', {"level": 2, "title": "t"}]'))).alias("text"))


@query("""SELECT page_id, CASE WHEN page_id % 7 = 0 THEN html ELSE '[' || 'p' || page_id || '](' || url || ')' || chr(10) || html END AS entry FROM pages""")
def web_entries(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    title = F.when(F.col("page_id") % 7 != 0, F.concat(F.lit("p"), "page_id"))
    return pages.select("page_id", prompts.web_entry(title, F.col("url"), F.col("html")).alias("entry"))


@query(f"""WITH {BM25}, t AS (SELECT * FROM (SELECT *, {RANKED} AS rank FROM bm) WHERE rank <= 10), d AS (SELECT t.*, lang = 'en' AS inner_, '[' || source || ' - 页 ' || rank || '] ' || text AS x FROM t JOIN documents USING (doc_id)),
  w AS (SELECT item_id, '【网络搜索结果】' || chr(10) || string_agg(x, chr(10) || chr(10) ORDER BY rank) AS a FROM d WHERE NOT inner_ GROUP BY 1), p AS (SELECT item_id, '【PDF 参考材料】' || chr(10) || string_agg(x, ' | ' ORDER BY rank) AS b FROM d WHERE inner_ GROUP BY 1)
SELECT item_id AS task_id, concat_ws(chr(10) || chr(10), a, b) AS text FROM w FULL JOIN p USING (item_id)""")
def merged_sections(spark, sf_dir):
    from siftline.operators import retrieve

    docs, items = read(spark, sf_dir, "documents", "benchmark")
    hits = retrieve.bm25_topk(docs, items).join(docs.select("doc_id", "source", "lang", "text"), "doc_id")
    return prompts.merged_sections(hits.select(F.col("item_id").alias("task_id"), F.col("rank").alias("ord"), F.when(F.col("lang") == "en", "pdf").otherwise("web").alias("origin"), prompts.tagged(F.col("source"), F.col("rank"), F.col("text")).alias("text")))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'plain ' || o_orderkey WHEN 1 THEN 'c' || o_orderkey WHEN 2 THEN 'a b' || o_orderkey WHEN 3 THEN 't' || o_orderkey ELSE '{broken' END AS text FROM orders""")
def message_text(spark, sf_dir):
    k = F.col("o_orderkey")
    answer = F.when(k % 5 == 0, F.concat(F.lit("plain "), k)).when(k % 5 == 1, F.concat(F.lit('{"content": "c'), k, F.lit('"}'))).when(k % 5 == 2, F.concat(F.lit('{"content": [{"text": "a"}, {"text": "b'), k, F.lit('"}]}'))).when(k % 5 == 3, F.concat(F.lit('{"text": "t'), k, F.lit('"}'))).otherwise("{broken")
    return read(spark, sf_dir, "orders").select(k.alias("id"), prompts.message_text(answer).alias("text"))


KEYS = ["结论", "z", "title", "摘要", "市场规模", "a", "建议", "空"]


@query("""WITH s AS (SELECT o_custkey AS report_id, unnest(['结论', 'z', 'title', '摘要', '市场规模', 'a', '建议', '空']) AS key, unnest(['1', '2', '3', '4', '5', '6', '7', '']) AS body, unnest([13, 99, 0, 1, 6, 99, 14, 0]) AS o FROM (SELECT DISTINCT o_custkey FROM orders))
SELECT report_id, CAST(row_number() OVER (PARTITION BY report_id ORDER BY o, key) AS INTEGER) AS place, key, body FROM s WHERE o > 0""")
def section_order(spark, sf_dir):
    reports = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("report_id")).distinct()
    rows = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(b).alias("body")) for k, b in zip(KEYS, ["1", "2", "3", "4", "5", "6", "7", ""], strict=True)))
    return prompts.ordered_sections(reports.select("report_id", F.inline(rows)))


@query(f"""WITH {BM25}, t AS (SELECT *, {RANKED} AS rank FROM bm), l AS (SELECT item_id, doc_id, CAST(rank AS INTEGER) AS rank, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 11 END AS relevance FROM t WHERE rank <= 10),
  r AS (SELECT *, CAST(coalesce(relevance, 5) AS INTEGER) AS rerank_score, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(relevance, 5) DESC, rank) AS n FROM l) SELECT item_id, doc_id, rank, relevance, rerank_score, CAST(n AS INTEGER) AS rerank_rank FROM r WHERE n <= 5""")
def rerank_scores(spark, sf_dir):
    from siftline.operators import retrieve

    hits = retrieve.bm25_topk(*read(spark, sf_dir, "documents", "benchmark"))
    return prompts.scored(hits.select("item_id", "doc_id", "rank", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 11).alias("relevance")))
