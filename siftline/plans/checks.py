"""Queries of validation, report checks and anchors, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import text as T
from siftline.operators import checking, clean, evidence, retrieve, validation
from siftline.plans.queries import NUMBERS, query, read
from siftline.sources import tables


@query()
def layer1_filter(spark, sf_dir):
    """Chunks of each item's three best documents against the item, their document and each other."""
    docs, items = read(spark, sf_dir, "documents", "benchmark")
    hits = retrieve.bm25_topk(docs, items, 3).select(F.col("item_id").alias("task_id"), "doc_id", "rank")
    found = docs.join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    tasks = items.select(F.col("item_id").alias("task_id"), F.col("text").alias("task"))
    chunks = clean.strided(found).join(hits, "doc_id").join(tasks, "task_id")
    order = F.col("rank").cast("long") * 1_000_000 + F.col("chunk_no")
    return validation.layer1(chunks.select("task_id", order.alias("ord"), "text", "task", F.col("doc_id").alias("source_id")), found.select(F.col("doc_id").alias("source_id"), F.col("text").alias("source")))


@query()
def layer1_stats(spark, sf_dir):
    return validation.stats(layer1_filter(spark, sf_dir))


@query("""SELECT doc_id, CASE lang WHEN 'en' THEN text WHEN 'de' THEN CASE WHEN doc_id % 3 = 0 THEN 'page' WHEN doc_id % 3 = 1 THEN 'snippet' ELSE text END ELSE text END AS source FROM documents""")
def source_lookup(spark, sf_dir):
    """English documents count as internal, German ones as from the web, with a page, a snippet or neither."""
    docs, d = read(spark, sf_dir, "documents"), F.col("doc_id")
    origin = F.when(F.col("lang") == "en", "pdf").when(F.col("lang") == "de", "web").otherwise("other")
    page, snippet = F.when(d % 3 == 0, "page").otherwise(""), F.when(d % 3 == 1, "snippet")
    return docs.select("doc_id", validation.source_of(origin, F.col("text"), F.col("text"), page, snippet).alias("source"))


@query("""WITH m AS (SELECT lang, string_agg(coalesce(text, ''), ' ' ORDER BY doc_id) AS t FROM documents GROUP BY lang), s AS (SELECT lang, item_id AS pos, text AS sub_query, trim(substring(text, 1, 20)) AS k FROM benchmark, (SELECT DISTINCT lang FROM documents)),
  f AS (SELECT s.*, row_number() OVER (PARTITION BY lang ORDER BY pos) AS n FROM s JOIN m USING (lang) WHERE length(k) = 0 OR (length(t) - length(replace(t, k, ''))) / length(k) < 2)
SELECT lang AS task_id, pos, sub_query FROM f WHERE n <= 2""")
def missing_topics(spark, sf_dir):
    """The languages as tasks, the items as their sub-topics."""
    docs, items = read(spark, sf_dir, "documents", "benchmark")
    langs = docs.select(F.col("lang").alias("task_id")).distinct()
    subs = items.crossJoin(langs).select("task_id", F.col("item_id").alias("pos"), F.col("text").alias("sub_query"))
    found = validation.missing_topics(subs, docs.select(F.col("lang").alias("task_id"), F.col("doc_id").alias("ord"), "text"))
    try:
        return tables.written(found, "topics")
    finally:
        tables.delete(spark, found.path)


CHECKS = f"""{NUMBERS}, chk AS (SELECT id AS report_id, number, length(number) % 3 <> 0 AS found FROM num)"""


def _checks(spark, sf_dir):
    numbers = evidence.report_numbers(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return numbers.select(F.col("id").alias("report_id"), "ord", "number", (F.length("number") % 3 != 0).alias("found"))


@query(f"""WITH {CHECKS} SELECT report_id, count(*) AS total, count(*) FILTER (found) AS found, count(*) FILTER (NOT found) AS not_found, round(count(*) FILTER (NOT found) * 100 / count(*), 1) AS issue_ratio, bool_and(found) AS passed FROM chk GROUP BY report_id""")
def number_totals(spark, sf_dir):
    return checking.totals(_checks(spark, sf_dir)).drop("rewrite_scope")


REPORT = """'{"关键发现": [' || CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN '{"观点": "甲' || o_orderkey || '", "证据": ["a", "b"]}' WHEN 2 THEN '{"观点": "甲' || o_orderkey || '"}, {"观点": "乙", "evidence": ["c"]}' ELSE '{"观点": "丙", "证据": []}, {"观点": "丁' || o_orderkey || '", "证据": ["x", "y", "z"]}' END || ']' || CASE WHEN o_orderkey % 5 = 0 THEN ', "key_findings": [{"evidence": ["p", "q"]}]' ELSE '' END || '}'"""


def _reports(spark, sf_dir):
    return read(spark, sf_dir, "orders").selectExpr("o_orderkey AS report_id", "o_orderkey % 5 AS k", f"{REPORT} AS report")


@query("""SELECT o_orderkey AS report_id, [2, 2, 1, 3, 3][CAST(o_orderkey % 5 + 1 AS INTEGER)] AS n, CASE o_orderkey % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 ELSE 0.5 END::DOUBLE AS ratio FROM orders""")
def report_evidence(spark, sf_dir):
    """Evidence items, and the share of findings that hold a critical sentence (the one with the report's number)."""
    sentence = F.concat(F.lit("甲"), "report_id")
    issue = lambda s, impact: F.struct(s.alias("sentence"), F.lit(impact).alias("impact"))
    issues = F.array(issue(sentence, "critical"), issue(F.concat(F.lit("丁"), "report_id"), "critical"), issue(F.lit("乙"), "minor"), issue(F.lit(""), "critical"))
    return _reports(spark, sf_dir).select("report_id", checking.evidence_count(F.col("report")).alias("n"), checking.critical_ratio(F.col("report"), issues).alias("ratio"))


ISSUES = ["无来源支撑", "锚点不存在", "与素材矛盾", "表述夸大"]


@query("""WITH k AS (SELECT o_orderkey AS k, ['无来源支撑', '锚点不存在', '与素材矛盾', '表述夸大'][CAST(o_orderkey % 4 + 1 AS INTEGER)] AS issue, o_orderkey % 3 = 0 AS found FROM orders)
SELECT k AS id, CASE WHEN k % 4 < 2 THEN '无来源支撑（锚点不存在）' ELSE issue END AS issue, CASE WHEN k % 4 < 2 THEN '丢弃（无证据锚点）' WHEN k % 4 = 2 AND NOT found THEN '丢弃（无法锚定矛盾证据）' ELSE '改' END AS suggestion,
  CASE WHEN k % 4 = 2 AND found THEN '原文' ELSE '' END AS evidence_anchor FROM k WHERE NOT (k % 4 < 2 AND found)""")
def anchored_issues(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(k.alias("id"), F.element_at(F.array(*map(F.lit, ISSUES)), (k % 4 + 1).cast("int")).alias("issue"), F.lit("改").alias("suggestion"), F.when(k % 3 == 0, "原文").alias("anchor"))
    return checking.anchored_issues(rows)


@query("""SELECT o_custkey AS id, count(*) FILTER (o_orderkey % 4 IN (0, 2)) AS severe, count(*) FILTER (o_orderkey % 4 IN (0, 2)) = 0 AS passed FROM orders GROUP BY o_custkey""")
def severe_issues(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select("o_custkey", F.element_at(F.array(*map(F.lit, ISSUES)), (k % 4 + 1).cast("int")).alias("issue")).groupBy("o_custkey").agg(F.collect_list("issue").alias("issues"))
    return rows.select(F.col("o_custkey").alias("id"), checking.passes(F.col("issues")).alias("p")).select("id", F.col("p.severe").cast("long").alias("severe"), "p.passed")


MATERIALS = """'总额' || c_custkey || '万元，占' || (c_custkey % 90 + 10) || '%，另有' || (c_custkey * 3) || '.50亿'"""
FIXES = f"""w AS (SELECT o_orderkey AS ord, o_custkey AS report_id, (o_custkey + o_orderkey % 3) || '元' AS number FROM orders),
  m AS (SELECT c_custkey AS report_id, unnest(regexp_extract_all({MATERIALS}, '\\d+\\.?\\d*[万亿千百十万%年]*')) AS token, generate_subscripts(regexp_extract_all({MATERIALS}, '\\d+\\.?\\d*[万亿千百十万%年]*'), 1) AS p FROM customer),
  f AS (SELECT report_id, regexp_extract(token, '\\d+\\.?\\d*', 0) AS run, arg_min(token, p) AS correct FROM m GROUP BY ALL),
  x AS (SELECT w.*, correct FROM w LEFT JOIN f ON w.report_id = f.report_id AND regexp_extract(number, '\\d+\\.?\\d*', 0) = run)"""


def _wrong(spark, sf_dir):
    orders, customer = read(spark, sf_dir, "orders", "customer")
    wrong = orders.select(F.col("o_custkey").cast("long").alias("report_id"), F.col("o_orderkey").alias("ord"), F.concat((F.col("o_custkey") + F.col("o_orderkey") % 3).cast("string"), F.lit("元")).alias("number"))
    return wrong, customer.selectExpr("CAST(c_custkey AS BIGINT) AS report_id", "0 AS ord", f"{MATERIALS} AS text")


@query(f"WITH {FIXES} SELECT report_id, ord, number, correct FROM x")
def number_corrections(spark, sf_dir):
    return checking.corrections(*_wrong(spark, sf_dir))


@query(f"""WITH {FIXES}, g AS (SELECT report_id, arg_min({{'n': number, 'c': correct}}, ord) AS one FROM x WHERE correct IS NOT NULL AND correct <> number GROUP BY 1)
SELECT report_id, CASE WHEN one IS NULL THEN '共 ' || report_id || '元 与 ' || report_id || '元' ELSE '共 ' || one.c || ' 与 ' || report_id || '元' END AS text FROM (SELECT DISTINCT report_id FROM w) LEFT JOIN g USING (report_id)""")
def repaired_report(spark, sf_dir):
    """Reports whose nested text names their own number twice; the first is corrected."""
    wrong, materials = _wrong(spark, sf_dir)
    one = wrong.where(F.col("number") == F.concat(F.col("report_id").cast("string"), F.lit("元"))).dropDuplicates(["report_id", "number"])
    reports = wrong.select("report_id").distinct().selectExpr("report_id", """concat('{"a": [{"b": "共 ', report_id, '元 与 ', report_id, '元"}, 1, null]}') AS report""")
    fixed = checking.repaired_reports(reports, one, materials)
    return fixed.select("report_id", F.get_json_object("report", "$.a[0].b").alias("text"))


ANCHORS = r"""c AS (SELECT item_id, regexp_replace(regexp_replace(text, '^[\s"''「」『』]+', ''), '[\s"''「」『』]+$', '') AS s FROM benchmark),
  q AS (SELECT *, regexp_replace(s, '[，。！？、；："''（）【】\[\]{}《》\s]', '', 'g') AS bare, trim(substring(s, 1, 20)) AS head, list_filter(regexp_split_to_array(s, '[，。！？、；：,.!?;:\s]+'), lambda x: length(x) >= 5) AS p0,
    list_sort(list_distinct(list_concat(list_concat(regexp_extract_all(s, '[-+]?\d+\.?\d*[万亿千百十]?'), regexp_extract_all(s, '\d+\.?\d*%')), list_concat(regexp_extract_all(s, '(?:19|20)\d{2}年?'), regexp_extract_all(s, '["「」『』]([^"「」『』]{3,50})["「」『』]', 1))))) AS ents FROM c),
  h AS (SELECT *, CASE WHEN len(p0) < 2 AND length(s) > 10 THEN [left(s, length(s) // 2), substring(s, length(s) // 2 + 1)] ELSE p0 END AS parts FROM q WHERE length(s) >= 5),
  d AS (SELECT doc_id, text AS m, regexp_replace(text, '[，。！？、；："''（）【】\[\]{}《》\s]', '', 'g') AS bm FROM documents),
  f AS (SELECT item_id, doc_id, CASE WHEN contains(m, s) THEN 1 WHEN length(bare) >= 5 AND contains(bm, bare) THEN 2 WHEN len(list_filter(parts, lambda x: contains(m, x))) >= 2 THEN 3 WHEN length(head) >= 6 AND contains(m, head) THEN 4 WHEN len(list_filter(ents, lambda x: length(x) >= 3 AND contains(m, x))) > 0 THEN 5 END AS r FROM h, d),
  b AS (SELECT item_id, min(r * 1000000000::BIGINT + doc_id) AS best FROM f WHERE r IS NOT NULL GROUP BY item_id)"""


@query(f"WITH {ANCHORS} SELECT item_id, ['exact', 'no punctuation', 'segments', 'head', 'entity'][CAST(best // 1000000000 AS INTEGER)] AS method, best % 1000000000 AS doc_id FROM b")
def evidence_anchor(spark, sf_dir):
    docs, items = read(spark, sf_dir, "documents", "benchmark")
    return evidence.anchors(items, docs)


@query(f"WITH {ANCHORS} SELECT item_id, best IS NOT NULL AS matched, CASE WHEN best IS NULL THEN 0.0 WHEN best // 1000000000 = 5 THEN 0.9 ELSE 1.0 END::DOUBLE AS similarity, CASE WHEN best IS NULL THEN 'none' WHEN best // 1000000000 = 5 THEN 'entity' ELSE 'exact' END AS match_method FROM benchmark LEFT JOIN b USING (item_id)")
def anchor_report(spark, sf_dir):
    items = read(spark, sf_dir, "benchmark")
    found = items.select("item_id").join(evidence_anchor(spark, sf_dir), "item_id", "left")
    return found.select("item_id", checking.anchor_report(F.col("method")).alias("r")).select("item_id", "r.*")


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(q.v, e.v) AS c FROM e q, e WHERE q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sqrt(greatest(2 - 2 * c, 0)), 6), vec_id) AS n FROM p) SELECT query_id, vec_id, round(c, 5) AS cosine FROM r WHERE n = 1 AND c >= 0.3""")
def semantic_match(spark, sf_dir):
    """All stored vectors but the query's own, which would be the answer to each; the
    least cosine fits these vectors."""
    vectors = read(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return evidence.semantic_matches(vectors, asked, 0.3, others=True).select("query_id", "vec_id", F.round("cosine", 5).alias("cosine"))


@query(r"""SELECT doc_id, CASE WHEN w > 0 THEN (CASE WHEN b > 1 THEN '...' ELSE '' END) || substring(text, b, e - b + 1) || (CASE WHEN e < length(text) THEN '...' ELSE '' END) ELSE '' END AS around
FROM (SELECT doc_id, text, w, greatest(1, w - 80) AS b, least(length(text), w + 1 + 80) AS e FROM (SELECT doc_id, text, instr(text, 'th') AS w FROM documents))""")
def context_window(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.context(F.col("text"), F.lit("th"), 80).alias("around"))


@query(r"""WITH p AS (SELECT doc_id, text, instr(text, 'the') AS w FROM documents), s AS (SELECT doc_id, text, w, coalesce(regexp_extract(left(text, w - 1), '(?s)^.*[。！？\n]', 0), '') AS pre FROM p),
  e AS (SELECT *, [instr(substring(text, w), x) FOR x IN ['。', '！', '？', chr(10)]] AS ends FROM s)
SELECT doc_id, CASE WHEN w = 0 THEN '' ELSE trim(substring(text, length(pre) + 1, CASE WHEN list_min(ends) = 0 THEN least(length(text), w + 2 + 80) ELSE w - 1 + list_min(ends) END - length(pre))) END AS sentence FROM e""")
def enclosing_sentence(spark, sf_dir):
    from siftline.functions import report

    return read(spark, sf_dir, "documents").select("doc_id", report.sentence_about(F.col("text"), F.lit("the")).alias("sentence"))


