"""Queries of web results and their pages, with their SQL. Searches are dealt from the
pages: eight pages a task, five in its first round or three, the others in the second."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.operators import web
from siftline.plans.queries import TIER_LOW, TIER_TRUSTED, query, read


def _hits(spark, sf_dir):
    p, task = F.col("page_id"), F.floor(F.col("page_id") / 8)
    first = F.when(task % 2 == 0, 5).otherwise(3)
    url = F.when(p % 11 == 0, "").when(p % 13 == 0, F.concat(F.lit("http://spam-farm/"), p)).otherwise(F.col("url"))
    return read(spark, sf_dir, "pages").select(task.alias("task_id"), F.when(p % 8 < first, 1).otherwise(2).alias("round"), F.when(p % 8 < first, p % 8).otherwise(p % 8 - first).alias("pos"), url.alias("url"), F.col("html").alias("content"))


def _chunks(spark, sf_dir):
    """Every page in pieces of 500 characters."""
    piece = lambda i: F.struct(i.alias("chunk_no"), F.substring(F.col("html"), 500 * i + 1, F.lit(500)).alias("text"))
    last = F.floor(F.greatest(F.length("html") - 1, F.lit(0)) / 500).cast("int")
    return read(spark, sf_dir, "pages").select("url", F.inline(F.transform(F.sequence(F.lit(0), last), piece)), F.when(F.col("page_id") % 2 == 0, "full_html").otherwise("cleaned").alias("fetch_status"))


HITS = """h AS (SELECT page_id // 8 AS task_id, CASE WHEN page_id % 8 < (CASE WHEN page_id // 8 % 2 = 0 THEN 5 ELSE 3 END) THEN 1 ELSE 2 END AS round, page_id % 8 AS p8,
    CASE WHEN page_id % 11 = 0 THEN '' WHEN page_id % 13 = 0 THEN 'http://spam-farm/' || page_id ELSE url END AS url, html AS content FROM pages),
  n AS (SELECT task_id, count(*) FILTER (round = 1) AS first FROM h GROUP BY 1),
  s AS (SELECT h.*, CASE WHEN round = 1 THEN p8 ELSE p8 - (CASE WHEN task_id % 2 = 0 THEN 5 ELSE 3 END) END AS pos FROM h JOIN n USING (task_id) WHERE round = 1 OR first < 5),
  f AS (SELECT task_id, CAST(round AS INTEGER) AS search_round, pos AS source_index, url AS source_url, substring(content, 1, 800) AS text, substring(content, 1, 200) AS source_snippet,
    CASE WHEN ends_with(lower(regexp_extract(url, '://([^/?#]*)', 1)), 'example.org') THEN 'verified' ELSE 'unverified' END AS trust_tier FROM s WHERE NOT contains(url, 'spam-farm') AND NOT contains(url, 'cheap-pills')),
  r AS (SELECT *, CASE trust_tier WHEN 'verified' THEN 0.7 ELSE 0.5 END::DOUBLE AS score, row_number() OVER (PARTITION BY task_id ORDER BY search_round, source_index) AS place FROM f)"""


def _results(spark, sf_dir):
    return web.results(_hits(spark, sf_dir), TIER_TRUSTED, TIER_LOW)


@query(f"WITH {HITS} SELECT * FROM r")
def web_results(spark, sf_dir):
    return _results(spark, sf_dir)


PAGES = """c AS (SELECT url AS source_url, unnest(range(0, greatest(length(html) - 1, 0) // 500 + 1)) AS i, html, CASE WHEN page_id % 2 = 0 THEN 'full_html' ELSE 'cleaned' END AS st FROM pages),
  k AS (SELECT task_id, source_url, count(*) AS times FROM r WHERE place <= 5 AND source_url <> '' GROUP BY ALL),
  o AS (SELECT task_id, source_url, times, list({'i': i, 't': substring(html, 500 * i + 1, 500), 's': st} ORDER BY i, substring(html, 500 * i + 1, 500), st) AS l FROM k JOIN c USING (source_url) GROUP BY ALL),
  g AS (SELECT task_id, source_url, l[1].s AS st, len(l) * times AS n_chunks, array_to_string(flatten(list_transform(generate_series(1, times), lambda x: list_transform(l, lambda y: y.t))), chr(10) || chr(10)) AS full_text FROM o),
  w AS (SELECT r.task_id, search_round, source_index, r.source_url, CASE WHEN length(full_text) > length(text) THEN substring(full_text, 1, 8000) ELSE text END AS text, source_snippet, trust_tier, score, place, coalesce(n_chunks, 0) AS n_chunks, coalesce(st, 'fallback') AS fetch_status,
    CASE WHEN length(full_text) > length(text) THEN full_text END AS cleaned_full_text FROM r LEFT JOIN g ON r.task_id = g.task_id AND r.source_url = g.source_url)"""


@query(f"WITH {HITS}, {PAGES} SELECT * FROM w")
def web_results_with_pages(spark, sf_dir):
    return web.with_pages(_results(spark, sf_dir), _chunks(spark, sf_dir))


@query(f"WITH {HITS}, {PAGES} SELECT task_id, count(*) FILTER (fetch_status IN ('full_html', 'cleaned')) AS cleaned, count(*) FILTER (fetch_status = 'fallback') AS fallback, CAST(sum(n_chunks) AS BIGINT) AS total_chunks FROM w GROUP BY task_id")
def web_fetch_counts(spark, sf_dir):
    return web.fetch_counts(web_results_with_pages(spark, sf_dir))


@query(f"WITH {HITS}, d AS (SELECT task_id, url FROM h WHERE round = 1 AND url <> '') SELECT task_id, CAST(round AS INTEGER) AS round, url, content FROM h WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.task_id = h.task_id AND d.url = h.url)")
def web_unseen(spark, sf_dir):
    """The hits of all rounds whose url the task's first round doesn't have."""
    hits = _hits(spark, sf_dir)
    return web.unseen(hits, hits.where("round = 1")).select("task_id", "round", "url", "content")


@query("""WITH k AS (SELECT o_orderkey AS k FROM orders) SELECT k AS id, k % 4 NOT IN (1, 3) AND k % 3 < 2 AND k % 5 < 2 AND k % 7 > 0 AS again FROM k""")
def second_search(spark, sf_dir):
    k = F.col("o_orderkey")
    mode = F.element_at(F.array(*map(F.lit, ("auto", "disabled", "web-only", "PDF_ONLY"))), (k % 4 + 1).cast("int"))
    return read(spark, sf_dir, "orders").select(k.alias("id"), web.second_search(k % 5, k % 3, mode, k % 7).alias("again"))


@query("""WITH p AS (SELECT page_id, html, regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1) AS head FROM pages)
SELECT page_id, CASE WHEN length(head) >= 50 THEN 'full_html' WHEN length(html) > 50 THEN 'fallback' END AS fetch_status, CASE WHEN length(head) >= 50 THEN head WHEN length(html) > 50 THEN html END AS text FROM p""")
def snippet_fallback(spark, sf_dir):
    """The first heading of a page, or the page itself where that is too short."""
    pages = read(spark, sf_dir, "pages")
    text = F.regexp_extract("html", "<h1[^>]*>([^<]*)</h1>", 1)
    return pages.select("page_id", web.snippet_or_page(text, F.col("html")).alias("s")).select("page_id", "s.fetch_status", "s.text")
