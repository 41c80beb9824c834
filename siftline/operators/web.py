"""Web results: rounds of a search, trust, pages that belong to them, and second
searches. Results are rows (task_id, round, pos, url, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.operators.rules import trust_tier

# Characters of a result's text, of its snippet, and of a page's text;
# results that end a search; pages that are cleaned a task; scores by trust.
TEXT, SNIPPET, PAGE_TEXT, ENOUGH, PAGES, VERIFIED_SCORE, OTHER_SCORE = 800, 200, 8000, 5, 5, 0.7, 0.5


def results(hits: DataFrame, trusted: list[str], low: list[str]) -> DataFrame:
    """Hits as results, without those of low quality: (task_id, search_round,
    source_index, source_url, text, source_snippet, score, trust_tier, place).

    A round's hits count only if all rounds before it gave fewer than ENOUGH; place
    is the dense order of a task's results."""
    n = hits.groupBy("task_id", "round").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("task_id").orderBy("round").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    searched = hits.join(n.withColumn("before", before).where(F.col("before") < ENOUGH).select("task_id", "round"), ["task_id", "round"], "left_semi")
    content = F.coalesce("content", F.lit(""))
    out = searched.select(
        "task_id", F.col("round").alias("search_round"), F.col("pos").alias("source_index"), F.coalesce("url", F.lit("")).alias("source_url"),
        F.substring(content, 1, TEXT).alias("text"), F.substring(content, 1, SNIPPET).alias("source_snippet"), trust_tier(F.col("url"), trusted, low).alias("trust_tier"),
    ).where("trust_tier <> 'low_quality'")
    score = F.when(F.col("trust_tier") == "verified", VERIFIED_SCORE).otherwise(OTHER_SCORE)
    return out.withColumn("score", score).withColumn("place", F.row_number().over(Window.partitionBy("task_id").orderBy("search_round", "source_index")).cast("long"))


def unseen(hits: DataFrame, known: DataFrame) -> DataFrame:
    """Hits whose url none of the known (task_id, url) of their task has; hits without
    a url are new."""
    seen = known.where(F.coalesce("url", F.lit("")) != "").select("task_id", "url").distinct()
    return hits.join(seen, ["task_id", "url"], "left_anti")


def cleaned_pages(found: DataFrame, chunks: DataFrame, most: int = PAGES) -> DataFrame:
    """(task_id, source_url, chunks, fetch_status, full_text) of the urls of a task's
    first ``most`` results (those without a url count). ``chunks`` has (url, chunk_no,
    text, fetch_status); a url that a task names twice has its chunks twice."""
    asked = found.where((F.col("place") <= most) & (F.col("source_url") != "")).groupBy("task_id", "source_url").agg(F.count("*").alias("times"))
    joined = asked.join(chunks.withColumnRenamed("url", "source_url"), "source_url")
    ordered = joined.groupBy("task_id", "source_url", "times").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "text", "fetch_status"))).alias("c"))
    repeated = F.flatten(F.array_repeat("c", F.col("times").cast("int")))
    return ordered.select("task_id", "source_url", repeated.alias("chunks"), F.col("c")[0]["fetch_status"].alias("fetch_status"), F.array_join(F.transform(repeated, lambda x: x["text"]), "\n\n").alias("full_text"))


def with_pages(found: DataFrame, chunks: DataFrame, most: int = PAGES) -> DataFrame:
    """Results with n_chunks, fetch_status (``fallback`` without a page) and the text
    of their pages where that is longer than their own, at most PAGE_TEXT characters
    of it; cleaned_full_text is the whole of it, else null."""
    pages = cleaned_pages(found, chunks, most)
    both = found.join(pages, ["task_id", "source_url"], "left")
    longer = F.length("full_text") > F.length("text")
    return both.select(
        *found.columns[: found.columns.index("text")], F.when(longer, F.substring("full_text", 1, PAGE_TEXT)).otherwise(F.col("text")).alias("text"), *found.columns[found.columns.index("text") + 1 :],
        F.coalesce(F.size("chunks"), F.lit(0)).cast("long").alias("n_chunks"), F.coalesce("fetch_status", F.lit("fallback")).alias("fetch_status"), F.when(longer, F.col("full_text")).alias("cleaned_full_text"),
    )


def fetch_counts(found: DataFrame) -> DataFrame:
    """(task_id, cleaned, fallback, total_chunks) of results with their pages."""
    return found.groupBy("task_id").agg(F.count_if(F.col("fetch_status").isin("full_html", "cleaned")).alias("cleaned"), F.count_if(F.col("fetch_status") == "fallback").alias("fallback"), F.sum("n_chunks").alias("total_chunks"))


def second_search(passed: Column, retries: Column, mode: Column, missing: Column) -> Column:
    """Whether a task searches again: fewer than two passed, fewer than two retries
    so far, a mode with the web, and a missing sub-topic."""
    from siftline.operators.rules import search_mode

    return (search_mode(mode) != "pdf_only") & (retries < 2) & (passed < 2) & (missing > 0)


def snippet_or_page(text: Column, fallback: Column, least: int = 50) -> Column:
    """struct(text, fetch_status): a page's text, or a snippet where that is too short;
    null where both are."""
    made = lambda t, status: F.struct(t.alias("text"), F.lit(status).alias("fetch_status"))
    return F.when(F.length(text) >= least, made(text, "full_html")).when(F.length(fallback) > least, made(fallback, "fallback"))
