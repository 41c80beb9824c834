"""Search responses as rows, a registry of providers, and a cache by content.

No provider here uses a network: those that need one are registered by the caller."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HIT = "array<struct<title:string,url:string,link:string,href:string,content:string,body:string,snippet:string>>"
_providers: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register(name: str, search: Callable[[DataFrame], DataFrame]) -> None:
    """``search`` maps (query_id, query) rows to hits."""
    _providers[name.lower()] = search


def provider(name: str) -> Callable[[DataFrame], DataFrame]:
    if name.lower() not in _providers:
        raise ValueError(f"no search provider {name}")
    return _providers[name.lower()]


def normalised_hits(responses: DataFrame, source: str, most: int = 5) -> DataFrame:
    """(query_id, pos, title, url, content, snippet, source) of JSON responses: a list,
    or an object with ``results`` or ``organic_results``; at most ``most`` each."""
    nested = F.from_json("response", f"struct<results:{HIT},organic_results:{HIT}>")
    hits = F.coalesce(nested["results"], nested["organic_results"], F.from_json("response", HIT))
    rows = responses.select("query_id", F.posexplode(F.slice(hits, 1, most)).alias("pos", "h"))
    empty = lambda *names: F.coalesce(*(F.nullif(F.col(f"h.{n}"), F.lit("")) for n in names), F.lit(""))
    content = empty("content", "body", "snippet")
    return rows.select("query_id", "pos", empty("title").alias("title"), empty("url", "link", "href").alias("url"), content.alias("content"), F.substring(content, 1, 200).alias("snippet"), F.lit(source).alias("source"))


def uncached(docs: DataFrame, cache: DataFrame) -> DataFrame:
    """The documents whose content isn't in the cache (key: md5 of the text)."""
    return docs.withColumn("key", F.md5(F.col("text").cast("binary"))).join(cache.select("key").distinct(), "key", "left_anti")


def fetched(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """(url, html, fetch_status): pages by url, null where none could be had."""
    return urls.join(pages.select("url", "html").dropDuplicates(["url"]), "url", "left").withColumn("fetch_status", F.when(F.col("html").isNull(), "failed").otherwise("ok"))


def unified(internal: DataFrame, web: DataFrame, least: int = 20) -> DataFrame:
    """Both origins' chunks (id, text) in one table, without the shortest."""
    tag = lambda df, origin: df.select("id", "text", F.lit(origin).alias("origin"))
    return tag(internal, "pdf").unionByName(tag(web, "web")).where(F.length("text") >= least)


def expired_collections(names: DataFrame, current: str, keep: int = 5) -> DataFrame:
    """Collections (name) to delete: those of internal documents but the current one
    and the ``keep`` greatest names. A sort-and-limit, then an anti join."""
    own = names.where(F.col("name").startswith("pdf-") & (F.col("name") != current)).distinct()
    return own.join(own.orderBy(F.desc("name")).limit(keep), "name", "left_anti")
