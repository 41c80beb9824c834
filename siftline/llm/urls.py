"""Verdicts on URLs: rules first, then gradient-boosted trees on lexical features.

A rule is a host and a path; it fits its host and all subdomains where the URL's
path starts with the rule's, and the longest fitting rule decides. What no rule
fits is judged by trees fitted on labelled URLs (for the query: those that a rule
decides): length, depth, digit ratio, entropy, counts of parameters, labels and
hyphens, and the share of blocked URLs with the same host suffixes and first path
segment. Those shares are counted over all labelled URLs and joined to the URLs; the
trees are fitted on a bounded sample of SAMPLE labelled URLs, those with the smallest
hashes. A URL that is learned from sees shares of other folds only (FOLDS, by host), so
that no label reaches its own features and hosts are as new to the trees as those that they
judge later. A suffix without labels has the overall share; each URL is learned from a second
time with that for all suffixes of its host, so that the trees know how to judge hosts
of which they have no labels at all. Of rules of equal length that fit one URL, the last listed decides; a
probability of exactly 0.5 is ``block``.

Null and empty URLs have an empty host and path, so no rule fits, and are judged by the
trees from their features (all zero, and the overall share) like any other. Where
nothing or one verdict was learned, that verdict (or allow) is given. Repeated rows
give repeated results, an empty table an empty one; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .pages import host_of, path_of
from .shared import bounded_batches

SAMPLE = 20_000
TREES, DEPTH, RATE, BINS, LEAST_LEAF = 60, 3, 0.2, 32, 20
#: Weight of the overall share in a suffix's share.
PRIOR = 20.0
#: Parts of the labelled URLs, by host, for shares that a URL's own label isn't in.
FOLDS = 5
#: (verdict, host, path) of the query's rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def lexical(url: str) -> list[float]:
    """The features of a URL that need no statistics."""
    _, _, rest = url.partition("://")
    host, path, query = re.match(r"(?s)([^/?#]*)([^?#]*)(?:\?([^#]*))?", rest).groups()
    digits = sum(c.isdigit() for c in url)
    segments = [s for s in path.split("/") if s]
    return [
        len(url), len(host), len(path), len(segments), digits / max(1, len(url)), sum(c.isdigit() for c in host),
        entropy(url), entropy(host), len(query.split("&")) if query else 0, host.count("."), url.count("-"), host.count("-"),
        max((len(s) for s in segments), default=0), float("#" in rest), float(path.endswith("/")), float("." in (segments[-1] if segments else "")), float(url.startswith("https")),
    ]


def suffixes(host: Column, path: Column) -> Column:
    """What statistics are kept of: the last one, two and three labels of the host,
    and the first segment of the path."""
    last = [F.concat(F.lit(f"{n}:"), F.substring_index(host, ".", -n)) for n in (1, 2, 3)]
    return F.array(*last, F.concat(F.lit("p:"), F.coalesce(F.get(F.split(path, "/"), F.lit(1)), F.lit(""))))


@dataclass
class Trees:
    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    #: (feature, bin, values of the leaves): complete trees, level by level.
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1)

    def margin(self, urls: list[str], rates: list[list[float]]) -> np.ndarray:
        out = np.full(len(urls), self.base)
        if urls and self.trees:
            b = self.binned(features(urls, rates))
            for feature, cut, leaf in self.trees:
                out += leaf[descend(b, feature, cut)]
        return out


def features(urls: list[str], rates: list[list[float]]) -> np.ndarray:
    return np.array([[*lexical(u), *r] for u, r in zip(urls, rates, strict=True)], np.float64)


def descend(b: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The leaf of each row; a cut of BINS sends all rows left."""
    node = np.zeros(len(b), np.int64)
    rows = np.arange(len(b))
    for _ in range(DEPTH):
        node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
    return node - (2**DEPTH - 1)


def grow(b: np.ndarray, gradient: np.ndarray, hessian: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree for Newton steps."""
    n, width = b.shape
    inner = 2**DEPTH - 1
    feature, cut = np.zeros(inner, np.int64), np.full(inner, BINS, np.int64)
    node = np.zeros(n, np.int64)
    for level in range(DEPTH):
        for at in range(2**level - 1, 2 ** (level + 1) - 1):
            own = np.flatnonzero(node == at)
            if len(own) < 2 * LEAST_LEAF:
                continue
            g, h = gradient[own], hessian[own]
            total = g.sum() ** 2 / (h.sum() + 1)
            best = 1e-6
            for j in range(width):
                x = b[own, j]
                left_g, left_h, left_n = (np.cumsum(np.bincount(x, w, BINS + 1))[:-1] for w in (g, h, np.ones(len(own))))
                gain = left_g**2 / (left_h + 1) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + 1) - total
                gain[(left_n < LEAST_LEAF) | (len(own) - left_n < LEAST_LEAF)] = -1
                k = int(gain.argmax())
                if gain[k] > best:
                    best, feature[at], cut[at] = gain[k], j, k
        node = 2 * node + 1 + (b[np.arange(n), feature[node]] > cut[node])
    leaf = node - inner
    g, h = (np.bincount(leaf, w, 2**DEPTH) for w in (gradient, hessian))
    return feature, cut, RATE * g / (h + 1)


def fit(rows: list[tuple[str, bool, list[float]]]) -> Trees:
    """Trees of (url, blocked, shares of its suffixes) rows."""
    rows = sorted(rows)
    y = np.array([b for _, b, _ in rows], float)
    share = float(y.mean()) if len(y) else 0.0
    if not 0 < share < 1:
        return Trees(9.0 if share else -9.0)
    model = Trees(math.log(share / (1 - share)))
    x = features([u for u, _, _ in rows], [r for _, _, r in rows])
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(x.shape[1])]
    b = model.binned(x)
    margin = np.full(len(y), model.base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        tree = grow(b, y - p, p * (1 - p))
        model.trees.append(tree)
        margin += tree[2][descend(b, *tree[:2])]
    return model


def judged(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the probability of block to batches with columns ``url`` and ``rates``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()  # noqa: B023, E731
            p = 1 / (1 + np.exp(-shared.value.margin([u or "" for u in column("url")], column("rates"))))
            yield batch.append_column("blocked", pa.array(p, pa.float64()))

    return run


def by_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def parts(urls: DataFrame) -> DataFrame:
    """``urls`` with the host and path that suffixes are taken of."""
    return urls.withColumns({"__host": host_of(F.col("url")), "__path": path_of(F.col("url"))})


def fold(host: Column) -> Column:
    return F.pmod(F.xxhash64(host), F.lit(FOLDS)).cast("int")


def statistics(labelled: DataFrame) -> tuple[DataFrame, float]:
    """((key, fold, rate), share): the share of blocked URLs of each suffix, drawn towards
    that of all distinct labelled URLs, and the latter. Fold -1 counts all URLs, the
    others those that aren't in the fold."""
    distinct = labelled.select(F.coalesce("url", F.lit("")).alias("url"), "blocked").distinct()
    share = distinct.agg(F.avg(F.col("blocked").cast("double"))).first()[0] or 0.0
    keys = parts(distinct).select(F.explode(suffixes(F.col("__host"), F.col("__path"))).alias("key"), fold(F.col("__host")).alias("own"), "blocked")
    counted = keys.groupBy("key", "own").agg(F.count("*").alias("n"), F.count_if("blocked").alias("bad"))
    every = F.explode(F.array(*map(F.lit, range(-1, FOLDS)))).alias("fold")
    rest = counted.select("*", every).where("own <> fold").groupBy("key", "fold").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    return rest.select("key", "fold", ((F.col("bad") + PRIOR * share) / (F.col("n") + PRIOR)).alias("rate")), share


def rated(urls: DataFrame, rates: DataFrame, share: float, apart: bool = False) -> DataFrame:
    """``urls`` with the shares of their suffixes (``rates``, in order; the overall one
    for suffixes without labels), ``apart`` without those of their own fold. Each suffix
    is looked up once for all URLs of one host and first segment."""
    keyed = parts(urls).withColumn("__keys", suffixes(F.col("__host"), F.col("__path"))).withColumn("__fold", fold(F.col("__host")) if apart else F.lit(-1)).drop("__host", "__path")
    each = keyed.select("__keys", "__fold").dropDuplicates(["__keys", "__fold"]).select("__keys", F.col("__fold").alias("fold"), F.posexplode("__keys").alias("at", "key"))
    found = each.join(rates, ["key", "fold"], "left").groupBy("__keys", F.col("fold").alias("__fold")).agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("rate", F.lit(share)).alias("rate"))))["rate"].alias("rates"))
    return keyed.join(found, ["__keys", "__fold"]).drop("__keys", "__fold")


def lessons(learned: list, share: float) -> list[tuple[str, bool, list[float]]]:
    """Rows (url, blocked, rates) to fit trees on: each twice, the second time as if no
    label were of its host's suffixes."""
    return [(r.url, r.blocked, rates) for r in learned for rates in (list(r.rates), [share] * (len(r.rates) - 1) + r.rates[-1:])]


def sample(labelled: DataFrame) -> DataFrame:
    """The bounded sample of (url, blocked) rows."""
    distinct = labelled.select(F.coalesce("url", F.lit("")).alias("url"), "blocked").distinct()
    return distinct.orderBy(F.xxhash64("url"), "url", "blocked").limit(SAMPLE)


def verdicts(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, blocked) of every page; blocked is the
    trees' probability. ``labelled``: (url, blocked) rows to learn from, by default
    the pages that a rule decides."""
    bounded_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = by_rules(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict)
    if labelled is None:
        labelled = rows.where("ruled is not null").select("url", (F.col("ruled") == "block").alias("blocked"))
    rates, share = statistics(labelled)
    learned = rated(sample(labelled), rates, share, apart=True).select("url", "blocked", "rates").collect()
    shared = pages.sparkSession.sparkContext.broadcast(fit(lessons(learned, share)))
    kind = pages.schema["page_id"].dataType.simpleString()
    out = rated(rows, rates, share).mapInArrow(judged(shared), f"page_id {kind}, url string, host string, path string, rule string, ruled string, rates array<double>, blocked double")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("blocked") >= 0.5, "block").otherwise("allow")).alias("verdict"), "blocked")


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
