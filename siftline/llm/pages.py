"""Main text of web pages by nearest-URL page differencing.

A page is read into lines: the texts of its blocks, menus and footers included.
The distinct pages of a host are put in the order of their paths, and each is
paired with its NEAREST neighbours on either side. The lines of a pair are aligned
by a longest common subsequence of their hashes. What a pair shares is a template
or a copy; how it is shared tells which:

* A neighbour of which the page shares less than half (by characters) is another
  page in the same template. A line that nine of ten such neighbours share, four at
  least, is deleted; where only two or three are such, nine of ten of all neighbours.
  On hosts of fewer pages a line is deleted if all such neighbours share it as part
  of what they share from the page's first line on or up to its last; beside one
  only if no markup calls it the article.
* Sites have several templates. A differing neighbour that shares the page's first
  lines, FRAME_LINES at least and at most a quarter of its text, has the same one:
  those lines, and the last line if both share it, are deleted if markup sets them
  apart or two such neighbours agree, but never where markup calls them the article.
* If there is none, but three neighbours at least that share more: lines that all of
  them share are deleted if what remains is one stretch, so that a short article
  under a long template loses it. Copies with scattered changes lose nothing.

A passage that pages quote is kept, as most neighbours lack it. Whole copies count
once, as one page that is differenced against others.

What no neighbour shares (an advert or a comment of one page, a page alone on its
host) only the markup can tell: lines that it sets apart go (navigation, headers,
footers, asides, forms, and elements whose class, id or role names adverts, notices,
comments and the like), and if an article or main element has lines, so do those
outside. Scripts, styles and the head are never lines.

Character references are decoded, white space becomes one space, lines are joined
by one space in page order. A null page is empty; a null url, or one without
``://``, has an empty host and path. Repeated rows give repeated results; an empty
table an empty one; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, drop_scratch, numbered, scratch

SKIPPED = set("head title script style noscript template nav footer header aside form iframe svg select button textarea object canvas dialog menu audio video".split())
RAW = {"script", "style", "textarea", "title", "template", "noscript", "svg", "iframe"}
VOID = set("area base br col embed hr img input link meta source track wbr".split())
BLOCK = set("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
COMMENT_NAMES = {"comment", "comments", "commentlist", "disqus", "reply", "replies", "respond"}
NAMES = COMMENT_NAMES | set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted banner sidebar cookie cookies consent gdpr notice notices alert menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead toolbar social share sharing related recommended newsletter subscribe signup login popup modal widget pagination pager".split()
)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu"}

_MARK = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>"']++|"[^"<>]*+"|'[^'<>]*+'|["'][^<>"']*+)*+)>|<[!?][^<>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME = re.compile(r"[a-z0-9]+")
_GAP = re.compile(r"\s+")
#: Kinds of line: outside and inside of the article's element, and set apart by markup.
OPEN, INSIDE, APART = 0, 1, 2
#: Neighbours on either side, and pages that a task compares with each other.
NEAREST, BLOCK_PAGES = 4, 64
#: Lines that two pages of one template begin with, at least.
FRAME_LINES = 3
#: Pairs of equal lines up to which a subsequence is found from the pairs.
_PAIRS = 1 << 21


def set_apart(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element doesn't belong to the article."""
    if tag in SKIPPED:
        return not (tag == "header" and inside)
    if not attributes or tag in ("html", "body"):
        return False
    names = COMMENT_NAMES if tag in ("article", "main") else NAMES
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "role" and value in ROLES):
            return True
        if key in ("class", "id") and not names.isdisjoint(_NAME.findall(value)):
            return True
    return False


def lines(page: str) -> list[tuple[str, int]]:
    """(text, kind) of the page's lines, in order. Text that is set apart in the
    middle of a line is a line of its own after it."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, bool, bool]] = []  # name, whether set apart, whether the article's element
    places: dict[str, list[int]] = {}  # where each open name stands in the stack
    blocks: list[int] = []  # where open blocks do
    apart = inside = 0
    parts: list[str] = []
    others: list[str] = []
    heading = header = 0

    def end_line() -> None:
        for pieces, kind in ((parts, INSIDE if inside else OPEN), (others, APART)):
            if pieces:
                text = _GAP.sub(" ", html.unescape("".join(pieces))).strip()
                pieces.clear()
                if text:
                    out.append((text, kind))

    def close(upto: int) -> None:
        nonlocal apart, inside, heading, header
        while len(stack) > upto:
            name, a, i = stack.pop()
            places[name].pop()
            if blocks and blocks[-1] == len(stack):
                blocks.pop()
            apart -= a
            inside -= i
            heading -= name in HEADING
            header -= name == "header"

    def text(piece: str) -> None:
        (others if apart or (header and not heading) else parts).append(piece)

    at = 0
    while m := _MARK.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in BLOCK:
            end_line()
        if m[1]:
            if places.get(tag):
                close(places[tag][-1])
            continue
        if tag in BLOCK and blocks:  # a block ends an open paragraph, an item an open item
            name = stack[blocks[-1]][0]
            if name == "p" or (name == tag and tag in ("li", "dd", "dt", "tr", "td", "th", "option")):
                close(blocks[-1])
        if tag in VOID or m[3].endswith("/"):
            continue
        a = set_apart(tag, m[3], bool(inside))
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        main = tag in ("article", "main") and not a
        if tag in BLOCK:
            blocks.append(len(stack))
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, a, main))
        apart += a
        inside += main
        heading += tag in HEADING
        header += tag == "header"
    text(page[at:])
    end_line()
    return out


def common(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Positions in ``a`` of a longest common subsequence, in linear space."""

    def lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        row = np.zeros(len(y) + 1, np.int32)
        for v in x:
            new = np.maximum(row[1:], row[:-1] + (y == v))
            row[1:] = np.maximum.accumulate(new)
        return row

    out: list[int] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, n = todo.pop()
        while i < j and k < n and a[i] == b[k]:
            out.append(i)
            i, k = i + 1, k + 1
        while i < j and k < n and a[j - 1] == b[n - 1]:
            j, n = j - 1, n - 1
            out.append(j)
        if i == j or k == n:
            continue
        if j - i == 1:
            if (b[k:n] == a[i]).any():
                out.append(i)
            continue
        mid = (i + j) // 2
        cut = k + int((lengths(a[i:mid], b[k:n]) + lengths(a[mid:j][::-1], b[k:n][::-1])[::-1]).argmax())
        todo += [(i, mid, k, cut), (mid, j, cut, n)]
    return sorted(out)


def aligned(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Positions in ``a`` and in ``b`` of a longest common subsequence."""
    n, m, low, high = len(a), len(b), 0, 0
    while low < n and low < m and a[low] == b[low]:
        low += 1
    while high < n - low and high < m - low and a[n - 1 - high] == b[m - 1 - high]:
        high += 1
    places: dict[int, list[int]] = {}
    for j in range(low, m - high):
        places.setdefault(b[j], []).append(j)
    middle: list[tuple[int, int]] = []
    if sum(len(places.get(x, ())) for x in a[low : n - high]) <= _PAIRS:
        # the longest chain of pairs that rise in both, by the last places of chains of each length
        ends: list[int] = []
        chains: list[tuple] = []
        for i in range(low, n - high):
            for j in reversed(places.get(a[i], ())):
                k = bisect_left(ends, j)
                chain = (i, j, chains[k - 1] if k else None)
                if k == len(ends):
                    ends.append(j)
                    chains.append(chain)
                else:
                    ends[k], chains[k] = j, chain
        chain = chains[-1] if chains else None
        while chain:
            middle.append(chain[:2])
            chain = chain[2]
        middle.reverse()
    else:
        j = low
        for i in common(np.array(a[low : n - high], np.int64), np.array(b[low : m - high], np.int64)):
            while b[j] != a[low + i]:
                j += 1
            middle.append((low + i, j))
            j += 1
    return [*range(low), *(i for i, _ in middle), *range(n - high, n)], [*range(low), *(j for _, j in middle), *range(m - high, m)]


def deleted(sizes: list[int], kinds: list[int], shared: list[list[int]]) -> list[int]:
    """Lines to delete from a page, given those that it shares with each neighbour."""
    n, total = len(sizes), sum(sizes)
    other = [s for s in shared if 2 * sum(sizes[k] for k in s) < total]
    same = Counter(k for s in other for k in _same_template(sizes, set(s)))
    return sorted(_voted(sizes, kinds, shared, other) | {k for k, v in same.items() if kinds[k] == APART or (kinds[k] == OPEN and v > 1)})


def _voted(sizes: list[int], kinds: list[int], shared: list[list[int]], other: list[list[int]]) -> set[int]:
    n = len(sizes)
    asked = other if len(other) >= 4 else shared
    if len(other) >= 2 and len(asked) >= 4:
        votes = Counter(k for s in asked for k in s)
        return {k for k, v in votes.items() if 10 * v >= 9 * len(asked)}
    if other:
        frames = [_frame(set(s), n) for s in other]
        found = set.intersection(*frames)
        return {k for k in found if len(other) > 1 or kinds[k] != INSIDE}
    if len(shared) >= 3:
        found = set.intersection(*map(set, shared))
        own = [k for k in range(n) if k not in found]
        if own and own[-1] - own[0] + 1 == len(own):
            return found
    return set()


def _same_template(sizes: list[int], shared: set[int]) -> set[int]:
    """The first lines, and the last, if the first say that both pages have one template."""
    n = len(sizes)
    first = next((k for k in range(n) if k not in shared), n)
    if first < FRAME_LINES or 4 * sum(sizes[:first]) > sum(sizes):
        return set()
    return {*range(first), *({n - 1} & shared)}


def _frame(shared: set[int], n: int) -> set[int]:
    """What is shared from the first line on, and up to the last."""
    first = next((k for k in range(n) if k not in shared), n)
    last = next((k for k in range(n - 1, -1, -1) if k not in shared), -1)
    return {*range(first), *range(last + 1, n)}


def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (row, page_id, url, html) to (row, page_id, url, texts, kinds)."""
    for batch in batches:
        found = [lines(h or "") for h in batch.column(3).to_pylist()]
        texts = pa.array([[t for t, _ in f] for f in found], pa.list_(pa.string()))
        kinds = pa.array([[k for _, k in f] for f in found], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], texts, kinds], names=["row", "page_id", "url", "texts", "kinds"])


def differenced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (block, home, host, row, own, sizes, kinds), sorted by block and
    order, to (row, gone) of the pages that are at home in their block."""
    window: list[tuple] = []  # the last pages, each with what its neighbours share
    block = None
    out: list[tuple[int, list[int]]] = []

    def leave(page: tuple) -> None:
        home, row, sizes, kinds, shared = page[1], page[2], page[4], page[5], page[6]
        if home:
            gone = deleted(sizes, kinds, shared)
            if gone:
                out.append((row, gone))

    for batch in batches:
        for key, home, host, row, own, sizes, kinds in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != block:
                while window:
                    leave(window.pop(0))
                block = key
            page = (host, home, row, own, sizes, kinds, [])
            for before in window:
                if before[0] == host and (home or before[1]):
                    a, b = aligned(before[3], own)
                    before[6].append(a)
                    page[6].append(b)
            window.append(page)
            if len(window) > NEAREST:
                leave(window.pop(0))
        yield _gone(out)
        out = []
    while window:
        leave(window.pop(0))
    yield _gone(out)


def _gone(found: list[tuple[int, list[int]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r for r, _ in found], pa.int64()), pa.array([g for _, g in found], pa.list_(pa.int32()))], names=["row", "gone"])


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z as a-z."""
    text = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def gone_lines(blocks: DataFrame) -> DataFrame:
    """(row, gone) of the pages of which differencing deletes lines.

    Only hashes and sizes of lines are written and shuffled. Blocks of BLOCK_PAGES
    pages in order, with NEAREST more on either side, go to the tasks."""
    hashed = scratch(
        blocks.where(F.size("texts") > 0).select(
            "row",
            host_of(F.col("url")).alias("host"),
            path_of(F.col("url")).alias("path"),
            F.transform("texts", lambda t: F.xxhash64(t)).alias("own"),
            F.transform("texts", lambda t: F.length(t)).alias("sizes"),
            "kinds",
        ).withColumn("content", F.xxhash64("own")),
        "lines",
    )
    first = hashed.groupBy("host", "content").agg(F.min(F.struct("path", "row")).alias("first"))
    heads = hashed.dropDuplicates(["row"]).join(first.select(F.col("first.row").alias("row")), "row", "left_semi")
    at = numbered(heads, ["host", "path", "row"])
    place = (F.col("idx") % BLOCK_PAGES).cast("int")
    near = F.when(place < NEAREST, F.array(F.lit(0), F.lit(-1))).when(place >= BLOCK_PAGES - NEAREST, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    dealt = at.withColumn("step", F.explode(near)).withColumn("block", F.floor(F.col("idx") / BLOCK_PAGES).cast("long") + F.col("step"))
    sorted_blocks = dealt.repartition("block").sortWithinPartitions("block", "idx")
    found = sorted_blocks.select("block", (F.col("step") == 0).alias("home"), "host", "row", "own", "sizes", "kinds").mapInArrow(differenced, "row long, gone array<int>")
    of_first = found.join(first.select("host", "content", F.col("first.row").alias("row")), "row").select("host", "content", "gone")
    out = scratch(hashed.select("row", "host", "content").distinct().join(of_first, ["host", "content"]).select("row", "gone"), "gone")
    drop_scratch(hashed, at)
    return out


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    bounded_batches(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select(F.xxhash64("page_id", "url", "html").alias("row"), "page_id", "url", "html")
    blocks = rows.mapInArrow(parsed, f"row long, page_id {kind}, url string, texts array<string>, kinds array<int>")
    joined = blocks.join(gone_lines(blocks), "row", "left")
    line = F.arrays_zip("texts", "kinds")
    inside = F.exists("kinds", lambda k: k == INSIDE)
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    kept = F.filter(line, lambda x, i: ~F.array_contains(gone, i) & (x["kinds"] == F.when(inside, INSIDE).otherwise(OPEN)))
    text = F.array_join(F.transform(kept, lambda x: x["texts"]), " ")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op7_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
