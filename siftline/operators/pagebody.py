"""Body text of raw pages: a tree of elements, without adverts and navigation, and
the paragraphs of its article.

The tree is that of a plain parser: an element ends at its own end tag or with an
element around it, nothing ends it implicitly, and void elements hold nothing. A
paragraph's text is that of everything in it, each piece stripped, joined without a
space; scripts, styles and comments have none. So paragraphs that are never closed
hold all that follow them."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.fixed import ADVERT_WORDS
from siftline.operators.dedup import kept

# Elements that are removed, by name; by class names, where marked only
# of div; and by parts of a div's class or id.
REMOVED = ["aside", "nav", "footer"]
REMOVED_CLASSES = [
    "ad", "ads", "advertisement", "advert", "banner", "banner-ad", "promotion", "sidebar", "widget", "comment",
    "footer", "header", "nav", "navigation", "share", "share-bar", "social", "recommend", "related", "recommendation",
]
REMOVED_DIV_CLASS_PARTS = ["ad", "banner", "footer", "header"]
REMOVED_DIV_ID_PARTS = ["ad", "banner"]
# The shortest paragraph, how many make other blocks unnecessary, the
# shortest body, and elements that hold nothing.
SHORTEST, FEW, SHORTEST_BODY = 20, 3, 50
VOID = {"area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr", "image", "img", "input", "isindex", "keygen", "link", "menuitem", "meta", "nextid", "param", "source", "spacer", "track", "wbr"}
SILENT = {"script", "style", "template"}
#: Pages of a task at once.
ROWS = 64


class Tree(HTMLParser):
    """Elements in document order: (name, attributes, depth, first piece of text,
    piece after its last), and the pieces of text."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.elements: list[list] = []
        self.pieces: list[str] = []
        self.open: list[int] = []
        self.feed(page)
        self.close()
        self._end(0)

    def _end(self, depth: int) -> None:
        for e in self.open[depth:]:
            self.elements[e][3:] = [self.elements[e][3], len(self.pieces), len(self.elements)]
        del self.open[depth:]

    def handle_starttag(self, tag, attrs):
        self.elements.append([tag, dict(reversed(attrs)), len(self.open), len(self.pieces), len(self.pieces), len(self.elements) + 1])
        if tag not in VOID:
            self.open.append(len(self.elements) - 1)

    def handle_startendtag(self, tag, attrs):
        self.elements.append([tag, dict(reversed(attrs)), len(self.open), len(self.pieces), len(self.pieces), len(self.elements) + 1])

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.elements[self.open[depth]][0] == tag:
                self._end(depth)
                return

    def handle_data(self, data):
        if not (self.open and self.elements[self.open[-1]][0] in SILENT):
            self.pieces.append(data)


def removed(tag: str, attributes: dict) -> bool:
    own = (attributes.get("class") or "").split()
    if tag in REMOVED or not set(REMOVED_CLASSES).isdisjoint(own):
        return True
    return tag == "div" and (any(p in " ".join(own) for p in REMOVED_DIV_CLASS_PARTS) or any(p in (attributes.get("id") or "") for p in REMOVED_DIV_ID_PARTS))


def candidates(page: str) -> list[str]:
    """The paragraphs of a page's article, main or body element, or of all of it;
    where they are few, also the longer texts of its blocks that no text before
    contains. Neither adverts nor repetitions are dropped yet."""
    tree = Tree(page)
    dead, until, gone = [], 0, [False] * len(tree.pieces)
    for n, (tag, attributes, _, begin, end, after) in enumerate(tree.elements):
        if n >= until and removed(tag, attributes):
            until = after
            gone[begin:end] = [True] * (end - begin)
        dead.append(n < until)
    live = [n for n in range(len(tree.elements)) if not dead[n]]
    root = next((n for name in ("article", "main", "body") for n in live if tree.elements[n][0] == name), None)
    first, last = (root + 1, tree.elements[root][5]) if root is not None else (0, len(tree.elements))
    text = lambda e: "".join(p.strip() for k, p in enumerate(tree.pieces[e[3] : e[4]], e[3]) if not gone[k])
    inside = [tree.elements[n] for n in live if first <= n < last]
    out = [t for e in inside if e[0] == "p" and (t := text(e))]
    if len(out) < FEW:
        for e in inside:
            if e[0] in ("div", "section", "span") and len(t := text(e)) > 2 * SHORTEST and not any(t in x for x in out):
                out.append(t)
    return out


def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of ROWS pages, so that no more of their trees and texts are held."""
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS):
            yield batch.slice(low, ROWS)


def paragraphs(pages: DataFrame) -> DataFrame:
    """(page_id, url, para_no, text) of ``candidates``; a null page has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            found = [candidates(h or "") for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], names=["page_id", "url", "texts"])

    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, texts array<string>")
    return rows.select("page_id", "url", F.posexplode("texts").alias("para_no", "text"))


def advert(text: str) -> bool:
    low = text.strip().lower()
    return len(low) >= 5 and any(w.lower() in low for w in ADVERT_WORDS)


def body_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_paragraphs): the paragraphs that are long enough, no
    adverts, and no near copies of those before them, as one line; pages without any
    have an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            found = [kept([t for t in candidates(h or "") if len(t) >= SHORTEST and not advert(t)]) for h in batch.column(2).to_pylist()]
            lines = [" ".join(" ".join(f).split()) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lines, pa.string()), pa.array([len(f) for f in found], pa.int64())], names=["page_id", "url", "text", "n_paragraphs"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_paragraphs long")
