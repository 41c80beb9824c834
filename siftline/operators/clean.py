"""Lines, paragraphs and chunks of texts; folds stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import fixed
from siftline.functions.text import is_header_or_footer, normalised, replaced_characters, squeezed, stripped

# What ends a sentence.
SENTENCE_ENDS = "。！？」』\"'）］》】]"


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, repeated): every line, and whether a page repeats it."""
    out = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return out.withColumn("repeated", is_header_or_footer(F.col("line")))


def merged_lines(text: Column, twice: bool = False) -> Column:
    """Broken lines joined: headers and footers go, a blank line ends a paragraph, a
    line is joined to what went before unless that ends a sentence; a hyphen at the
    end of a line goes. ``twice`` appends a line after a hyphen two times."""
    empty = F.struct(F.lit("").alias("held"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, raw: Column) -> Column:
        line = F.trim(raw)
        held, out = acc["held"], acc["out"]
        flushed = F.when(held == "", out).otherwise(F.array_append(out, held))
        keep = lambda h, o: F.struct(h.alias("held"), o.alias("out"))
        hyphen = held.endswith("-")
        joined = F.when(hyphen, F.concat(F.substring(held, F.lit(1), F.length(held) - 1), line, line if twice else F.lit(""))).otherwise(F.concat(held, line))
        return (
            F.when(line == "", keep(F.lit(""), flushed))
            .when(is_header_or_footer(line), acc)
            .when(held == "", keep(line, out))
            .when(F.contains(F.lit(SENTENCE_ENDS), F.substring(held, -1, 1)), keep(line, F.array_append(out, held)))
            .otherwise(keep(joined, out))
        )

    # a pattern would read all that is held for each line; its last character is enough
    end = F.aggregate(F.split(text, "\n"), empty, step, lambda acc: F.when(acc["held"] == "", acc["out"]).otherwise(F.array_append(acc["out"], acc["held"])))
    return F.array_join(end, "\n")


def cleaned(text: Column) -> Column:
    """The whole cleaning of extracted text."""
    t = F.regexp_replace(replaced_characters(text), "\r\n?", "\n")
    t = F.regexp_replace(merged_lines(t), r"[ \t]+", " ")
    return F.trim(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def strided(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """(doc_id, chunk_no, text): windows of squeezed text, a closed form."""
    step = size - overlap
    flat = docs.select("doc_id", squeezed(F.col("text")).alias("flat")).where("flat <> ''")
    n = F.when(F.length("flat") <= size, 1).otherwise(F.ceil((F.length("flat") - size) / step) + 1).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.trim(F.substring(F.col("flat"), i * step + 1, F.lit(size))))
    return flat.select("doc_id", F.posexplode(F.filter(cut, lambda x: x != "")).alias("chunk_no", "text"))


def crawled(text: str | None, size: int = 500, overlap: int = 50) -> list[str]:
    """Windows that end at their last newline, if there is one: where it lies near
    the start, the next window begins one character on."""
    out, start, n = [], 0, len(text or "")
    while start < n:
        end = min(start + size, n)
        if end < n:
            newline = text.rfind("\n", start, end)
            end = newline if newline > start else end
        piece = text[start:end].strip()
        if piece:
            out.append(piece)
        if end >= n:
            break
        start = max(end - overlap, start + 1)
    return out


def crawled_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk_no, text) by ``crawled``, over Arrow batches."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            chunks = [crawled(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chunks, pa.list_(pa.string()))], names=["doc_id", "chunks"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, chunks array<string>")
    return rows.select("doc_id", F.posexplode("chunks").alias("chunk_no", "text"))


def chunk_verdict(text: Column, url: Column) -> Column:
    """struct(passed, score, reason) of a web chunk: its length, the white space at
    its ends, its source, and words no complete chunk begins or ends with."""
    n = F.length(text)
    bare = stripped(text)
    verdict = lambda ok, score, why: F.struct(F.lit(ok).alias("passed"), F.round(score, 6).alias("score"), F.lit(why).alias("reason"))
    starts = F.exists(F.array(*map(F.lit, fixed.DANGLING_STARTS)), lambda w: F.startswith(bare, w))
    ends = F.exists(F.array(*map(F.lit, fixed.DANGLING_ENDS)), lambda w: F.endswith(bare, w))
    return (
        F.when(F.coalesce(n, F.lit(0)) < 20, verdict(False, F.lit(0.0), "short"))
        .when(n > 2000, verdict(False, F.lit(0.0), "long"))
        .when(1 - F.length(bare) / n > 0.5, verdict(False, F.lit(0.2), "sparse"))
        .when(F.coalesce(url, F.lit("")) == "", verdict(False, F.lit(0.1), "no source"))
        .when(starts, verdict(False, F.lit(0.3), "begins in the middle"))
        .when(ends, verdict(False, F.lit(0.3), "ends in the middle"))
        .otherwise(verdict(True, F.least(0.5 + n / 4000, F.lit(0.95)), "ok"))
    )


def comparable(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in the form in which texts are compared."""
    return docs.select("doc_id", normalised(F.col("text")).alias("text"))
