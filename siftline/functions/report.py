"""Column -> Column functions for prompts and reports: cuts, segments, entities,
formatted materials. Null text gives null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of entities.
ENTITY_PATTERNS = [r"[-+]?\d+\.?\d*[万亿千百十]?", r"\d+\.?\d*%", r"(?:19|20)\d{2}年?"]


def truncated(text: Column, most: int) -> Column:
    """Two thirds of ``most`` from the start and the rest but 50 from the end, with the
    length between, where the text is longer."""
    head = most * 2 // 3
    tail = most - head - 50
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, head), F.lit("\n...["), F.length(text), F.lit("]...\n"), F.right(text, F.lit(tail)))).otherwise(text)


def elided(text: Column, most: int = 7000, head: int = 4000, tail: int = 3000) -> Column:
    """The first and last parts of a longer text."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, head), F.lit("\n...\n"), F.right(text, F.lit(tail)))).otherwise(text)


def parts_between(text: Column, least: int = 5) -> Column:
    """Parts between punctuation of at least ``least`` characters."""
    return F.filter(F.transform(F.split(text, r"[，。！？、；：,.!?;:\n]"), lambda x: F.trim(x)), lambda x: F.length(x) >= least)


def segments(text: Column, least: int = 5) -> Column:
    """``parts_between``; the halves of a long text that has fewer than two."""
    parts = parts_between(text, least)
    half = F.floor(F.length(text) / 2).cast("int")
    halves = F.array(F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text)))
    return F.when((F.size(parts) < 2) & (F.length(text) >= 4 * least), halves).otherwise(parts)


def report_chunks(text: Column, most: int, chunks: int) -> Column:
    """At most ``chunks`` parts of at most ``most`` characters, cut at the last line end
    in the second half of a part if there is one; what is left over is dropped, as the
    limit is the feature."""

    def step(acc: Column, _: Column) -> Column:
        rest = acc["rest"]
        part = F.substring(rest, 1, most)
        line = F.length(part) - F.position(F.lit("\n"), F.reverse(part)) + 1
        cut = F.when(F.length(rest) <= most, F.length(rest)).when((F.position(F.lit("\n"), part) > 0) & (line > most // 2), line).otherwise(most)
        more = F.struct(F.substring(rest, cut + 1, F.length(rest)).alias("rest"), F.array_append(acc["out"], F.substring(rest, F.lit(1), cut)).alias("out"))
        return F.when(F.length(rest) == 0, acc).otherwise(more)

    start = F.struct(F.coalesce(text, F.lit("")).alias("rest"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(chunks)), start, step, lambda acc: acc["out"])


def sentence_about(text: Column, keyword: Column) -> Column:
    """From the sentence end before the first occurrence of a keyword to the next one
    of each kind, or 80 characters on where a kind is missing; empty if absent."""
    at = F.position(keyword, text)
    ends = ("。", "！", "？", "\n")
    before = F.substring(text, F.lit(1), at - 1)
    back = [F.when(F.position(F.lit(e), before) > 0, at - F.position(F.lit(e), F.reverse(before)) + 1).otherwise(1) for e in ends]
    on = [F.position(F.lit(e), text, at) for e in ends]
    end = F.when(F.least(*on) == 0, F.least(F.length(text), at + F.length(keyword) - 1 + 80)).otherwise(F.least(*on))
    begin = F.greatest(*back)
    return F.when(at > 0, F.trim(F.substring(text, begin, end - begin + 1))).otherwise("")


def entities(text: Column) -> Column:
    """Distinct numbers, percentages, years and quoted passages."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in ENTITY_PATTERNS]
    quoted = F.regexp_extract_all(text, F.lit("[\"「」『』]([^\"「」『』]{3,50})[\"「」『』]"), F.lit(1))
    return F.array_distinct(F.concat(*found, quoted))


def formatted(materials: DataFrame, by: str, most: int = 1000) -> DataFrame:
    """(by, text): a group's materials (ord, source, text) numbered and joined."""
    line = F.concat(F.lit("[S"), F.col("ord"), F.lit("] ("), F.col("source"), F.lit(") "), F.substring("text", 1, most))
    joined = materials.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("ord", line.alias("line")))).alias("m"))
    return joined.select(by, F.array_join("m.line", "\n---\n").alias("text"))
