"""Quantities, their reconciliation, citations, and checks of numbers and sentences
against source material."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import fixed
from siftline.functions.report import entities, sentence_about
from siftline.functions.text import CJK, WHITE, context, parsed_number, relative_difference
from siftline.operators.retrieve import in_blocks, nearest


def placed(matches: Column, pattern: int, names: tuple[str, ...]) -> Column:
    """Matches of a pattern, trimmed, with ``ord``: patterns in order, then matches."""
    return F.transform(matches, lambda x, i: F.struct((F.lit(pattern * 1_000_000) + i).alias("ord"), *(F.trim(x[n]).alias(n) for n in names)))


def quantities(materials: DataFrame) -> DataFrame:
    """(id, ord, label, value, unit, raw, context) of every quantity of (id, text).

    Each pattern's matches are zipped with their numbers; the context starts at the
    first occurrence of the match."""
    found = []
    for k, p in enumerate(fixed.QUANTITIES):
        whole, number = (F.regexp_extract_all("text", F.lit(p), F.lit(g)) for g in (0, 1))
        found.append(placed(F.arrays_zip(whole.alias("raw"), number.alias("value")), k, ("raw", "value")))
    rows = materials.select("id", "text", F.inline(F.concat(*found)))
    label = F.coalesce(*(F.when(F.contains("raw", F.lit(w)), w) for w in fixed.QUANTITY_LABELS), F.lit(fixed.OTHER_QUANTITY))
    unit = F.coalesce(*(F.nullif(F.regexp_extract("raw", p, 1), F.lit("")) for p in fixed.UNITS), F.lit(""))
    at = F.position(F.col("raw"), F.col("text"))
    begin = F.greatest(F.lit(1), at - 20)
    around = F.substring(F.col("text"), begin, at + F.length("raw") + 20 - begin)
    return rows.select("id", "ord", label.alias("label"), "value", unit.alias("unit"), F.substring("raw", 1, 80).alias("raw"), F.substring(around, 1, 120).alias("context"))


def reconciled(left: DataFrame, right: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """(label, left_value, right_value, status, diff_ratio): for labels on both sides
    their first quantities, consistent under the tolerance; all quantities of labels
    on one side only. Numbers that can't be read give no row."""
    order = F.struct("id", "ord")
    first = lambda q, name: q.groupBy("label").agg(F.min_by("value", order).alias(name))
    both = first(left, "left_value").join(first(right, "right_value"), "label")
    diff = relative_difference(parsed_number(F.col("left_value")), parsed_number(F.col("right_value")))
    compared = both.withColumn("d", diff).where("d is not null").select("label", "left_value", "right_value", F.when(F.col("d") < tolerance, "consistent").otherwise("conflict").alias("status"), F.round("d", 4).alias("diff_ratio"))
    none = F.lit(None).cast("string")
    alone = lambda q, other, status, l, r: q.join(other.select("label").distinct(), "label", "left_anti").select("label", l.alias("left_value"), r.alias("right_value"), F.lit(status).alias("status"), F.lit(None).cast("double").alias("diff_ratio"))  # noqa: E731, E741
    return compared.unionByName(alone(left, right, "left_only", F.col("value"), none)).unionByName(alone(right, left, "right_only", none, F.col("value")))


# Patterns of labels and their numbers, with the groups of both.
KEY_NUMBERS = [
    (rf"([{CJK}\w]{{2,10}})(?:为|达到|是|约|有|增长|下降|占比)([0-9]+(?:\.[0-9]+)?%?)", 1, 2),
    (rf"([{CJK}\w]{{2,10}})\s*[：:]\s*([0-9]+(?:\.[0-9]+)?%?)", 1, 2),
    (rf"([0-9]+(?:\.[0-9]+)?%?)\s*(?:的|之)?([{CJK}\w]{{2,10}})", 1, 2),
]


def key_numbers(materials: DataFrame) -> DataFrame:
    """(label, value): of all matches of the patterns, in order, a label's last."""
    found = []
    for k, (p, a, b) in enumerate(KEY_NUMBERS):
        zipped = F.arrays_zip(*(F.regexp_extract_all("text", F.lit(f"(?U){p}"), F.lit(g)).alias(n) for g, n in ((a, "label"), (b, "value"))))
        found.append(placed(zipped, k, ("label", "value")))
    rows = materials.select("id", F.inline(F.concat(*found))).where("length(label) >= 2")
    return rows.groupBy("label").agg(F.max_by("value", F.struct(F.floor(F.col("ord") / 1_000_000), "id", "ord")).alias("value"))


def number_conflicts(left: DataFrame, right: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """(label, left_value, right_value) of labels whose values differ: unequal as
    strings, and not within the tolerance as numbers."""
    both = key_numbers(left).withColumnRenamed("value", "left_value").join(key_numbers(right).withColumnRenamed("value", "right_value"), "label").where("left_value <> right_value")
    close = relative_difference(parsed_number(F.col("left_value")), parsed_number(F.col("right_value"))) < tolerance
    return both.where(~F.coalesce(close, F.lit(False)))


def citations(materials: DataFrame, internal_only: bool = False) -> DataFrame:
    """(ref_id, ord, origin, doc_name, url, snippet, confidence_weight, title) of
    (ord, origin, doc_name, url, text); ord is a dense order from 0."""
    origin = F.lit("pdf") if internal_only else F.col("origin")
    rows = materials.withColumn("origin", origin).withColumn("ref_id", (F.col("ord") + 1).cast("long"))
    snippet = shown(F.col("text"))
    first = F.split_part(snippet, F.lit("。"), F.lit(1))
    return rows.select(
        "ref_id", "ord", "origin", F.when(F.col("origin") == "pdf", F.col("doc_name")).otherwise("").alias("doc_name"), F.when(F.col("origin") == "pdf", "").otherwise(F.col("url")).alias("url"),
        snippet.alias("snippet"), F.when(F.col("origin") == "pdf", 0.9).otherwise(0.6).alias("confidence_weight"), F.substring(first, 1, 60).alias("title"),
    )


def shown(text: Column, most: int = 120) -> Column:
    """The first characters, without private-use and C1 control characters."""
    clean = F.trim(F.regexp_replace(F.substring(text, 1, most), r"[\ue000-\uf8ff\u0080-\u009f]", ""))
    return F.coalesce(clean, F.lit(""))


def reference_list(cited: DataFrame) -> DataFrame:
    """(ref_id, line): one line a citation."""
    inner = F.concat(F.lit("【S"), F.col("ref_id"), F.lit("】内部文档《"), F.col("doc_name"), F.lit("》，"), F.substring("snippet", 1, 60))
    outer = F.concat(F.lit("【S"), F.col("ref_id"), F.lit("】公开网络："), F.when(F.coalesce("url", F.lit("")) == "", "（无链接）").otherwise(F.col("url")), F.lit(" 《"), F.col("title"), F.lit("》"))
    return cited.select("ref_id", F.when(F.col("origin") == "pdf", inner).otherwise(outer).alias("line"))


def report_numbers(reports: DataFrame) -> DataFrame:
    """(id, number, ord): the distinct number tokens of (id, text), in order; single
    small digits are dropped."""
    tokens = F.array_distinct(F.regexp_extract_all("text", F.lit(fixed.NUMBER), F.lit(0)))
    rows = reports.select("id", F.posexplode(tokens).alias("ord", "number"))
    value = F.regexp_replace("number", r"[^\d.]", "").try_cast("double")
    return rows.where(~F.coalesce((value < 10) & (F.length("number") <= 2), F.lit(False))).select("id", "ord", "number")


#: Characters of a long stretch of digits that are looked at in one piece.
STRETCH = 256


def pieces(materials: DataFrame, asked: DataFrame) -> DataFrame:
    """(ord, piece): which of the asked strings (piece: a digit, then digits, commas,
    dots and CJK magnitudes) each text contains; each pair once.

    A text's stretches of such characters are cut into all their pieces up to the
    longest that is asked for, which are then joined with them by equality: no string
    meets a text that doesn't hold it."""
    longest = asked.agg(F.coalesce(F.max(F.length("piece")), F.lit(0))).first()[0]
    stretches = materials.select("ord", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[0-9][0-9,.万亿千百十]*"), F.lit(0)))).alias("whole"))
    windows = F.transform(F.sequence(F.lit(1), F.length("whole"), F.lit(STRETCH)), lambda i: F.substring(F.col("whole"), i, F.lit(STRETCH + longest)))
    cut = stretches.select("ord", F.explode(windows).alias("w")).distinct()
    from_each = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(max(longest, 1)), F.length("w") - i + 1)), lambda n: F.substring(F.col("w"), i, n))
    starts = F.filter(F.sequence(F.lit(1), F.least(F.lit(STRETCH), F.length("w"))), lambda i: F.substring(F.col("w"), i, F.lit(1)).between("0", "9"))
    found = cut.select("ord", F.explode(F.array_distinct(F.flatten(F.transform(starts, from_each)))).alias("piece"))
    return found.join(asked, "piece", "left_semi").distinct()


def supported(numbers: DataFrame, materials: DataFrame) -> DataFrame:
    """(number, exact_in, confidence, found): for each distinct number (as
    ``report_numbers`` gives them) the first material (ord) that contains it, and how
    far any supports it: 1 if one contains it, else the largest share of its digit runs
    in one material. More than a half counts as found.

    A share of one run needs only to know which runs occur. Shares of more are looked
    for in the materials of a number's rarer runs, as they need one of those."""
    distinct = numbers.select("number").distinct()
    runs = F.regexp_extract_all("number", F.lit(r"\d+\.?\d*"), F.lit(0))
    keyed = distinct.select("number", runs.alias("runs"))
    asked = keyed.select(F.explode(F.array_append("runs", F.col("number"))).alias("piece")).where("piece <> ''").distinct()
    hits = pieces(materials, asked)
    seen = hits.groupBy("piece").agg(F.min("ord").alias("first"), F.count("*").alias("n"))
    exact = distinct.join(seen, F.col("number") == F.col("piece")).select("number", F.col("first").alias("exact_in"))

    open_runs = keyed.join(exact, "number", "left_anti").select("number", F.size("runs").alias("k"), F.explode("runs").alias("piece"))
    each = open_runs.groupBy("number", "k", "piece").agg(F.count("*").alias("times")).join(seen, "piece")
    rank = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("n"), "piece"))
    ranked = each.withColumn("rank", rank)
    alone = each.groupBy("number").agg(F.max(F.col("times") / F.col("k")).alias("share"))
    rarer = ranked.where("rank > 1").join(hits, "piece").groupBy("number", "k", "ord").agg(F.sum("times").alias("times"))
    common = ranked.where("rank = 1").select("number", "piece", F.col("times").alias("more"))
    both = rarer.join(common, "number").join(hits.withColumn("there", F.lit(True)), ["ord", "piece"], "left")
    together = both.groupBy("number").agg(F.max((F.col("times") + F.when(F.col("there"), F.col("more")).otherwise(0)) / F.col("k")).alias("share"))
    best = alone.unionByName(together).groupBy("number").agg(F.max("share").alias("share"))

    out = distinct.join(exact, "number", "left").join(best, "number", "left")
    confidence = F.round(F.when(F.col("exact_in").isNotNull(), 1.0).otherwise(F.coalesce("share", F.lit(0.0))), 4)
    return out.select("number", "exact_in", confidence.alias("confidence")).withColumn("found", F.col("confidence") > 0.5)


def replaced_number(text: Column, wrong: Column, right: Column) -> Column:
    """The text with the first occurrence of a number replaced."""
    at = F.position(wrong, text)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), right, F.substring(text, at + F.length(wrong), F.length(text)))).otherwise(text)


def unknown_links(reports: DataFrame, known: DataFrame) -> DataFrame:
    """(id, url) of Markdown links whose target, without a trailing slash, is none of
    the known urls."""
    bare = lambda c: F.regexp_replace(c, r"/+$", "")
    links = reports.select("id", F.explode(F.regexp_extract_all("text", F.lit(r"\[[^\]]*\]\((https?://[^)\s]+)\)"), F.lit(1))).alias("url")).withColumn("key", bare("url"))
    return links.join(known.select(bare(F.col("url")).alias("key")).distinct(), "key", "left_anti").select("id", "url").distinct()


# Marks that a second look ignores (white space too), and characters
# that part a sentence.
MARKS = "，。！？、；：\"'（）【】[]{}《》"
PARTS = r"(?U)[，。！？、；：,.!?;:\s]+"


def bare(text: Column) -> Column:
    """The text without marks and white space."""
    return F.translate(text, MARKS + WHITE, "")


def looked_for(sentence: Column) -> Column:
    """struct(clean, bare, parts, head, entities): what ``method`` looks for."""
    clean = F.btrim(sentence, F.lit(WHITE + "\"'「」『』"))
    half = F.floor(F.length(clean) / 2).cast("int")
    halves = F.array(F.substring(clean, F.lit(1), half), F.substring(clean, half + 1, F.length(clean)))
    parts = F.filter(F.split(clean, PARTS), lambda x: F.length(x) >= 5)
    longest = lambda x, y: F.when(F.length(x) != F.length(y), F.length(y) - F.length(x)).when(x < y, -1).when(x > y, 1).otherwise(0)
    return F.struct(
        clean.alias("clean"), bare(clean).alias("bare"), F.when((F.size(parts) < 2) & (F.length(clean) > 10), halves).otherwise(parts).alias("parts"),
        F.trim(F.substring(clean, 1, 20)).alias("head"), F.array_sort(F.filter(entities(clean), lambda x: F.length(x) >= 3), longest).alias("entities"),
    )


def method(q: Column, material: Column, bare_material: Column) -> Column:
    """How a sentence (``looked_for``) is found in a material: literally, without marks,
    by two of its segments, by its first 20 characters, or by a number, percentage,
    year or quotation; null if it isn't."""
    inside = lambda x: F.contains(material, x)
    return (
        F.when(F.length(q["clean"]) < 5, None)
        .when(inside(q["clean"]), "exact")
        .when((F.length(q["bare"]) >= 5) & F.contains(bare_material, q["bare"]), "no punctuation")
        .when(F.size(F.filter(q["parts"], inside)) >= 2, "segments")
        .when((F.length(q["head"]) >= 6) & inside(q["head"]), "head")
        .when(F.exists(q["entities"], inside), "entity")
    )


def anchor(sentence: Column, material: Column) -> Column:
    """struct(method, text): where a sentence stands in a material, by ``method``; null
    if nowhere."""
    q, bare_m = looked_for(sentence), bare(material)
    inside = lambda x: F.contains(material, x)
    how = method(q, material, bare_m)
    entity = F.get(F.filter(q["entities"], inside), F.lit(0))
    about = sentence_about(material, entity)
    named = F.when(about != "", F.concat(F.lit("【实体匹配】"), entity, F.lit(" | 上下文: "), about)).otherwise(context(material, entity, 100))
    at = F.position(q["bare"], bare_m)
    begin = F.greatest(F.lit(1), at - 20)
    found = (
        F.when(how == "exact", context(material, q["clean"], 100))
        .when(how == "no punctuation", F.substring(material, begin, at + F.length(q["bare"]) + 20 - begin))
        .when(how == "segments", context(material, F.get(F.filter(q["parts"], inside), F.lit(0)), 100))
        .when(how == "head", context(material, q["head"], 100))
        .when(how == "entity", named)
    )
    return F.when(how.isNotNull(), F.struct(how.alias("method"), found.alias("text")))


METHODS = ("exact", "no punctuation", "segments", "head", "entity")


def anchors(sentences: DataFrame, materials: DataFrame) -> DataFrame:
    """(item_id, method, doc_id) of each sentence (item_id, text) of a stated set: the
    strongest method that finds it, and the smallest document in which it does.

    What all sentences look for goes to the tasks as one automaton (in blocks of
    bounded bytes), which reads each text once; a task hands on the best document of
    each sentence."""
    asked = sentences.select("item_id", looked_for(F.col("text")).alias("q")).where("length(q.clean) >= 5")
    flat = asked.select("item_id", "q.clean", "q.bare", "q.parts", "q.head", "q.entities")
    found = in_blocks(flat, lambda r: 4 * (len(r[1]) + len(r[2])), lambda held: materials.select("doc_id", "text").mapInArrow(_finder(held), "item_id long, rank int, doc_id long"))
    best = found.groupBy("item_id").agg(F.min(F.struct("rank", "doc_id")).alias("best"))
    return best.select("item_id", F.get(F.array(*map(F.lit, METHODS)), F.col("best.rank")).alias("method"), F.col("best.doc_id").alias("doc_id"))


def _finder(asked: list[tuple]):
    """Batches of (doc_id, text) to (item_id, rank, doc_id): the best of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        whole: dict[str, list[tuple[int, int, int]]] = {}  # needle: (sentence, kind, place)
        stripped: dict[str, list[int]] = {}
        for n, (_, clean, naked, parts, head, entities) in enumerate(asked):
            whole.setdefault(clean, []).append((n, 0, 0))
            for k, part in enumerate(parts):
                whole.setdefault(part, []).append((n, 2, k))
            if len(head) >= 6:
                whole.setdefault(head, []).append((n, 3, 0))
            for entity in entities:
                whole.setdefault(entity, []).append((n, 4, 0))
            if len(naked) >= 5:
                stripped.setdefault(naked, []).append(n)
        drop = str.maketrans("", "", MARKS + WHITE)
        machines = []
        for needles in (whole, stripped):
            machine = ahocorasick.Automaton()
            for needle in needles:
                if needle:
                    machine.add_word(needle, needle)
            machine.make_automaton()
            machines.append(machine)
        best: dict[int, tuple[int, int]] = {}
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                ranks: dict[int, int] = {}
                parts: dict[int, set[int]] = {}
                for needle in {x for _, x in machines[0].iter(text)} if len(machines[0]) else ():
                    for n, kind, place in whole[needle]:
                        if kind == 2:
                            parts.setdefault(n, set()).add(place)
                            if len(parts[n]) < 2:
                                continue
                        ranks[n] = min(ranks.get(n, kind), kind)
                for needle in {x for _, x in machines[1].iter(text.translate(drop))} if len(machines[1]) else ():
                    for n in stripped[needle]:
                        ranks[n] = min(ranks.get(n, 1), 1)
                for n, rank in ranks.items():
                    if n not in best or (rank, doc) < best[n]:
                        best[n] = (rank, doc)
        rows = [(asked[n][0], rank, doc) for n, (rank, doc) in best.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int64()))], names=["item_id", "rank", "doc_id"])

    return run


def semantic_matches(vectors: DataFrame, queries: DataFrame, least: float = 0.85, others: bool = False) -> DataFrame:
    """(query_id, vec_id, cosine): for each query vector the stored one of the greatest
    cosine, if that reaches ``least``; ties go to the smaller id. With ``others``, queries
    are stored vectors too, and the one of the query's own id doesn't count. Vectors are scaled
    to length 1, where the nearest has the greatest cosine; those without length are
    never found."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v))
    scaled = lambda df, key: df.withColumn("norm", norm).where("norm > 0").select(key, F.transform("embedding", lambda v: v / F.col("norm")).alias("embedding"))
    near = nearest(scaled(vectors, "vec_id"), scaled(queries, "query_id"), 2 if others else 1)
    if others:  # its own vector is one of the two at most
        first = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
        near = near.where("vec_id <> query_id").withColumn("first", first).where("first = 1")
    return near.where(F.col("cosine") >= least).select("query_id", "vec_id", "cosine")
