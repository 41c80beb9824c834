"""Chunks against their task, their source and the chunks that passed before them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import fixed
from siftline.functions import text as T
from siftline.operators import order, retrieve

# The shortest chunk, the least share of the task's words, and the
# overlap from which a chunk repeats one that passed.
SHORTEST, LEAST_RELEVANT, MOST_ALIKE = 15, 0.1, 0.85
#: Texts whose borders a task reads at once.
BLOCK = 4096


def source_of(origin: Column, text: Column, document: Column, page: Column, snippet: Column) -> Column:
    """The text that a chunk is held against: the document, the page (else the
    snippet, else itself), or for other origins itself."""
    filled = lambda c: F.nullif(c, F.lit(""))
    return F.when(origin == "pdf", F.coalesce(document, F.lit(""))).when(origin == "web", F.coalesce(filled(page), filled(snippet), text)).otherwise(text)


def distortion(pairs: DataFrame, chunk: str = "a", source: str = "b") -> DataFrame:
    """``pairs`` with distorted, struct(score, reason), of two ``sides``: 0.4 of shared
    5-grams, 0.3 of the edit ratio and 0.3 of the chunk's content words that the source
    has; reason is null where the chunk follows its source."""
    a, b = F.col(chunk), F.col(source)
    content = F.array_except(a["w"], F.array(*map(F.lit, fixed.STOP_WORDS)))
    covered = F.when(F.size(content) > 0, F.size(F.array_intersect(content, b["w"])) / F.size(content)).otherwise(0.0)
    parts = pairs.withColumns({"__ngram": T.overlap(a["g"], b["g"]), "__edit": T.edit_ratio(a["t"], b["t"]), "__covered": covered})
    scored = parts.withColumn("__score", 0.4 * F.col("__ngram") + 0.3 * F.col("__edit") + 0.3 * F.col("__covered"))
    out = lambda s, why: F.struct(s.alias("score"), why.alias("reason"))
    score = F.col("__score")
    verdict = (
        F.when(F.length(a["t"]) < SHORTEST, out(F.lit(0.0), F.lit("short")))
        .when(F.length(b["t"]) < SHORTEST, out(F.lit(0.0), F.lit("short source")))
        .when((F.col("__ngram") < 0.2) & (F.col("__edit") < 0.25), out(score, F.lit("distorted")))
        .when(score < 0.2, out(score, F.lit("off the source")))
        .otherwise(out(score, F.lit(None).cast("string")))
    )
    return scored.withColumn("distorted", verdict).drop("__ngram", "__edit", "__covered", "__score")


def sides(texts: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """(key, name) with what ``distortion`` compares of each text."""
    plain = texts.select(key, T.normalised(F.col(text)).alias("__t"))
    words = F.array_distinct(F.regexp_extract_all("__t", F.lit(r"(?U)\w+"), F.lit(0)))
    return plain.select(key, F.struct(F.col("__t").alias("t"), T.grams(F.col("__t")).alias("g"), words.alias("w")).alias(name))


def layer1(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """(task_id, ord, text, passed, score, reason) of a task's retrieved chunks
    (task_id, ord, text, task, source_id), in the order in which they were found, with
    their sources (source_id, source); a chunk without a source is its own.

    Four tests: length, words shared with the task, overlap with a chunk that passed
    before, distortion of the source. What passed decides what comes after, so a fold
    runs over each task's list, which the retrieval has cut to its top hits."""
    key = F.xxhash64("text")
    rows = chunks.withColumn("relevance", T.lexical_overlap(F.col("text"), F.col("task"))).withColumn("__key", key)
    own = sides(chunks.select(key.alias("__key"), "text").dropDuplicates(["__key"]), "__key", "text", "a")
    both = rows.join(own, "__key").join(sides(sources, "source_id", "source", "b"), "source_id", "left").withColumn("b", F.coalesce("b", "a"))
    bare = T.stripped(F.coalesce("text", F.lit("")))
    early = F.when(F.length(bare) < SHORTEST, "short").when(F.col("relevance") < LEAST_RELEVANT, "irrelevant")
    item = F.struct(F.col("ord").cast("long").alias("ord"), "text", early.alias("early"), "relevance", F.col("a.g").alias("g"), F.col("distorted.score").alias("score"), F.col("distorted.reason").alias("late"))
    lists = distortion(both).groupBy("task_id").agg(F.array_sort(F.collect_list(item), lambda x, y: F.signum(x["ord"] - y["ord"]).cast("int")).alias("items"))

    kept_type = "struct<kept:array<array<string>>,out:array<struct<ord:bigint,text:string,passed:boolean,score:double,reason:string>>>"
    start = F.struct(F.array().alias("kept"), F.array().alias("out")).cast(kept_type)

    def judged(acc: Column, x: Column, nearest: Column) -> Column:
        again = nearest > MOST_ALIKE
        reason = F.coalesce(F.when(again, F.lit("duplicate")), x["late"], F.lit("ok"))
        row = F.struct(x["ord"].alias("ord"), x["text"].alias("text"), (reason == "ok").alias("passed"), F.round(F.when(again, nearest).otherwise(x["score"]), 4).alias("score"), reason.alias("reason"))
        return F.struct(F.when(reason == "ok", F.array_append(acc["kept"], x["g"])).otherwise(acc["kept"]).alias("kept"), F.array_append(acc["out"], row).alias("out")).cast(kept_type)

    def step(acc: Column, x: Column) -> Column:
        dropped = F.struct(x["ord"].alias("ord"), x["text"].alias("text"), F.lit(False).alias("passed"), F.round(F.when(x["early"] == "short", 0.0).otherwise(x["relevance"]), 4).alias("score"), x["early"].alias("reason"))
        alike = F.coalesce(F.array_max(F.transform(acc["kept"], lambda k: T.overlap(x["g"], k))), F.lit(0.0))
        # the array of one element binds what it holds to a name, so that it is computed once
        later = F.transform(F.array(alike), lambda nearest: judged(acc, x, nearest))[0]
        return F.when(x["early"].isNotNull(), F.struct(acc["kept"].alias("kept"), F.array_append(acc["out"], dropped).alias("out")).cast(kept_type)).otherwise(later)

    return lists.select("task_id", F.inline(F.aggregate("items", start, step, lambda acc: acc["out"])))


def stats(checked: DataFrame, examples: int = 5) -> DataFrame:
    """(task_id, total, passed, rejected, examples): counts of ``layer1``'s verdicts,
    and the first reasons for rejecting."""
    rejected = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.struct("ord", "reason"))))
    counted = checked.groupBy("task_id").agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("rejected"), rejected.alias("r"))
    return counted.select("task_id", "total", "passed", "rejected", F.slice("r", 1, examples)["reason"].alias("examples"))


def missing_topics(sub_tasks: DataFrame, materials: DataFrame, most: int = 2, prefix: int = 20) -> DataFrame:
    """(task_id, pos, sub_query): the first ``most`` sub-tasks (task_id, pos,
    sub_query) of each task whose first characters occur fewer than twice, without
    overlaps, in its materials (task_id, ord, text), which count as joined by spaces
    in the order of ``ord`` (of one material each in a task). Null texts are empty;
    sub-tasks without text are left out, those of white space only are missing.

    Materials are not joined: a key occurs twice if one occurrence begins after the
    end of another. Those inside a text are found where it lies, those over a border
    in the ends of the texts around it. The result's ``path`` is for the caller to delete."""
    rows = sub_tasks.where(F.coalesce("sub_query", F.lit("")) != "").withColumn("key", F.trim(F.substring("sub_query", 1, prefix)))
    texts = materials.where(F.col("task_id").isNotNull()).select("task_id", "ord", F.coalesce("text", F.lit("")).alias("text"))
    keys = rows.select(F.col("key").alias("item_id"), "key").where("key <> ''").distinct()
    inside = retrieve.found_at(texts.select(F.struct("task_id", "ord").alias("doc_id"), "text"), keys)
    inside = inside.select("doc_id.task_id", F.col("item_id").alias("key"), *(F.struct(F.col("doc_id.ord").alias("ord"), F.col(c).alias("at")).alias(n) for n, c in (("end", "first_end"), ("start", "last_start"))))
    over = across(texts, keys.where(F.contains("key", F.lit(" "))), prefix)
    twice = inside.unionByName(over).groupBy("task_id", "key").agg(F.min("end").alias("end"), F.max("start").alias("start")).where(F.col("start") > F.col("end"))
    few = rows.join(twice, ["task_id", "key"], "left_anti")
    out = few.withColumn("n", F.row_number().over(Window.partitionBy("task_id").orderBy("pos"))).where(F.col("n") <= most).select("task_id", "pos", "sub_query")
    out.path = over.path
    return out


def across(texts: DataFrame, keys: DataFrame, longest: int) -> DataFrame:
    """(task_id, key, end, start): occurrences of keys (item_id, key) of at most
    ``longest`` characters over the borders of a task's texts (task_id, ord, text),
    joined by spaces; ``end`` and ``start`` are (ord, at) of the last and the first
    character. Only the texts' ends are moved. As a border is a character itself, a
    text needs no more than ``longest`` - 1 texts before it, whatever their length, so
    blocks of the order are read each by itself."""
    reach = longest - 1
    ends = texts.select("task_id", "ord", F.substring("text", 1, reach).alias("head"), F.expr(f"right(text, {reach})").alias("tail"), F.length("text").cast("long").alias("size"))
    rows = order.numbered(ends, "task_id", "ord", "head", "tail")
    own = F.floor(F.col("number") / BLOCK)
    shown = F.when(F.col("number") % BLOCK >= BLOCK - reach, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = rows.select("*", own.alias("own"), F.explode(shown).alias("block"))
    kinds = [texts.schema[c].dataType.simpleString() for c in ("task_id", "ord")]
    place = f"struct<ord: {kinds[1]}, at: bigint>"

    def search(asked: list[tuple]) -> DataFrame:
        def run(table: pa.Table) -> pa.Table:
            import ahocorasick

            machine = ahocorasick.Automaton()
            for _, key in asked:
                machine.add_word(key, key)
            machine.make_automaton()
            found, task, before, places = [], None, "", []
            for r in table.sort_by("number").to_pylist():
                if r["task_id"] != task:
                    task, before, places = r["task_id"], None, []
                if before is not None:
                    before, places = before + " ", [*places, (r["ord"], -1)]
                    if r["own"] == r["block"]:
                        line = before + r["head"]
                        at = places + [(r["ord"], i) for i in range(len(r["head"]))]
                        for end, key in machine.iter(line) if len(machine) else ():
                            start = end + 1 - len(key)
                            if start < len(before) - 1 and end >= len(before):
                                found.append((task, key, at[end], at[start]))
                tail = [(r["ord"], r["size"] - len(r["tail"]) + i) for i in range(len(r["tail"]))]
                before, places = ((before or "") + r["tail"])[-reach:], [*places, *tail][-reach:]
            as_place = lambda k: pa.array([{"ord": x[k][0], "at": x[k][1]} for x in found], pa.struct([("ord", table.schema.field("ord").type), ("at", pa.int64())]))
            return pa.table([pa.array([x[0] for x in found], table.schema.field("task_id").type), pa.array([x[1] for x in found], pa.string()), as_place(2), as_place(3)], names=["task_id", "key", "end", "start"])

        return dealt.groupBy("block").applyInArrow(run, f"task_id {kinds[0]}, key string, end {place}, start {place}")

    out = retrieve.in_blocks(keys.select("item_id", "key"), lambda r: 4 * len(r[1]) + 16, search)
    out.path = rows.path
    return out
