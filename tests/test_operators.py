"""Small rows with results worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from siftline.functions import text as T
from siftline.operators import clean, dedup, evidence, retrieve, rules
from siftline.sources import search
from siftline.streaming import sessions


def one(spark, column, **values):
    row = {k: v for k, v in values.items()} or {"x": 1}
    types = {str: "string", int: "long", float: "double", bool: "boolean", list: "array<string>"}
    schema = ", ".join(f"{k} {types.get(type(v), 'string')}" for k, v in row.items())
    return spark.createDataFrame([tuple(row.values())], schema).select(column).first()[0]


def test_tokens(spark):
    assert set(one(spark, T.tokens(F.col("t")), t="schön AI 市场 x 10")) == {"市", "场", "sch", "ai", "10"}
    assert one(spark, T.tokens(F.col("t")), t=None) == []


def test_bm25(spark):
    docs = spark.createDataFrame([(0, "apple banana apple"), (1, "banana cherry"), (2, "市场 growth 10"), (3, None)][:3], "doc_id long, text string")
    got = {r.doc_id: r.score for r in retrieve.bm25(docs, spark.createDataFrame([(1, "apple 市 apple")], "item_id long, text string")).collect()}
    assert got == {0: 1.401185, 2: 0.852895}


@pytest.mark.parametrize(("a", "b", "want"), [("abcdef", "abcdeg", 0.5), ("abcd", "abcd", 0.0)])
def test_gram_overlap(spark, a, b, want):
    assert one(spark, T.overlap(T.grams(F.col("a")), T.grams(F.col("b"))), a=a, b=b) == want


@pytest.mark.parametrize(("a", "b", "want"), [("kitten", "sitting", 0.571429), ("abc", "abcdef", 0.5), ("", "a", 0.0)])
def test_edit_ratio(spark, a, b, want):
    assert math.isclose(one(spark, T.edit_ratio(F.col("a"), F.col("b")), a=a, b=b), want, abs_tol=1e-6)


def test_lexical_overlap(spark):
    assert math.isclose(one(spark, T.lexical_overlap(F.col("c"), F.col("q")), q="市场 ai", c="市 AI x"), 0.649525, abs_tol=1e-6)


@pytest.mark.parametrize(("n", "sizes"), [(500, [500]), (501, [500, 51]), (950, [500, 500]), (1200, [500, 500, 300])])
def test_strided_chunks(spark, n, sizes):
    got = clean.strided(spark.createDataFrame([(1, "a" * n)], "doc_id long, text string")).orderBy("chunk_no").collect()
    assert [len(r.text) for r in got] == sizes


def test_crawled_chunks():
    got = [len(x) for x in clean.crawled("a" * 10 + "\n" + "b" * 600)]
    assert got == [*range(10, 0, -1), 499, 151]
    assert clean.crawled(None) == [] and clean.crawled("") == []


def test_adverts_and_verdicts(spark):
    assert one(spark, T.is_advert(F.col("t")), t="They had lunch at the market.")
    assert not one(spark, T.is_advert(F.col("t"), True), t="They had lunch at the market.")
    got = one(spark, clean.chunk_verdict(F.col("t"), F.col("u")), t="x" * 100, u="http://a")
    assert (got.passed, got.score) == (True, 0.525)


def test_merged_lines(spark):
    assert one(spark, clean.merged_lines(F.col("t")), t="one-\ntwo\nPage 3\nthree。\nfour\n\nfive") == "onetwothree。\nfour\nfive"
    assert one(spark, clean.merged_lines(F.col("t"), True), t="one-\ntwo") == "onetwotwo"


@pytest.mark.parametrize(("url", "tier"), [("https://www.stats.gov.cn/x", "verified"), ("https://gartner.com", "unverified"), ("https://www.sohu.com/a/1", "low_quality"), (None, "unverified"), ("not a url", "unverified")])
def test_trust(spark, url, tier):
    assert one(spark, rules.trust_tier(F.col("u")), u=url) == tier


def test_relevance_and_severity(spark):
    assert [one(spark, rules.relevance(F.col("s")), s=s) for s in (0.49, 0.5, 0.7)] == ["irrelevant", "insufficient", "relevant"]
    got = [one(spark, rules.severity(F.lit(1), F.lit(0), F.col("r")), r=r).level for r in (0.2, 0.21, 0.51)]
    assert got == ["minor", "moderate", "severe"]


def test_numbers(spark):
    got = evidence.report_numbers(spark.createDataFrame([(1, "2024 12.5% 1234.5")], "id long, text string")).orderBy("ord").collect()
    assert [r.number for r in got] == ["202", "12.5", "123", "4.5"]


def test_quantities(spark):
    rows = [(1, "市场规模达5000亿元"), (2, "市场规模达到5000亿元"), (3, "增长率为12.5%"), (4, None), (5, "")]
    got = {r.id: (r.label, r.value, r.unit) for r in evidence.quantities(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert got == {1: ("市场规模", "5000", "亿"), 3: ("增长率", "12.5", "%")}


@pytest.mark.parametrize(("a", "b", "status", "ratio"), [("100", "96", "consistent", 0.04), ("100", "95", "conflict", 0.05)])
def test_reconciled(spark, a, b, status, ratio):
    side = lambda v: spark.createDataFrame([(1, 0, "价格", v)], "id long, ord int, label string, value string")
    got = evidence.reconciled(side(a), side(b)).first()
    assert (got.status, got.diff_ratio) == (status, ratio)


def test_exact_prefix(spark):
    docs = spark.createDataFrame([(1, "Hello World!"), (2, "hello worl " * 20), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in retrieve.exact_prefix(docs, spark.createDataFrame([(1, "hello worlds")], "item_id long, text string"), spark.createDataFrame([], "item_id long")).collect()}
    assert got == {1: 0.85, 2: 0.9}


def test_fusion(spark):
    hits = lambda rows: spark.createDataFrame(rows, "item_id long, doc_id long, score double, rank int")
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in retrieve.fused(hits([(1, 1, 0.8, 1), (1, 2, 0.8, 2)]), hits([(1, 1, 0.5, 1), (1, 3, 0.5, 2)]), texts).collect()}
    assert got == {1: 0.68, 2: 0.8, 3: 0.5}
    rrf = {r.doc_id: r.score for r in retrieve.fused(hits([(1, 2, 0.8, 1)]), hits([(1, 1, 0.5, 1), (1, 3, 0.5, 2)]), texts, mode="rrf").collect()}
    assert rrf[2] == 0.016185


def test_web_query_json_and_sizes(spark):
    assert one(spark, rules.web_query(F.col("t"), F.lit(0), F.lit(True)), t="a big market") == "big market"
    assert one(spark, rules.safe_json(F.col("t")), t='say {"a": 1} now') == '{"a": 1}'
    assert one(spark, rules.safe_json(F.col("t")), t="say {a now") is None
    assert [one(spark, rules.size_bytes(F.col("t")), t=t) for t in ("10MB", "5k", "x", None)] == [10 << 20, 5 << 10, 10 << 20, 10 << 20]


def test_keep_first_is_greedy(spark):
    a, b, c = "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxy!", "abc"
    assert one(spark, dedup.keep_first(F.col("t")), t=[a, b, a, c, c]) == [a, c, c]


def test_redaction_and_markdown(spark):
    assert one(spark, T.redacted(F.col("t")), t='token = "abcdefgh12"') == 'token = "***REDACTED***"'
    assert one(spark, T.plain_markdown(F.col("t")), t="**b** *i* `c` ~~s~~ [t](u) ![a](v)") == "b i c s t（u） [图片: a]"


def test_replaced_number_and_context(spark):
    assert one(spark, evidence.replaced_number(F.col("t"), F.lit("12"), F.lit("7")), t="a 12 b 12") == "a 7 b 12"
    assert one(spark, T.context(F.col("t"), F.lit("key"), 3), t="12345key67890") == "...345key678..."


def test_search_hits_take_every_shape(spark):
    rows = [(1, '{"results":[{"title":"t","url":"u","content":"c"}]}'), (2, '[{"title":"t","href":"h","body":"b"}]'), (3, '{"organic_results":[{"title":"t","link":"l","snippet":"s"}]}'), (4, "broken"), (5, None)]
    got = {r.query_id: (r.url, r.content) for r in search.normalised_hits(spark.createDataFrame(rows, "query_id long, response string"), "s").collect()}
    assert got == {1: ("u", "c"), 2: ("h", "b"), 3: ("l", "s")}
    with pytest.raises(ValueError):
        search.provider("none")


def test_sessions_end_after_their_time(spark):
    rows = [(1, "2024-01-01 00:00:00"), (2, "2023-12-31 23:59:59")]
    events = spark.createDataFrame(rows, "user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.user_id: r.live for r in sessions.live_sessions(events, "2024-01-02 00:00:00").collect()}
    assert got == {1: True, 2: False}


def test_report_functions(spark):
    from siftline.functions import report

    assert one(spark, report.report_chunks(F.col("t"), 10, 3), t="abcdefg\nhijklmnopqrstuvwxyz12345") == ["abcdefg\n", "hijklmnopq", "rstuvwxyz1"]
    assert one(spark, report.report_chunks(F.col("t"), 10, 3), t=None) == []
    assert one(spark, report.sentence_about(F.col("t"), F.lit("key")), t="one。two key three！four？five\nsix。") == "two key three！"
    assert one(spark, report.sentence_about(F.col("t"), F.lit("key")), t="a key " + "b" * 200) == "a key " + "b" * 79
    assert one(spark, report.entities(F.col("t")), t='2024年 12% "quoted words"') == ["2024", "12", "12%", "2024年", "quoted words"]
    assert one(spark, report.segments(F.col("t")), t="x" * 20) == ["x" * 10, "x" * 10]


def test_citations_drop_private_use_and_control_characters_only(spark):
    assert one(spark, evidence.shown(F.col("t")), t="555-3824 a\u0085b-") == "555-3824 ab-"
    assert one(spark, evidence.shown(F.col("t")), t=None) == ""


def test_replaced_and_dropped_characters(spark):
    assert one(spark, T.replaced_characters(F.col("t")), t="a—b’c d​e﻿f\u0007g　h") == "·a—b'c defg h"


@pytest.mark.parametrize(
    ("task", "name", "strategy"),
    [("列出全部数据", "precise_qa", "precise_qa"), ("告诉我一下数据", "precise_qa", "precise_qa"), ("查资料", "general", "general"), ("宏观政策", "general", "general"), ("竞品格局", "general", "general"), ("总结这份PDF", "general", "general"),
     ("总结文件", "document_local", "force_pdf_only"), ("不联网", "general", "force_pdf_only"), (None, "general", "general"), ("  ", "general", "general")],
)
def test_intents(spark, task, name, strategy):
    from siftline.functions import intents

    got = one(spark, F.struct(intents.intent(F.col("t")).alias("i"), intents.policy(intents.intent(F.col("t"))).alias("p")), t=task)
    assert (got.i.intent, got.p.strategy) == (name, strategy)


def test_layer1_against_a_plain_fold(spark):
    import random
    import re

    from siftline.operators import validation

    rng = random.Random(4)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu") for b in ("ter", "sol", "fin", "gra", "bel")]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    sources = {s: text(60) for s in range(4)}
    rows = []
    for task in range(3):
        for k in range(25):
            s = rng.randrange(5)
            t = " ".join(sources.get(s, text(60)).split()[k : k + 12])
            t = rng.choice([t, t, t[:-3] + "xyz", text(12), "short", "", None, "zzz " * 8, *(r[2] for r in rows[-3:])])
            rows.append((task, k, t, "kater losol", rng.choice([s, s, (s + 1) % 4])))
    chunks = spark.createDataFrame(rows, "task_id long, ord long, text string, task string, source_id long")
    got = {(r.task_id, r.ord): (r.passed, r.reason, r.score) for r in validation.layer1(chunks, spark.createDataFrame(list(sources.items()), "source_id long, source string")).collect()}

    def grams(t):
        return {t[i : i + 5] for i in range(len(t) - 4)}

    def overlap(a, b):
        return len(grams(a) & grams(b)) / max(len(grams(a)), len(grams(b))) if grams(a) and grams(b) else 0.0

    def ratio(a, b):
        a, b = sorted((a, b), key=len)
        if not a:
            return 0.0
        if a in b:
            return len(a) / len(b)
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return 1 - row[-1] / max(len(a), len(b))

    seen = set()
    for task in range(3):
        kept = []
        for t_id, k, t, asked, s in rows:
            if t_id != task:
                continue
            text_ = t or ""
            source = sources.get(s, text_)
            words = lambda x: set(re.findall("[a-z0-9]+", x.lower()))
            near = 0.3 * len(words(text_) & words(asked)) / (len(words(asked)) + 0.001)
            if len(text_.strip()) < 15:
                want = (False, "short", 0.0)
            elif near < 0.1:
                want = (False, "irrelevant", round(near, 4))
            else:
                alike = max([overlap(text_.strip(), x) for x in kept], default=0.0)
                a, b = text_.strip(), source.strip()
                score = 0.4 * overlap(a, b) + 0.3 * ratio(a, b) + 0.3 * len(words(a) & words(b)) / len(words(a))
                if alike > 0.85:
                    want = (False, "duplicate", round(alike, 4))
                elif overlap(a, b) < 0.2 and ratio(a, b) < 0.25:
                    want = (False, "distorted", round(score, 4))
                elif score < 0.2:
                    want = (False, "off the source", round(score, 4))
                else:
                    kept.append(a)
                    want = (True, "ok", round(score, 4))
            seen.add(want[1])
            assert got[task, k][:2] == want[:2] and math.isclose(got[task, k][2], want[2], abs_tol=2e-4)
    assert {"short", "irrelevant", "duplicate", "ok"} <= seen


def test_anchor_strategies(spark):
    material = "The market grew by 12.5% in 2024, said 'the report'. 首页内容很多。核心观点在这里，别处没有。"
    cases = [("grew by 12.5%", "exact"), ("The market， grew by 12.5% in 2024", "no punctuation"), ("market oranges nowhere", None), ("核心观点在这里！首页内容很多", "segments"), ("In 2024年 nothing", "entity"), ("abc", None)]
    for sentence, method in cases:
        got = one(spark, evidence.anchor(F.col("s"), F.lit(material)), s=sentence)
        assert (got and got.method) == method, sentence


def test_repairs_reach_nested_text(spark):
    from siftline.operators import checking

    reports = spark.createDataFrame([(1, '{"a": ["12元 and 12元", {"b": "7"}], "n": 12}'), (2, "no json 12元"), (3, None)], "report_id long, report string")
    wrong = spark.createDataFrame([(1, 0, "12元"), (1, 1, "99元"), (2, 0, "12元"), (3, 0, "12元")], "report_id long, ord long, number string")
    materials = spark.createDataFrame([(i, 1, "first 5万 then 12万元") for i in (1, 2, 3)], "report_id long, ord long, text string")
    got = {r.report_id: r.report for r in checking.repaired_reports(reports, wrong, materials).collect()}
    assert got == {1: '{"a": ["12万 and 12元", {"b": "7"}], "n": 12}', 2: "no json 12元", 3: None}


def test_wrapped_lines(spark):
    from siftline.functions import prompts

    assert one(spark, prompts.wrapped(F.col("t"), 2), t="市场abcde增\nx") == ["市场", "abcd", "e增", "x"]
    assert one(spark, prompts.wrapped(F.col("t"), 2), t=None) == [""]


def test_body_of_pages():
    from siftline.operators.pagebody import candidates

    page = """<html><body><nav><p>menu</p></nav><div class="x shadow"><p>a class with ad in it</p></div><div id=headline><p>an id too</p></div><span class="share">s</span>
<article><p>One <b>two</b> three<p>nested four</p></p><script>var x;</script><!-- c --><div>Long enough text of a div that is more than forty characters</div><div>short</div></article></body></html>"""
    assert candidates(page) == ["Onetwothreenested four", "nested four", "Long enough text of a div that is more than forty characters"]
    assert candidates('<main><p>a</p><p>b</p><p>c</p><div>' + "x" * 50 + "</div></main><p>outside</p>") == ["a", "b", "c"]
    assert candidates("") == [] and candidates("<p>x<br>y</p><p class='AD ad'>no</p><footer><p>f</footer>") == ["xy"]
    twice = "word " * 12
    assert candidates(f"<body><section><span>{twice}</span></section></body>") == [twice.strip()]  # the span's text lies in the section's


def test_clean_body_of_pages(spark):
    from siftline.operators.pagebody import body_text

    long, other = "A sentence that is long enough to stay. " * 3, "Quite another one, which nothing else repeats here. " * 3
    rows = [(1, "u", f"<article><p>{long}</p><p>{long}x</p><p>{other}</p><p>too short</p><p>Please subscribe to the copyright newsletter</p></article>"), (2, "v", None), (3, None, "")]
    got = {r.page_id: (r.text, r.n_paragraphs) for r in body_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: (f"{long.strip()} {other.strip()}", 2), 2: ("", 0), 3: ("", 0)}


def test_files_are_cut_once(spark, tmp_path):
    from siftline.sources import collections

    folder, cache = tmp_path / "in", str(tmp_path / "cache")
    folder.mkdir()
    for name, text in (("a.txt", "x" * 600), ("b.txt", "x" * 600), ("c.txt", "short text")):
        (folder / name).write_text(text)
    (folder / "d.txt").write_bytes(b"\xff\xfe")
    cuts = []

    def cut(docs):
        cuts.append(docs.count())
        return clean.strided(docs)

    rows = collections.files(spark, str(folder))
    assert rows.where("text is null").count() == 1
    first = collections.ingested(spark, cache, rows, cut)
    assert first.groupBy("key").count().count() == 2 and first.count() == 3
    (folder / "e.txt").write_text("new text")
    again = collections.ingested(spark, cache, collections.files(spark, str(folder)), cut)
    assert again.count() == 4 and cuts == [2, 1]


def test_collections_prompts_and_models(spark, tmp_path):
    from hashlib import md5

    from siftline.sources import collections

    chunks = spark.createDataFrame([(1, 0, "ab"), (1, 1, "cd"), (2, 0, "x")], "collection long, ord long, text string")
    assert {r.collection: r.name for r in collections.content_name(chunks).collect()} == {k: "pdf-" + md5(t).hexdigest()[:16] for k, t in ((1, b"abcd"), (2, b"x"))}
    embed = lambda df: df.withColumn("embedding", collections.hashed_embedding(F.col("text"), 8))
    made, why = collections.collected(spark, str(tmp_path), "pdf-1", chunks, embed)
    assert made.count() == 3 and why == "" and all(abs(sum(x * x for x in r.embedding) - 1) < 1e-9 for r in made.collect())
    assert collections.collected(spark, str(tmp_path), "pdf-1", chunks.limit(0), embed)[0].count() == 3  # made once
    assert collections.collected(spark, str(tmp_path), "pdf-2", chunks)[1] and collections.collected(spark, str(tmp_path), "pdf-3", chunks, lambda df: df.select("nothing"))[1]
    (tmp_path / "p.txt").write_text("== system ==\nSay {what}.\n\n== other ==\nplain {}\n")
    assert collections.prompt(str(tmp_path), "system", what="it") == "Say it." and collections.prompt(str(tmp_path), "other", "p.txt") == "plain {}"
    with pytest.raises(KeyError):
        collections.prompt(str(tmp_path), "none")
    with pytest.raises(FileNotFoundError):
        collections.prompt(str(tmp_path), "system", "q.txt")
    collections.register_model("Local", lambda p: F.upper(p))
    assert one(spark, collections.model("cloud", "local")(F.col("t")), t="hi") == "HI"
    with pytest.raises(ValueError):
        collections.model("cloud")


def test_occurrences_and_overlaps_on_odd_rows(spark):
    docs = spark.createDataFrame([(1, "aaaa ab"), (2, None), (3, ""), (4, "市场 AB b")], "doc_id long, text string")
    needles = spark.createDataFrame([(1, "aa"), (2, "a"), (3, ""), (4, "aa"), (5, "zz")], "item_id long, key string")
    got = {(r.item_id, r.doc_id): r.n for r in retrieve.occurrences(docs, needles).collect()}
    assert got == {(1, 1): 2, (4, 1): 2, (2, 1): 5}
    assert retrieve.occurrences(docs, needles.limit(0)).count() == 0 == retrieve.occurrences(docs.limit(0), needles).count()
    queries = spark.createDataFrame([(1, "市 ab"), (2, "..."), (3, None), (4, "ab aaaa")], "item_id long, text string")
    got = {(r.item_id, r.doc_id): r.score for r in retrieve.overlapping(docs, queries, 0.2).collect()}
    assert got == {(1, 1): round(0.3 / 1.001, 6), (1, 4): round(0.7 / 1.001 + 0.3 / 1.001, 6), (4, 1): round(0.6 / 2.001, 6)}
    assert retrieve.overlapping(docs, queries.limit(0), 0.2).count() == 0


def test_scores_of_many_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"w{k % 7}x common y{k % 3}z " * (k % 4 + 1)) for k in range(60)] + [(99, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(k, f"w{k}x common y1z") for k in range(9)], "item_id long, text string")
    want = sorted(map(tuple, retrieve.bm25_topk(docs, queries, 5).collect()))
    plain = retrieve.top(retrieve.bm25(docs, queries), "item_id", [F.desc("score"), F.asc("doc_id")], 5)
    assert sorted((r.item_id, r.doc_id, r.score, r.rank) for r in plain.collect()) == sorted((r[0], r[1], r[2], r[3]) for r in want)
    monkeypatch.setattr(retrieve, "QUERY_TERMS", 2)
    assert sorted(map(tuple, retrieve.bm25_topk(docs, queries, 5).collect())) == want
    assert retrieve.bm25_topk(docs.limit(0), queries).count() == 0 == retrieve.bm25_topk(docs, queries.limit(0)).count()


def test_supported_numbers_against_plain_search(spark):
    import random
    import re

    rng = random.Random(6)
    pieces = ["1,234", "234", "12万", "12", "5.5", "5", "99", "1,000,000", "000", "7亿"]
    numbers = [(k, rng.choice(pieces + ["8,765", "3.25", "4,321,000万"])) for k in range(40)]
    texts = [(k, " x ".join(rng.choice(pieces) for _ in range(rng.randint(0, 3)))) for k in range(12)] + [(50, None), (51, "9" * 700 + "12万")]
    got = {r.number: (r.exact_in, r.confidence) for r in evidence.supported(spark.createDataFrame(numbers, "id long, number string"), spark.createDataFrame(texts, "ord long, text string")).collect()}
    for number in {n for _, n in numbers}:
        exact = min((o for o, t in texts if t and number in t), default=None)
        runs = re.findall(r"\d+\.?\d*", number)
        share = max((sum(r in t for r in runs) / len(runs) for _, t in texts if t), default=0)
        assert got[number] == (exact, round(1.0 if exact is not None else share, 4)), number


def test_rounds_of_searching_end(spark):
    from siftline.operators import workflow

    tasks = spark.createDataFrame([(1, "auto"), (2, "disabled"), (3, "auto"), (4, "enabled")], "task_id long, mode string")
    subs = spark.createDataFrame([(t, p, f"sub topic {p} of {t}") for t in (1, 2, 3, 4) for p in range(3)], "task_id long, pos int, sub_query string")
    materials = spark.createDataFrame([(1, 0, "one", "http://a/0"), (3, 0, "x", "http://b/0"), (3, 1, "y", "http://b/1")], "task_id long, ord long, text string, url string")
    calls = []

    def search(asked):
        calls.append(sorted((r.task_id, r.query) for r in asked.collect()))
        hits = F.array(*(F.struct(F.lit(p).alias("pos"), F.lit(u).alias("url"), F.concat("query", F.lit(f" hit {p}")).alias("content")) for p, u in enumerate(("http://a/0", "http://spam/1", "http://c/2", "http://c/3"))))
        return asked.dropDuplicates(["task_id"]).select("task_id", F.inline(hits)).where("task_id <> 4")

    got = workflow.searched_again(tasks, subs, materials, search, ["a"], ["spam"])
    rows = sorted((r.task_id, r.ord, r.url) for r in got.collect())
    assert rows == [(1, 0, "http://a/0"), (1, 1, "http://c/2"), (3, 0, "http://b/0"), (3, 1, "http://b/1")]
    assert calls[0] == [(t, f"sub topic {p} of {t}") for t in (1, 4) for p in (0, 1)]  # the first two missing topics
    assert [c[0][0] for c in calls] == [1, 4]  # then the task that has found nothing, and no third round


def test_nearest_by_chunks(spark):
    """Distances with the same six digits rank by the smaller id, and chunks lose nothing."""
    import numpy as np

    at = [[1.0000002], [1.0000001], [5.0], None, [1.0, 2.0]] + [[3.0 + (i * 37 % 101)] for i in range(101)]
    vectors = spark.createDataFrame(list(enumerate(at)), "vec_id long, embedding array<double>").coalesce(1)
    asked = spark.createDataFrame([(7, [0.0]), (8, [50.0])], "query_id long, embedding array<double>")
    got = retrieve.nearest(vectors, asked, 1).collect()
    assert sorted((r.query_id, r.vec_id) for r in got)[0] == (7, 0)
    for block in (1, 3, 1000):
        got = sorted((r.query_id, r["rank"], r.vec_id) for r in retrieve.nearest(vectors, asked, 5, block=block).collect())
        want = []
        for q, x in ((7, 0.0), (8, 50.0)):
            order = sorted((float(np.round(abs(v[0] - x), 6)), i) for i, v in enumerate(at) if v and len(v) == 1)
            want += [(q, n + 1, i) for n, (_, i) in enumerate(order[:5])]
        assert got == want


def test_semantic_match_finds_other_vectors(spark):
    from siftline.plans.registered import QUERIES

    rows = QUERIES["semantic_match"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 25 and all(r.vec_id != r.query_id for r in rows)


def test_terms_are_counted_without_a_shuffle(spark, monkeypatch):
    rows = [(1, "aa bb aa"), (2, "aa"), (3, None), (4, "cc aa"), (None, "xx")]
    docs = lambda x: spark.createDataFrame(x, "doc_id long, text string")
    plain = lambda x: sorted(map(str, (tuple(r) for r in retrieve.term_counts(docs(x)).collect())))
    want = [(1, "aa", 2), (1, "bb", 1), (2, "aa", 1), (4, "aa", 1), (4, "cc", 1), (None, "xx", 1)]
    assert plain(rows) == sorted(map(str, want))
    assert "Exchange" not in retrieve.term_counts(docs(rows))._jdf.queryExecution().toString()
    more = [(1, "aa dd"), (None, "xx yy")]
    want = [(1, "aa", 3), (1, "bb", 1), (1, "dd", 1), (2, "aa", 1), (4, "aa", 1), (4, "cc", 1), (None, "xx", 2), (None, "yy", 1)]
    monkeypatch.setattr(retrieve, "TOKENS", 2)
    assert plain(rows + more) == sorted(map(str, want))


def test_bm25_by_pieces(spark, monkeypatch):
    """Pieces of few tokens and few scores give what whole batches give."""
    import random

    rng = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(300)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, " ".join(rng.choices(words, k=8))) for i in range(9)], "item_id long, text string")
    want = {(r.item_id, r.doc_id): r.score for r in retrieve.bm25(docs, asked).collect()}
    best = {i: sorted((-s, d) for (j, d), s in want.items() if j == i)[:5] for i in range(9)}
    for tokens, scores in ((1 << 18, 1 << 22), (50, 20)):
        monkeypatch.setattr(retrieve, "TOKENS", tokens)
        monkeypatch.setattr(retrieve, "SCORES", scores)
        got = retrieve.bm25_topk(docs, asked, 5).collect()
        assert sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == [(i, n + 1, d, -s) for i in range(9) for n, (s, d) in enumerate(best[i])]


def test_merged_hits_scores_documents_once(spark):
    from siftline.plans.registered import QUERIES

    plan = QUERIES["merged_hits"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_pages_are_parsed_a_few_at_once():
    import pyarrow as pa

    from siftline.operators import pagebody

    batch = pa.RecordBatch.from_pydict({"page_id": list(range(1000))})
    parts = list(pagebody.few(iter([batch, batch.slice(0, 0), batch.slice(0, 1)])))
    assert max(p.num_rows for p in parts) <= 64 and [x for p in parts for x in p.column(0).to_pylist()] == [*range(1000), 0]
