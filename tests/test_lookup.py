"""Orders, keys of the data and topics over whole tables, against plain versions."""

import random

from siftline.operators import lookup, order, validation, workflow
from siftline.plans.registered import QUERIES, SQL

from .oracle import compare


def test_numbers_have_no_gaps_whatever_the_skew(spark):
    rows = [("hot" if i % 3 else f"k{i}", i * 7 % 1000) for i in range(2000)] + [(None, 5), (None, None)]
    got = order.numbered(spark.createDataFrame(rows, "a string, b int").repartition(7), "a", "b").orderBy("number").collect()
    first = lambda x: (x is not None, x if x is not None else 0)
    assert [r.number for r in got] == list(range(len(rows)))
    assert [(r.a, r.b) for r in got] == sorted(rows, key=lambda r: ((r[0] is not None, r[0] or ""), first(r[1])))
    assert order.numbered(spark.createDataFrame([], "a string, b int"), "a", "b").count() == 0


def test_keys_of_the_data_find_their_first_text(spark):
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("ab1é市😀 ") for _ in range(n))
    texts = [(i if i % 50 else None, word(rnd.randrange(0, 400)) if i % 7 else rnd.choice([None, ""])) for i in range(300)] + [(1, "zz"), (0, "zz")]
    keys = [(word(rnd.randrange(1, 26)),) for _ in range(500)] + [("",), (None,), ("zz",), ("zz",)]
    got = {r.key: r.ord for r in lookup.first_holders(spark.createDataFrame(keys, "key string"), spark.createDataFrame(texts, "ord long, text string")).collect()}
    want = {}
    for (k,) in keys:
        held = [o for o, t in texts if k and len(k) <= 20 and o is not None and t and k in t]
        if held:
            want[k] = min(held)
    assert got == want and len(want) > 80
    none = spark.createDataFrame([], "key string")
    assert lookup.first_holders(none, spark.createDataFrame(texts, "ord long, text string")).count() == 0


def test_a_full_bit_map_costs_rows_only(spark):
    keys, texts = [(f"k{i}",) for i in range(200)], [(i, f"k{i} and k{i // 2}") for i in range(150)]
    got = {r.key: r.ord for r in lookup.first_holders(spark.createDataFrame(keys, "key string"), spark.createDataFrame(texts, "ord long, text string"), bits=6).collect()}
    assert got == {k: min(o for o, t in texts if k in t) for (k,) in keys if any(k in t for _, t in texts)}


def test_items_keep_their_places_by_label(spark):
    items = spark.createDataFrame([(3, "a", "x"), (1, "a", None), (1, "a", "b"), (2, None, "n"), (5, None, "m"), (4, "b", "")], "ord long, label string, value string")
    got = sorted(((r.label or "", r.first, r.place, r.value) for r in workflow.by_label(items).collect()), key=lambda r: r[:3])
    assert got == [("", 2, 1, "n"), ("", 2, 2, "m"), ("a", 1, 1, None), ("a", 1, 2, "b"), ("a", 1, 3, "x"), ("b", 4, 1, "")]


def test_topics_count_over_borders_of_short_and_empty_texts(spark, monkeypatch):
    monkeypatch.setattr(validation, "BLOCK", 32)
    rnd = random.Random(9)
    piece = lambda most: "".join(rnd.choice("ab ") for _ in range(rnd.randrange(0, most)))
    texts = {t: [rnd.choice([None, "", piece(4), piece(4), piece(9)]) for _ in range(rnd.choice([1, 3, 12, 90]))] for t in range(40)}
    subs = [(t, pos, rnd.choice(["", None, "   ", piece(26), "a b", "b a b", "a  b a", "b   a", "ab a b a"])) for t in range(42) for pos in range(8)]
    materials = spark.createDataFrame([(t, i, x) for t, xs in texts.items() for i, x in enumerate(xs)], "task_id long, ord long, text string")
    got = {}
    for r in validation.missing_topics(spark.createDataFrame(subs, "task_id long, pos long, sub_query string"), materials).collect():
        got.setdefault(r.task_id, []).append(r.pos)
    want, over = {}, 0
    for t, pos, s in subs:
        key, whole = (s or "")[:20].strip(" "), " ".join(x or "" for x in texts.get(t, []))
        if s and (not key or whole.count(key) < 2) and len(want.setdefault(t, [])) < 2:
            want[t].append(pos)
        over += bool(key) and whole.count(key) >= 2 > sum((x or "").count(key) for x in texts.get(t, []))
    assert {t: sorted(p) for t, p in got.items()} == {t: p for t, p in want.items() if p} and over > 5
    assert validation.missing_topics(spark.createDataFrame(subs, "task_id long, pos long, sub_query string"), materials.limit(0)).count() > 0


def test_rewritten_plans_equal_their_sql_at_the_next_size(spark):
    for name in ("missing_topics", "items_by_label", "quantity_sources", "missing_subtopics"):
        assert not compare(spark, QUERIES[name], SQL[name], "/root/testdata/sf0.01"), name
