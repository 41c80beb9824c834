import random
import re

import numpy as np
import pyarrow as pa
import pytest

from siftline.llm import decontam


def toks(text):
    return re.sub(r"[!-/:-@\[-`{-~\x00-\x08\x0e-\x1f\x7f]", "", text or "").lower().split()


def brute(item, text):
    """Least word edits between the item and any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item):
        new = [i + 1]
        for j, y in enumerate(text):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_distance_against_dynamic_programming():
    rng = random.Random(4)
    for _ in range(300):
        a = [rng.randrange(6) for _ in range(rng.randint(1, 70))]
        b = [rng.randrange(6) for _ in range(rng.randint(0, 90))]
        assert decontam.distance(np.array(a, np.uint64), np.array(b, np.uint64))[0] == brute(a, b)


def edited(words, edits, rng, vocabulary):
    out = list(words)
    for _ in range(edits):
        how = rng.randrange(3)
        at = rng.randrange(len(out))
        if how == 0:
            out[at] = rng.choice(vocabulary)
        elif how == 1:
            del out[at]
        else:
            out.insert(at, rng.choice(vocabulary))
    return out


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(6)
    vocabulary = [f"v{rng.randrange(900)}" for _ in range(900)] + ["the", "of", "and"] * 200
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 60)))) for i in range(60)]
    docs = []
    for d in range(600):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(20, 200))]
        if d % 2:
            item = items[d % 60][1].split()
            at = rng.randrange(len(body))
            share = (0, 0.1, 0.2)[d // 2 % 3]
            body[at:at] = edited(item, int(share * len(item)), rng, vocabulary)
        docs.append((d, " ".join(w + rng.choice(["", "", ",", "."]) for w in body).capitalize()))
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    return items, docs, got


def test_all_results_are_right_and_recall(planted):
    items, docs, got = planted
    texts, own = {d: toks(t) for d, t in docs}, {i: toks(t) for i, t in items}
    want = {(d, i): e for d, t in texts.items() for i, x in own.items() if (e := brute(x, t)) <= int(decontam.SHARE * len(x))}
    found = {(r.doc_id, r.item_id): r.edits for r in got}
    assert set(found) <= set(want)
    exact = {k for k, e in want.items() if e == 0}
    assert exact <= set(found)
    assert len(found) >= 0.95 * len(want), (len(found), len(want))
    assert sum(found[k] == want[k] for k in found) >= 0.97 * len(found)


def test_spans_hold_the_passage(planted):
    items, docs, got = planted
    texts, own = dict(docs), {i: toks(t) for i, t in items}
    for r in got:
        assert brute(own[r.item_id], toks(texts[r.doc_id][r.start : r.end])) == r.edits


@pytest.mark.parametrize("words", [5, 10, 16, 24, 30, 48, 64, 96, 120, 384, 700])
@pytest.mark.parametrize("spread", [False, True])
def test_recall_at_the_edit_limit(words, spread):
    rng = random.Random(words)
    other = lambda n: [f"w{rng.getrandbits(60)}" for _ in range(n)]
    items = [other(words) for _ in range(200 if words < 100 else 30)]
    edits, docs = int(decontam.SHARE * words), []
    for item in items:
        if spread:  # one edit in every stretch of the item
            at = {int((k + 0.5) * words / edits) for k in range(edits)}
            changed = [y for k, x in enumerate(item) for y in (rng.choice([[], other(1), [x, *other(1)]]) if k in at else [x])]
        else:
            changed = edited(item, edits, rng, other(50))
        docs.append(" ".join([*other(30), *changed, *other(30)]))
    index, found = decontam.build([(k, " ".join(x)) for k, x in enumerate(items)]), 0
    for first, data, at in decontam.slices(pa.array(docs)):
        w, _ = decontam.tokens(data, at)
        found += sum(first + t == k for t, k, *_ in decontam.matches(index, w.hash, w.doc))
    assert found >= decontam.RECALL * len(items)


def test_odd_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "!!!", 0), (4, "É one, two THREE four five six. " + "x " * 40000, 0), (4, "É one, two THREE four five six. " + "x " * 40000, 0), (None, "one two three four five six", 0)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(7, "one two three four five six"), (7, "one two three four five six"), (8, None), (9, ""), (10, "..."), (11, "zzz")], "item_id long, text string")
    want = [(None, 7, 0, 6, 0, 27), (4, 7, 0, 6, 2, 30), (4, 7, 0, 6, 2, 30)]
    assert sorted(map(tuple, decontam.leaks(docs, bench).collect()), key=str) == sorted(want, key=str)
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 5)
    assert sorted(map(tuple, decontam.leaks(docs, bench).collect()), key=str) == sorted(want, key=str)
    assert decontam.leaks(docs.limit(0), bench).count() == 0
    assert decontam.leaks(docs, bench.limit(0)).count() == 0
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns


def test_query_finds_planted_passages(spark):
    import pyarrow.parquet as pq

    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pydict()
    bench = pq.read_table("/root/testdata/sf0.001/benchmark.parquet").to_pydict()
    own = {i: toks(t) for i, t in zip(bench["item_id"], bench["text"])}
    want = set()
    for d, t in zip(docs["doc_id"], docs["text"]):
        text = toks(t)
        here = set(text)
        want |= {(d, i) for i, x in own.items() if len(here & set(x)) >= 0.6 * len(set(x)) and brute(x, text) <= int(decontam.SHARE * len(x))}
    got = {(r.doc_id, r.item_id) for r in decontam.op1_decontam(spark, "/root/testdata/sf0.001").collect()}
    assert want and got == want
