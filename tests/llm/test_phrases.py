import random
import re
from collections import Counter

from siftline.llm import phrases
from tests.oracle import compare

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least, top, most=5):
    total, count = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, most + 1):
                for i in range(len(w) - n + 1):
                    count[lang, tuple(w[i : i + n])] += 1
    often = {k: v for k, v in count.items() if len(k[1]) > 1 and v >= least}
    inside = {(lang, p[i : i + m], a) for (lang, p), a in often.items() for m in range(2, len(p)) for i in range(len(p) - m + 1)}
    found = []
    for (lang, p), a in often.items():
        cuts = [((1000 * a * total[lang]) // (count[lang, p[:k]] * count[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        if (lang, p, a) not in inside:
            found.append((lang, -score, -a, " ".join(p).encode(), count[lang, p[:k]], count[lang, p[k:]], total[lang]))
    out, rank = [], Counter()
    for lang, score, a, p, left, right, n in sorted(found):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], p.decode(), -a, left, right, n, -score))
    return out


def run(spark, rows, **how):
    docs = spark.createDataFrame([(lang, text, "x", 1) for lang, text in rows], "lang string, text string, phrase string, n int")
    return sorted(tuple(r) for r in phrases.collocations(docs, **how).select(COLUMNS).collect())


def test_against_counting(spark):
    rng = random.Random(3)
    vocabulary = ["the", "The", "of", "new", "york", "città", "a b", "𝒳", "e-mail"]
    text = lambda: "".join(rng.choice(vocabulary) + rng.choice([" "] * 8 + ["\t", "  ", ". ", ",", "\n", "\x0b", "!? "]) for _ in range(rng.randint(0, 60)))
    rows = [(rng.choice(["en", "de", None, "und", ""]), text()) for _ in range(150)]
    for least, top in ((5, 2000), (12, 7)):
        got = run(spark, rows, least=least, top=top)
        assert got and got == sorted(brute(rows, least, top))


def test_hash_clashes_keep_words_apart(spark, monkeypatch):
    import numpy as np

    w = next(w for _, w in phrases.words(__import__("pyarrow").array(["a b A c"]), space=phrases.GAP))
    w.hash = np.zeros(4, np.uint64)
    assert phrases.word_numbers(w).tolist() == [0, 1, 0, 2]


def test_odd_rows(spark):
    assert run(spark, [(None, None), ("en", None), ("en", ""), ("en", " .,; ")], least=1) == []
    empty = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(empty).collect() == [] and phrases.collocations(empty).columns == COLUMNS
    long = ("en", "on and on " * 40_000)
    assert run(spark, [long, ("en", "x y"), ("en", "x y")], least=2) == sorted(brute([long, ("en", "x y"), ("en", "x y")], 2, 2000))


def test_query_against_sql(spark):
    assert not compare(spark, phrases.op11_phrases, phrases.SQL_OP11, "/root/testdata/sf0.01")
