import hashlib
import random
import re

import pytest

from siftline.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = {}
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.setdefault(kind, []).append(m.span())
    return out


def test_base_against_the_patterns():
    rng = random.Random(3)
    pool = list("ab.@+-% 0123456789()_") + ["a@b.c", "1.2.3.4", "4111 1111 1111 1111", "+1 (555) 123-4567", "é", "\n", "@", "."]
    for _ in range(6000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 30)))
        base, _ = pii.find(text)
        assert {k: v for k, v in base.items() if v} == brute(text), text


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + " 1@", "a@" * 100_000, "+1" + "(" * 300_000, "1." * 200_000):
        pii.find(text)


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail jane.doe [at] example [dot] org now", "email", "jane.doe [at] example [dot] org"),
        ("mail jane at example dot com now", "email", "jane at example dot com"),
        ("mail jane(at)example.org", "email", "jane(at)example.org"),
        ("mail jаne＠example．org now", "email", "jаne＠example．org"),
        ("mail ja​ne@exam​ple.org", "email", "ja​ne@exam​ple.org"),
        ("host one nine two dot one six eight dot zero dot one end", "ip", "one nine two dot one six eight dot zero dot one"),
        ("card ４１１１ １１１１ １１１１ １１１１.", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("card " + "four " + "one " * 15 + "end", "card", ("four " + "one " * 15).strip()),
        ("call plus one five five five one two three four five six seven", "phone", "plus one five five five one two three four five six seven"),
    ],
)
def test_disguises(text, kind, found):
    a = text.index(found)
    _, more = pii.find(text)
    assert (a, a + len(found)) in more.get(kind, []), (more, [text[x:y] for v in more.values() for x, y in v])


def test_plain_prose_stays_clean():
    for text in ["look at the dot pattern", "we met at example.com today", "one two three go", "at noon the point was made", "Zwei von drei. Un point de vue."]:
        assert pii.find(text) == ({}, {}) or not any(pii.find(text)[1].values())


def test_trigger_is_a_superset():
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = ["a@b.c", "1.2.3.4", "jane at example dot com", "jane at example . com", "x [at] y", "ja​ne", "one two three four", "plain words only"]
    assert pc.match_substring_regex(pa.array(texts), pii.TRIGGER).to_pylist() == [True] * 7 + [False]


def test_query_and_mask(spark):
    rows = [(1, "é a@b.co 4111111111111111", "x", 1), (2, None, "y", 2), (2, None, "y", 2), (3, "", None, 3), (4, "x " * 50000 + "1.2.3.4", "z", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, key int")
    found = {r.doc_id: [tuple(x) for x in r.spans] for r in pii.spans(docs).collect()}
    assert found == {1: [("email", 2, 8, True), ("card", 9, 25, True)], 2: [], 3: [], 4: [("ip", 100000, 100007, True)]}
    clean = sorted((r.doc_id, r.text) for r in pii.mask(docs).collect() if r.doc_id != 2)
    assert clean == [(1, "é <EMAIL> <CARD>"), (3, ""), (4, "x " * 50000 + "<IP>")]
    assert pii.spans(docs.limit(0)).count() == 0


def test_query_columns(spark):
    got = pii.op2_pii(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(got) == len(docs)
    for r in got:
        want = brute(docs[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(want.get(k, [])) for k in pii.KINDS)
        assert r.base_sha256 == hashlib.sha256(pii.joined(want).encode()).hexdigest()


def test_bare_words_need_a_sign_of_an_address():
    from siftline.llm.pii import find

    def more(text):
        return [(k, text[a:b]) for k, spans in find(text)[1].items() for a, b in spans]

    assert more("mail jane at example.com now") == [("email", "jane at example.com")]
    assert more("jane_doe at example.com") == [("email", "jane_doe at example.com")]
    assert more("contact: jane at firma dot swiss") == [("email", "jane at firma dot swiss")]
    assert more("jane at firma dot com") == [("email", "jane at firma dot com")]
    assert more("escribe a ana arroba casa punto museum") == [("email", "ana arroba casa punto museum")]
    for clean in ("look at example.com", "we are at this point in time", "look at polka dot patterns", "one 2 3 and 4", "arrive at station.Then go"):
        assert more(clean) == [], clean
    assert more("card 4 one 1 1 1111 1111 1111 ok") == [("card", "4 one 1 1 1111 1111 1111")]
