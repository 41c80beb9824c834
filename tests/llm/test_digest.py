import hashlib
import unicodedata

import pytest
from pyspark.sql import functions as F

from siftline.llm import digest


def canonical(text):
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    return " ".join(t.split())


def check(rows, got):
    rows = sorted(rows)
    ids = [d for d, _ in rows]
    want = {}
    for n, (d, text) in enumerate(rows):
        text, after = text or "", rows[(n + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        same = canonical(text)
        want[d] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), float(same == canonical(edited)), float(same == canonical(after)), same, canonical(edited))
    assert sorted(r.doc_id for r in got) == ids
    prints = {}
    for r in got:
        n, sha, near_edited, near_next, same, edited = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) == (n, sha, near_edited, near_next), r
        for text, value in ((same, r.fingerprint), (edited, r.edited_fingerprint)):
            assert prints.setdefault(text, value) == value
    assert len(set(prints.values())) == len(prints)


ODD = ["Straße", "STRASSE", "ﬁne  é\n", "fine é", "FINE É", "", " ", None, "🙂🙃🙂", "ﾊﾝｶｸ", "ハンカク", "Ⅷ½", "x" * 60000, "a ᾳ̈", "q̣̇ q̣̇", "ΑΣ ας", "İi ı", "a b　c d"]


def test_against_a_plain_version(spark):
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pydict()
    rows = list(zip(table["doc_id"], table["text"])) + [(1000 + 7 * i, t) for i, t in enumerate(ODD)]
    check(rows, digest.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_clashing_hashes_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(digest, "wide", lambda canon: F.struct((F.length(canon) % 2).cast("long").alias("h0"), F.lit(0).cast("long").alias("h1")))
    rows = [(i, t) for i, t in enumerate(["aa", "AA", "bb", "a", "b", "cc", "bb ", "", None])]
    check(rows, digest.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_repeats_nulls_and_names(spark):
    rows = [(1, "abcd", 1, "k"), (1, "abcd", 1, "k"), (2, "xy", 2, "h"), (2, "zw", 2, "h"), (None, "q", 3, "n")]
    got = digest.fingerprints(spark.createDataFrame(rows, "doc_id long, text string, n int, k string")).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "2", "2", "None"]
    first = {r.edited_sha256 for r in got if r.doc_id == 1}
    assert len(first) == 1 and first <= {hashlib.sha256(x).hexdigest() for x in (b"abxy", b"abzw")}
    one = digest.fingerprints(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).collect()
    check([(5, "abcd")], one)
    assert digest.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("text", ODD)
def test_canonical_form(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(digest.canonical(F.col("t"))).first()[0]
    assert got == canonical(text)
