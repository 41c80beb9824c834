import pytest

from siftline.plans.registered import QUERIES, SQL

from .oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    assert not compare(spark, QUERIES[name], SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_report_chunks_keep_what_the_reference_keeps(spark):
    sf = "/root/testdata/sf0.01"
    parts = {}
    for r in sorted(QUERIES["report_chunks"](spark, sf).collect(), key=lambda r: r.chunk_no):
        parts.setdefault(r.doc_id, []).append(r.text)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) between 8001 and 12000").collect()}
    assert texts and all("".join(parts[d]) == t for d, t in texts.items())  # three parts hold 12,000 characters at least
    assert all(len(p) <= 3 and max(map(len, p)) <= 6000 for p in parts.values())
