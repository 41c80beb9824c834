import hashlib

import pyarrow.parquet as pq
from tokenizers import Tokenizer

import corpus_pipeline
from siftline.llm import bpe, decontam, pii, ppm

from .test_decontam import brute as edits
from .test_decontam import toks
from .test_minhash import brute as components
from .test_ppm import brute as bits

SF = "/root/testdata/sf0.001"


def test_run_against_a_plain_version(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    bench = [toks(r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    sample = ppm.sample(spark.read.parquet(f"{SF}/documents.parquet"))
    small = {k: v[:3] for k, v in sample.items()}  # any few texts show that prose is far under the limit
    left = [d for d in docs if any(c.isalpha() for c in d["text"])]
    assert all(min(bits(small, d["text"][:300]).values()) / len(d["text"][:300].encode()) < ppm.MOST_BITS for d in left[:20])
    group = components([(d["doc_id"], d["text"]) for d in left], 5)
    left = [d for d in left if group[d["doc_id"]][1] == d["doc_id"]]

    def leaked(text):
        t = toks(text)
        have = set(t)
        return any(len(have & set(x)) >= 0.6 * len(set(x)) and edits(x, t) <= int(decontam.SHARE * len(x)) for x in bench)

    left = [d for d in left if not leaked(d["text"])]
    library = Tokenizer.from_file(bpe.vocabulary_path())
    want = {}
    for d in left:
        text = pii.masked_text(d["text"])
        ids = library.encode(text, add_special_tokens=False).ids
        want[d["doc_id"]] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want
    assert len(want) < len(docs)


def test_stages_keep_the_columns_and_take_odd_rows(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "12 !!", "en", "s", 5), (4, "the cat sat on the mat with a@b.com", "en", "s", 35), (4, "the cat sat on the mat with a@b.com", "en", "s", 35), (5, "le chat", None, "s", 7)]
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == schema.names
        out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
        assert len(out) == (2 if given else 0) or {r.doc_id for r in out} <= {4, 5}
