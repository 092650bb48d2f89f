import hashlib
from collections import Counter

import corpus_pipeline as C
from tests.llm import test_ngram_join as N
from tests.llm import test_packing as P
from tests.llm import test_substring_dedup as S

D = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in C.STAGES]
    assert len(names) == 4
    kept = C.written(C.STAGES[0][1](spark, docs, D), "test")
    assert kept.columns == columns
    good = {r.doc_id for r in spark.read.parquet(f"{D}/labels.parquet").where("quality = 1").collect()}
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert len(good & ids) >= 0.97 * len(good)

    rows = [(r.doc_id, r.text) for r in kept.collect()]
    one = C.written(C.STAGES[1][1](spark, kept, D), "test")
    want = {d for d, _, c in N.brute(rows) if d == c}
    assert one.columns == columns and {r.doc_id for r in one.collect()} == want

    rows = [(r.doc_id, r.text) for r in one.collect()]
    cut = C.written(C.STAGES[2][1](spark, one, D), "test")
    want = {(d, s) for d, n, gone, s in S.brute(rows, 50) if not gone or gone < n}
    assert cut.columns == columns and {(r.doc_id, hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest()) for r in cut.collect()} == want
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    packed = C.STAGES[3][1](spark, cut, D).collect()
    P.check([(r.doc_id, r.text) for r in cut.collect()], packed)
    assert max(Counter(r.sequence_id for r in packed).values()) <= C.MAX_PIECES


def test_run(spark):
    got = C.run(spark, D)
    assert got.count() > 0 and got.columns == P.P.PIECES.replace(" long", "").replace(" int", "").split(", ") + ["sequence_id", "offset"]
