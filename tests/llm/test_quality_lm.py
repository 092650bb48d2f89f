import math
import struct

import xxhash

from loomgraph.llm import quality_lm as Q
from tests.llm.test_quality_codes import brute


def test_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    seen = labels.where("doc_id % 2 = 0")
    rows = Q.judged(docs, seen).join(labels.where("doc_id % 2 = 1").dropDuplicates(["doc_id"]), "doc_id").select("quality", "keep").collect()
    good, bad = [r[1] for r in rows if r[0] == 1], [r[1] for r in rows if r[0] == 0]
    assert sum(good) >= 0.99 * len(good)
    assert sum(bad) <= 0.2 * len(bad)


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: (r.text, r.lang) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    marks = {}
    for r in spark.read.parquet(f"{d}/labels.parquet").collect():
        marks[r.doc_id] = min(marks.get(r.doc_id, 1), r.quality)
    held = lambda k: struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(struct.pack("<q", k), seed=42)))[0] % Q.HELD == 0
    trusted = [k for k in docs if marks.get(k) == 1]
    figure = brute([docs[k][0] or "" for k in trusted if not held(k)], Q.ORDER)
    figures = {k: figure(t) if t else None for k, (t, _) in docs.items()}
    quantile = lambda x: sorted(x)[math.ceil(Q.QUANTILE * len(x)) - 1] * Q.MARGIN
    sets = [(docs[k][1], figures[k]) for k in trusted if held(k) and figures[k] is not None]
    assert len(sets) > 5
    own = {lang: [f for x, f in sets if x == lang] for lang, _ in sets}
    limit = {lang: quantile(f) for lang, f in own.items() if len(f) >= Q.FEWEST}
    overall = quantile([f for _, f in sets])
    got = Q.op6_quality_lm(spark, d).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        assert abs(math.log(r.threshold) - limit.get(r.lang, overall)) < 1e-9
        assert r.perplexity is None and r.keep if figures[r.doc_id] is None else abs(math.log(r.perplexity) - figures[r.doc_id]) < 1e-9
        if figures[r.doc_id] is not None and figures[r.doc_id] <= limit.get(r.lang, overall):
            assert r.keep


def test_cases(spark):
    rows = [(k, "the cat sat on the mat again", "en", 5, k, "y") for k in range(40)] + [(50, None, "en", 1, 1, "y"), (51, "", None, 1, 1, "y"), (None, "the cat", None, 1, 1, "y"), (52, "#### %%%% $$$$ ZZZZ" * 20, "en", 1, 1, None), (52, "the mat", "xx", 1, 1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n long, key long, gone string")
    docs = docs.withColumnsRenamed({"n": "__text", "key": "__key"})
    labels = spark.createDataFrame([(k, 1) for k in range(40)] + [(39, 0), (None, 1), (50, 1)], "doc_id long, quality int")
    kept = Q.filter_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 1
    assert Q.filter_documents(docs, labels.limit(0)).count() == len(rows)
    assert Q.filter_documents(docs.limit(0), labels).count() == 0


def test_both_ways_to_reject(spark, monkeypatch):
    rows = [(k, f"the cat sat on the mat {k}", "en") for k in range(60)] + [(100, "#%$" * 90, "en"), (100, "the cat sat", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1) for k in range(60)], "doc_id long, quality int")
    want = sorted(r for r in rows if not r[1].startswith("#"))
    assert sorted(map(tuple, Q.filter_documents(docs, labels).collect())) == want
    monkeypatch.setattr(Q, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, Q.filter_documents(docs, labels).collect())) == want
