import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import substring_dedup as S


def brute(docs, window):
    first = {}
    for doc_id, text in docs:
        w = (text or "").encode().split()
        for k in range(len(w) - window + 1):
            if doc_id is not None:
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in docs:
        w = (text or "").encode().split()
        gone = set()
        for k in range(len(w) - window + 1):
            if doc_id is not None and first[tuple(w[k : k + window])] < doc_id:
                gone |= set(range(k, k + window))
        out.append((doc_id, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out, key=str)


def planted(seed, n=150):
    rng = np.random.default_rng(seed)
    vocab = [f"w{k}é" for k in range(40)]
    passages = [list(rng.choice(vocab, int(rng.integers(45, 120)))) for _ in range(6)]
    docs = []
    for k in range(n):
        parts = list(rng.choice(vocab, int(rng.integers(0, 80))))
        for _ in range(int(rng.integers(0, 3))):
            p = passages[int(rng.integers(len(passages)))]
            a = int(rng.integers(0, 20))
            parts += p[a : len(p) - int(rng.integers(0, 20))] + list(rng.choice(vocab, int(rng.integers(0, 9))))
        if k % 9 == 0 and docs:
            parts = (docs[-1][1] or "").split()
            if parts:
                parts[len(parts) // 2] = "changed"
        docs.append((int(rng.integers(0, 10_000)) * 1000 + k, " ".join(parts)))
    docs += [(5, None), (6, ""), (None, docs[3][1]), (docs[4][0], docs[7][1]), docs[8], docs[8], (1, "be " * 400), (2, "\tbe\n" * 300), (3, "be be " * 24)]
    return docs


@pytest.mark.parametrize("rows", [S.BROADCAST_ROWS, 0])
def test_against_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(S, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(S, "ROWS", 7)
    docs = planted(0 if rows else 1)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, th string, spans int")
    assert sorted(map(tuple, S.summary(df).collect()), key=str) == brute(docs, 50)


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, S.op10_substring_dedup(spark, d).collect()), key=str) == brute(docs, 50)


def test_remove_and_factors(spark):
    docs = planted(3)
    df = spark.createDataFrame([(d, t, len(t or ""), "l", 1) for d, t in docs], "doc_id long, text string, n_chars long, th string, spans int")
    want = {(d, s) for d, n, gone, s in brute(docs, 50) if not gone or gone < n}
    got = S.remove(df.withColumn("__th", F.lit(2)).withColumn("c0", F.lit(3))).collect()
    assert {(r.doc_id, hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest()) for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got if r.text is not None) and {(r.th, r.spans, r["__th"], r.c0) for r in got} == {("l", 1, 2, 3)}
    texts = {}
    for d, t in docs:
        texts.setdefault(d, []).append((t or "").split())
    found = S.duplicate_factors(df).collect()
    assert found
    for f in found:  # a factor stands in its reference as one passage
        own = [tuple(w[f.start : f.start + f.size]) for w in texts[f.doc_id]]
        assert f.size >= 50 and f.ref_doc_id < f.doc_id
        assert any(tuple(w[f.ref_start : f.ref_start + f.size]) in own for w in texts[f.ref_doc_id])
    assert S.summary(df.limit(0)).count() == 0


def test_factors_go_on_while_the_reference_does():
    seed = lambda start, size, ref, place: dict(start=start, size=size, ref=ref, place=place)
    assert S.factors([seed(1, 50, 7, 11), seed(0, 50, 7, 10), seed(2, 50, 7, 12)]) == [(0, 52, 7, 10)]
    # another reference takes over: windows that cross the boundary belong to it; one inside a factor adds nothing
    assert S.factors([seed(0, 60, 7, 10), seed(5, 50, 3, 0), seed(20, 50, 3, 90), seed(100, 50, 7, 110)]) == [(0, 60, 7, 10), (20, 50, 3, 90), (100, 50, 7, 110)]
