import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomgraph.llm import packing as P

JSON = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_cuts():
    assert P.cuts(1, 4) == [(0, 1)]
    assert P.cuts(4, 4) == [(0, 4)]
    assert P.cuts(9, 4) == [(0, 1), (1, 4), (5, 4)]


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_every_capacity_holds(score):
    lengths = np.random.default_rng(1).integers(1, 2049, 3000)
    for capacity in ((2048, 2048, 2048.0**2), (2048, 3, 2048.0**2), (2048, 50, 1.3e6)):
        place, offset = P.best_fit(lengths, capacity, P.WEIGHTS, score)
        for b in np.unique(place):
            own = place == b
            assert lengths[own].sum() <= capacity[0] and own.sum() <= capacity[1]
            assert own.sum() == 1 or (lengths[own].astype(float) ** 2).sum() <= capacity[2] + 1
            at = np.argsort(offset[own])
            assert (offset[own][at] == np.concatenate([[0], np.cumsum(lengths[own][at])[:-1]])).all()
    place, _ = P.best_fit(lengths, (2048, 2048, 2048.0**2), P.WEIGHTS, score)
    assert place.max() + 1 <= 1.05 * np.ceil(lengths.sum() / 2048)
    with pytest.raises(ValueError):
        P.best_fit(np.array([5000]), (2048, 9, 9e9), (1, 1, 1))


def plain_best_fit(lengths, capacity, weights, score):
    """Places of the pieces, one look at every sequence a piece."""
    bins, place = [], {}
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        need = [lengths[k] / capacity[0], 1 / capacity[1], lengths[k] ** 2 / capacity[2]]
        worth = {}
        for b, room in enumerate(bins):
            left = [r - n for r, n in zip(room, need)]
            if min(left) >= -1e-12:
                worth[b] = -sum(w * x * x for w, x in zip(weights, left)) if score == "norm" else sum(w * r * n for w, r, n in zip(weights, room, need))
        b = max(worth, key=lambda b: (worth[b], -b)) if worth else len(bins)
        if b == len(bins):
            bins.append([1.0, 1.0, 1.0])
        bins[b] = [r - n for r, n in zip(bins[b], need)]
        place[k] = b
    return [place[k] for k in range(len(lengths))]


@pytest.mark.parametrize("score", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [(64, 64, 4096), (64, 3, 4096), (64, 9, 900)])
def test_against_plain_best_fit(score, capacity):
    lengths = np.random.default_rng(5).integers(1, 65, 400)
    weights = (1.0, 0.5, 0.25)  # sums of such shares are whole in binary, or tell bins apart
    got = P.best_fit(lengths, capacity, weights, score)[0]
    want = plain_best_fit(lengths.tolist(), capacity, weights, score)
    assert abs(int(got.max()) - max(want)) <= 1 and (got == want).mean() > 0.9


def test_a_capacity_that_binds(spark):
    df = spark.createDataFrame([(k, "a") for k in range(500)], "doc_id long, text string")
    rows = P.pack_documents(df, max_pieces=64).groupBy("sequence_id").count().collect()
    assert len(rows) == 8 and max(r["count"] for r in rows) == 64
    assert P.pack_documents(df).select("sequence_id").distinct().count() == 1


def check(docs, got):
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    sums = {}
    for doc_id, text in docs:
        ids = np.array([*JSON.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(by.pop(doc_id), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert all(r.length == 2048 for r in own[1:])
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
            sums.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert not by
    for rows in sums.values():
        at = 0
        for offset, n in sorted(rows):
            assert offset == at
            at += n
        assert at <= 2048
    return len(sums)


def test_frames(spark):
    rng = np.random.default_rng(2)
    docs = [(k, " ".join(rng.choice(["alpha", "bee", "c", "Ünï"], int(rng.integers(0, 900))))) for k in range(300)] + [(1000, None), (1001, ""), (1002, "word " * 9000), (None, "x y")]
    df = spark.createDataFrame([(k, t, 7) for k, t in docs], "doc_id long, text string, length int")
    got = P.pack_documents(df).collect()
    n = check(docs, got)
    assert n <= 1.03 * np.ceil(sum(r.length for r in got) / 2048) + 1
    assert P.pack_documents(df.limit(0)).count() == 0
    kept = P.written(P.pieces(df, keep_ids=True), "p")
    seqs = P.sequences(P.pack(kept, group=100)).collect()
    assert sum(len(s.ids) for s in seqs) == sum(r.length for r in got) and max(len(s.ids) for s in seqs) <= 2048


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    check(docs, P.op3_best_fit(spark, "/root/testdata/sf0.001").collect())
