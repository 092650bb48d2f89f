import random
import tracemalloc
from collections import Counter

import pyarrow as pa

from loomgraph.llm import common as C
from loomgraph.llm import quality_lm as Q


class Caught:
    """Stands for a table; keeps the function that is to run in the workers."""

    def select(self, *_):
        return self

    where = select

    def mapInArrow(self, run, _):
        self.run = run
        return self


def grams_of(texts):
    run = Q.document_grams(Caught()).run
    batch = pa.RecordBatch.from_arrays([pa.array([b"%016d" % k for k in range(len(texts))], pa.binary()), pa.array(texts, pa.string())], names=["key", "text"])
    for part in run(iter([batch])):
        yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def want(texts):
    return Counter((b"%016d" % k, c, s) for k, t in enumerate(texts) for context, symbol in Q.code_grams(t, Q.ORDER) for c, s in zip(context.tolist(), symbol.tolist(), strict=True))


def test_a_worker_holds_few_ngrams_of_its_documents(spark):
    words = random.Random(1)
    texts = ["".join(words.choices("abcdefghij ", k=3000)) for _ in range(400)]  # 1.2 million n-grams
    run = Q.document_grams(Caught()).run
    batch = pa.RecordBatch.from_arrays([pa.array([b"%016d" % k for k in range(len(texts))], pa.binary()), pa.array(texts, pa.string())], names=["key", "text"])
    n = 0
    tracemalloc.start()
    try:
        for part in run(iter([batch])):
            n += sum(part.column(3).to_pylist())
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == sum(map(len, texts))
    assert peak < 20_000_000


def test_ngrams_are_counted_by_document(spark, monkeypatch):
    texts = ["the cat sat on the mat, the cat sat", "", "кот кот спит", "to  to\nto a a b" * 9]
    rows = list(grams_of(texts))
    assert len(rows) == len({r[:3] for r in rows}) and {r[:3]: r[3] for r in rows} == want(texts)
    monkeypatch.setattr(Q, "WAITING", 5)  # a text in parts
    parts = Counter()
    for *gram, n in grams_of(texts):
        parts[tuple(gram)] += n
    assert parts == want(texts)


def test_large_caches_go_with_their_operator():
    kept = C.worker_cache()
    for uses, stays in ((("codecs",), True), ((), False)):
        kept["codecs"], kept["small"] = {"a": "b"}, 1
        assert list(C.freed(lambda batches: batches, *uses)(iter([1, 2]))) == [1, 2]
        assert ("codecs" in kept) == stays and kept.pop("small") == 1
    kept.pop("codecs", None)


def test_operators_keep_the_caches_they_use(spark):
    from loomgraph.llm import bpe_codec, packing

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["the cat"])], names=["doc_id", "text"])
    for make in (packing.pieces, bpe_codec.round_trip):
        run = make(Caught()).run
        list(run(iter([batch])))
        first = dict(C.worker_cache()["codecs"])
        list(run(iter([batch])))
        assert all(C.worker_cache()["codecs"][k] is v for k, v in first.items())
    del C.worker_cache()["codecs"]
