import numpy as np

from loomgraph.llm import wordhash as H


def test_equal_words_have_equal_hashes_wherever_they_stand(monkeypatch):
    rng = np.random.default_rng(0)
    alphabet = list("ab é\t\n\x0b\x0c\r\x1c\u0085  日")
    for size in (1 << 21, 5):
        monkeypatch.setattr(H, "SLICE", size)
        seen = {}
        for _ in range(300):
            raw = "".join(rng.choice(alphabet, int(rng.integers(0, 50)))).encode()
            h = H.hashed(raw)
            assert len(h) == len(raw.split())
            for w, x in zip(raw.split(), h.tolist(), strict=True):
                assert seen.setdefault(w, x) == x
        assert len(set(seen.values())) == len(seen)


def test_spans_and_sliding_minimum():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 3, 200).astype(np.uint64)
    for which in (0, 1):
        s, seen = H.Spans(h), {}
        for n in (1, 3, 50):
            for k, x in enumerate(s.of(np.arange(200 - n), n, which).tolist()):
                assert seen.setdefault(tuple(h[k : k + n].tolist()), x) == x
        assert len(set(seen.values())) == len(seen)
    x = rng.integers(0, 1000, 100)
    for width in (1, 2, 5, 31, 35, 64):
        assert (H.sliding_min(x, width) == [x[k : k + width].min() for k in range(100 - width + 1)]).all()
