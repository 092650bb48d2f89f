import functools
import math
import random
import re
from collections import Counter

import pytest

from loomgraph.llm import quality_lm as Q


def codes(text):
    out = [ord(c) + 1 for c in text]
    words = [(m.start(), m.group()) for m in re.finditer(r"[^ \t\r\n]+", text)]
    for (_, w), (at, x) in zip(words, words[1:]):
        if w == x:
            out[at - 1] = Q.AGAIN
    return tuple(out)


def brute(trusted, order):
    """The mean negative log probability of a text, by the textbook's recursion over code points."""

    def split(t):
        s = (0,) * (order - 1) + codes(t)
        return [s[k : k + order] for k in range(len(t))]

    levels = {order: Counter(g for t in trusted for g in split(t))}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    cut, after = {}, {}
    for k, c in levels.items():
        n = Counter(c.values())
        y = n[1] / max(n[1] + 2 * n[2], 1)
        cut[k] = [min(max(j - (j + 1) * y * n[j + 1] / max(n[j], 1), 0.05), j - 0.01) for j in (1, 2, 3)]
        after[k] = {}
        for g, m in c.items():
            after[k].setdefault(g[:-1], []).append(m)

    @functools.cache
    def p(g):
        k = len(g)
        if not k:
            return 1 / Q.ALPHABET
        own = after[k].get(g[:-1])
        if not own:
            return p(g[1:])
        off = lambda n: cut[k][min(n, 3) - 1] if n else 0
        n = levels[k][g]
        return (n - off(n) + sum(map(off, own)) * p(g[1:])) / sum(own)

    return lambda t: sum(-math.log(p(g)) for g in split(t)) / len(t)


TEXTS = ["the cat sat on the mat.", "Кот сидит на коврике, кот спит", "Über den Fluß 12", "日本語の文章 the cat cat", "to  to\nto a a b", "𝒳 y", ""]


@pytest.mark.parametrize("broadcast", [True, False])
def test_figures_are_the_recursions(spark, monkeypatch, broadcast):
    monkeypatch.setattr(Q, "SLICE", 5)
    monkeypatch.setattr(Q, "HELD", 0)
    if not broadcast:
        monkeypatch.setattr(Q, "BROADCAST_ROWS", 0)
    more = ["zebra ### !! Q", "Кит летит", "the the the cat", "日 本"]
    rows = [(k, t, "x") for k, t in enumerate([*TEXTS, *more])]
    docs = spark.createDataFrame([*rows, rows[1], (None, TEXTS[0], "x"), (99, None, "x")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1) for k in range(len(TEXTS))], "doc_id long, quality int")
    got = Q.judged(docs, labels).collect()
    figure = brute([*TEXTS, TEXTS[1]], Q.ORDER)
    texts = {k: t for k, t, _ in rows} | {None: TEXTS[0], 99: None}
    assert len(got) == len(rows) + 3
    for r in got:
        if texts[r.doc_id]:
            assert abs(r.figure - figure(texts[r.doc_id])) < 1e-9
        else:
            assert r.figure is None and r.keep


def test_letters_of_any_script_are_told_apart(spark):
    random.seed(1)
    words = "вода земля город человек дорога песня ветер книга школа море рука солнце".split()
    texts = [" ".join(random.choices(words, k=60)) for _ in range(60)]
    letters = sorted(set("".join(words)))
    other = str.maketrans(dict(zip(letters, letters[7:] + letters[:7])))
    docs = spark.createDataFrame([(k, t, "ru") for k, t in enumerate(texts)] + [(100 + k, t.translate(other), "ru") for k, t in enumerate(texts[:10])], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1) for k in range(50)], "doc_id long, quality int")
    got = {r.doc_id: r.keep for r in Q.judged(docs, labels).collect()}
    assert all(got[k] for k in range(60)) and not any(got[100 + k] for k in range(10))
