import numpy as np

from loomgraph.llm import ngram_join as J
from loomgraph.llm.components import components


def words(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()


def brute(docs):
    sets = []
    for _, text in docs:
        w = words(text)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = {d: d for d, _ in docs if d is not None}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (d, _) in enumerate(docs):
        for j, (e, _) in enumerate(docs[:i]):
            if d is not None and e is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((top(d), top(e)))
                root[b] = a
    return sorted(((d, len(s), None if d is None else top(d)) for (d, _), s in zip(docs, sets)), key=str)


def planted(seed, n=220):
    rng = np.random.default_rng(seed)
    vocab = [f"W{k}ß" for k in range(300)]
    line = list(rng.choice(vocab, 60))
    base = [list(rng.choice(vocab, int(rng.integers(1, 90)))) for _ in range(25)]
    docs = []
    for k in range(n):
        w = list(base[int(rng.integers(len(base)))] if k % 3 else base[0])
        for _ in range(int(rng.integers(0, 5))):
            w[int(rng.integers(len(w)))] = str(rng.choice(vocab))
        if k % 4 == 0:
            w = line + w[: int(rng.integers(1, 25))]
        docs.append((int(rng.integers(0, 9000)) * 1000 + k, " ".join(w)))
    return docs + [(5, None), (6, ""), (7, " \t"), (None, docs[0][1]), docs[2], docs[2], (3, "a b"), (4, "A  b"), (docs[5][0], docs[9][1]), (8, "b a"), (9, "É e"), (10, "é e")]


def check(spark, docs):
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, node int, label int")
    got = J.classes(df).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(docs)


def test_against_brute_force(spark):
    for seed in (0, 1):
        check(spark, planted(seed))


def test_short_prefixes_grow_and_everything_is_shuffled(spark, monkeypatch):
    for name, value in (("COST", 2), ("BROADCAST_ROWS", 0), ("GROUP", 3), ("ROWS", 5), ("WAITING", 50), ("DONE", 4)):
        monkeypatch.setattr(J, name, value)
    monkeypatch.setattr(J.node_links, "__defaults__", (J.WORDS, J.PERCENT, J.MOST, 2))
    check(spark, planted(5))


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, J.op1_ngram_join(spark, d).collect()), key=str) == brute(docs)


def test_keep_one_and_empty(spark):
    docs = planted(3)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, gone string, __gone int")
    want = {d for d, n, c in brute(docs) if d is None or d == c}
    got = J.keep_one(df).collect()
    assert {r.doc_id for r in got} == want and len(got[0]) == 4
    assert J.classes(df.limit(0)).count() == 0


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 400), (None, 3), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in components(links).collect()}
    assert got == {**{k: 0 for k in range(201)}, 400: 400, 500: 400}
    assert components(links.limit(0)).count() == 0
