"""Graphs of the catalogue without caps, against brute force over the tables."""

from collections import Counter

import pyarrow.parquet as pq

from loomgraph.plans import catalogue

D = "/root/testdata/sf0.01"


def transitions():
    rows = sorted(pq.read_table(f"{D}/events.parquet", columns=["event_id", "user_id"]).to_pylist(), key=lambda r: r["event_id"])
    users = [r["user_id"] for r in rows]
    return Counter((a, b) for a, b in zip(users, users[1:]) if a != b), max(users) + 1


def test_transitions_cross_the_blocks_of_ids(spark):
    want, n = transitions()
    got = catalogue.uu(spark, D)
    assert got.nrows == n and {(r.i, r.j): r.v for r in got.df.collect()} == want


def test_betweenness_over_all_transitions(spark):
    edges, n = transitions()
    after = [[b for a, b in edges if a == k] for k in range(n)]
    want = [0.0] * n
    for s in range(n):
        level, paths, order = {s: 0}, Counter({s: 1}), [s]
        for u in order:
            for w in after[u]:
                if w not in level:
                    level[w] = level[u] + 1
                    order.append(w)
                if level[w] == level[u] + 1:
                    paths[w] += paths[u]
        share = Counter()
        for u in reversed(order):
            share[u] = sum(paths[u] / paths[w] * (1 + share[w]) for w in after[u] if level[w] == level[u] + 1)
            want[u] += share[u] if u != s else 0
    got = catalogue.QUERIES["betweenness"](spark, D).collect()
    assert len(got) == n and all(abs(r.v - want[r.i]) < 1e-5 for r in got)


def test_clusters_are_of_all_users(spark):
    _, n = transitions()
    for name in ("markov", "peer_pressure", "spectral"):
        assert sorted(r.vertex for r in catalogue.QUERIES[name](spark, D).collect()) == list(range(n))


def test_batches_of_the_stream_are_bounded(spark, monkeypatch):
    """More lines are more batches, not larger files or batches."""
    from loomgraph.streaming import edges

    sizes, fold = [], edges.fold

    def watched(stream, path, *rest):
        out = fold(stream, path, *rest)
        out.awaitTermination()
        sizes.extend(p["numInputRows"] for p in out.recentProgress if p["numInputRows"])
        return out

    monkeypatch.setattr(edges, "fold", watched)
    monkeypatch.setattr(catalogue, "ARRIVAL", 1000)
    catalogue.QUERIES["stream_edges"](spark, D).collect()
    assert sum(sizes) == 60_000 and len(sizes) >= 4 and max(sizes) <= 16_000
