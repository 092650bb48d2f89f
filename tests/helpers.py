"""Graphs of the tests."""

from loomgraph.sources import builders


def edges(spark, rows, n, weight=None):
    data = [(a, b, float(w[0] if w else 1.0)) for a, b, *w in rows]
    return builders.from_edges(spark.createDataFrame(data, "from long, to long, weight double"), n, n)


def clique_ring(k, size, isolated, undirected=True):
    """k cliques, the last vertex of each joined to the first of the next; then isolated vertices."""
    rows = [(c * size + a, c * size + b) for c in range(k) for a in range(size) for b in range(a + 1, size)]
    rows += [(c * size + size - 1, (c + 1) % k * size) for c in range(k)]
    return (rows + [(b, a) for a, b in rows] if undirected else rows), k * size + isolated


def labels(df):
    return [r["label"] for r in df.orderBy("vertex").collect()]


def values(v):
    return v.raw()
