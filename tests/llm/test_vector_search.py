import duckdb
import numpy as np

from loomgraph.llm import vector_search as V


def brute(rows, k, limit=lambda s: s):
    fine = [(i, tuple(int(np.floor(64 * float(np.float32(x)))) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(fine):
        if i % 20 == 0:
            others = list(fine)
            others.remove((i, q))
            best = sorted((-limit(sum(a * b for a, b in zip(q, c))), j) for j, c in others if len(c) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def run(spark, rows, k=20, **more):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, v string")
    v = V.integers(df)
    return sorted(map(tuple, V.top_k(v, v.where("vec_id % 20 = 0"), k, **more).collect()))


def test_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(k, [float(x) for x in rng.normal(size=8) / 3]) for k in range(300)]
    rows += [(1000 + k, rows[3][1]) for k in range(60)] + [(2000 + 20 * k, rows[20][1]) for k in range(40)]
    rows += [(5000, None), (5020, [None, 1.0]), (None, [1.0] * 8), (5040, [float("nan")] * 8), (5060, [float("inf")] * 8), (5080, []), (5100, []), (5120, [1.0, 2.0]), (5121, [0.5, 0.1]), (-20, [9.0] * 8), (40, rows[40][1]), (41, rows[41][1])]
    assert run(spark, rows) == brute(rows, 20)
    assert run(spark, rows, 3, bits=4, cell_block=50, query_block=7) == brute(rows, 3)
    assert run(spark, rows[:5], 20) == brute(rows[:5], 20)
    large = [20000.0, -3.0e9, 1.5e18, 0.25]
    rows += [(6000 + k, [large[k % 4], *rows[k][1][1:]]) for k in range(30)]
    monkeypatch.setattr(V, "BROADCAST_BYTES", 900)
    limit = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    assert run(spark, rows, 4, cell_block=64, query_block=3) == brute(rows, 4, limit)
    assert run(spark, [(0, None)]) == []


def test_query_against_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{d}/embeddings.parquet'")
    want = sorted(con.execute(V.ORACLES["op7_vector_search"]).fetchall())
    assert sorted(map(tuple, V.op7_vector_search(spark, d).collect())) == want


def test_bounds_hold():
    rng = np.random.default_rng(1)
    q, v = rng.integers(-40, 40, (9, 16)).astype(float), rng.integers(-40, 40, (50, 16)).astype(float)
    v[3:6] *= 1 << 20
    v[7] *= 2.0**70
    cells, wide = V.cells_of(v, 3)
    assert cells.dtype == np.int8 and wide.max() > 60 and set(wide[8:]) == {3}
    low, high = V.bounds(q, cells, wide)
    want = np.array([[sum(int(a) * int(b) for a, b in zip(x, y)) for y in v] for x in q], dtype=object)
    assert (low <= want).all() and (want <= high).all()
