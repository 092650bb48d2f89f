import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import algebra, ops
from loomgraph.operators import elementwise as E
from loomgraph.operators import reduce as R
from loomgraph.operators import runes
from loomgraph.operators.matrix import Vector
from loomgraph.operators.multiply import mxm, mxv, strassen, vxm
from loomgraph.operators.row_reduction import reduced
from loomgraph.sources import builders as B
from tests.helpers import edges

LAYOUTS = ["sparse", "dense"]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_cells(spark, layout):
    m = B.from_array(spark, [[4.0, 0.0], [1.0, -9.0]], layout=layout)
    assert m.update(0, 0, lambda v: v - 2).get(0, 0) == 2 and m.set(0, 0, 0.0).get(0, 0) == 0
    assert m.column(0).raw() == [4, 1] and m.row(0).raw() == [4, 0] and m.row_array(1).first()[0] == [1, -9]
    assert E.scale(m, 2.0).raw() == [[8, 0], [2, -18]] and E.negative(m).get(1, 1) == 9
    assert m.stored() == (4 if layout == "dense" else 3)
    assert m.map(lambda i, j, v: v * 0).stored() == (4 if layout == "dense" else 0)
    assert m.clear().raw() == [[0, 0], [0, 0]] and m.copy().raw() == m.raw() and m.shape == (2, 2)
    with pytest.raises(IndexError):
        m.get(2, 0)
    assert [tuple(r) for r in m.sparse().entries(by_column=True).collect()] == [(0, 0, 4), (1, 0, 1), (1, 1, -9)]


def test_edges(spark):
    df = spark.createDataFrame([(0, 1, 2.0), (0, 1, 3.0), (1, 0, 5.0), (1, 0, -5.0), (1, 2, 0.0)], "from long, to long, weight double")
    assert [tuple(r) for r in B.from_edges(df, 2, 3).entries().collect()] == [(0, 1, 5.0)]
    with pytest.raises(IndexError):
        B.from_edges(df, 2, 2)
    assert B.from_edges(df.limit(0), 2, 2).stored() == 0


def test_products(spark):
    a, b = B.from_array(spark, [[1.0, 2, 3], [4, 5, 6]]), B.from_array(spark, [[7.0, 8], [9, 10], [11, 12]])
    assert mxm(a, b).raw() == [[58, 64], [139, 154]]
    x = B.vector_from_array(spark, [4.0, 7.0])
    m = B.from_array(spark, [[2.0, 3], [4, 5], [-1, 6]])
    assert mxv(m, x).raw() == [29, 51, 38] and vxm(x, m).raw() == [29, 51, 38]
    c = mxm(B.from_array(spark, [[1, 1], [0, 2]], "bigint"), B.from_array(spark, [[1, 3], [-1, 0]], "bigint"))
    assert c.raw() == [[0, 3], [-2, 0]] and c.stored() == 2
    s = B.from_array(spark, [[1.0, 2, 3, 4]] * 4)
    assert strassen(s, s, 2).raw() == [[10, 20, 30, 40]] * 4
    odd = B.from_array(spark, [[1.0, 2, 3]] * 3)
    assert strassen(odd, odd, 2).raw() == mxm(odd, odd).raw()
    with pytest.raises(ValueError):
        mxm(a, a)


def test_masks_keep_old_values(spark):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 3, (8, 8)).astype(float)
    m, x = B.from_array(spark, a.tolist()), B.vector_from_array(spark, list(range(1, 9)), "double")
    old = B.vector_from_array(spark, [-12345.0] * 8)
    got = mxv(m, x, mask=lambda i: i % 2 == 0, out=old).raw()
    want = a @ np.arange(1, 9)
    assert got == [-12345 if k % 2 == 0 else want[k] for k in range(8)]
    out = B.from_array(spark, [[7.0] * 8] * 8)
    mask = B.from_array(spark, (np.arange(64).reshape(8, 8) % 3 - 1).astype(float).tolist())
    got = np.array(mxm(m, m, mask=mask, out=out).raw())
    assert (got == np.where(np.arange(64).reshape(8, 8) % 3 == 2, 7, a @ a)).all()


def test_semirings(spark):
    a = edges(spark, [(0, 1, 5), (0, 2, 2), (1, 2, 1)], 3).transpose()
    d = Vector(spark.createDataFrame([(0, 0.0)], "i long, v double"), 3, "sparse", algebra.INF)
    assert mxv(a, d, semiring=algebra.min_plus()).dense().raw() == [math.inf, 5, 2]
    b = edges(spark, [(0, 2, 4), (1, 2, 3)], 3).transpose()
    cap = Vector(spark.createDataFrame([(0, 2.0), (1, 10.0)], "i long, v double"), 3, "sparse", -algebra.INF)
    assert mxv(b, cap, semiring=algebra.max_min()).get(2) == 3
    most = 2147483647
    e = B.from_edges(spark.createDataFrame([(0, 1, 7), (1, 2, 2)], "from long, to long, weight long"), 3, 3).transpose()
    v = Vector(spark.createDataFrame([(0, 0)], "i long, v long"), 3, "sparse", most)
    assert mxv(e, v, semiring=algebra.Semiring(algebra.least("bigint", most), ops.addition, False)).get(1) == 7


@pytest.mark.parametrize("layout", LAYOUTS)
def test_cell_by_cell(spark, layout):
    a, b = B.from_array(spark, [[3.0, 8], [4, 6]], layout=layout), B.from_array(spark, [[4.0, 0], [1, -9]])
    assert E.add(a, b).raw() == [[7, 8], [5, -3]] and E.subtract(a, b).raw() == [[-1, 8], [3, 15]]
    assert E.subtract(b, a).raw() == [[1, -8], [-3, -15]]
    x, y = B.vector_from_array(spark, [0.0, 1, 0, 0, 0, 0, 1], layout=layout), B.vector_from_array(spark, [0.0, 1, 0, 0, 0, 1, 0])
    assert E.ewise_mult(x, y).raw() == [0, 1, 0, 0, 0, 0, 0] and E.ewise_add(x, y).raw() == [0, 1, 0, 0, 0, 1, 1]
    assert E.ewise_add(a, b).raw() == [[4, 8], [1, -9]] and E.ewise_add(a, b, op=ops.maximum).raw()[1] == [4, 6]
    t = B.from_array(spark, [[6.0, 4, 24], [1, -9, 8]], layout=layout)
    assert t.transpose().raw() == [[6, 1], [4, -9], [24, 8]] and t.transpose_to_rows().raw() == t.transpose_to_columns().raw()
    assert E.equal(a, a.sparse()) and E.not_equal(a, b) and not E.equal(B.empty(spark, 2, 2), b)
    assert E.apply(b, ops.UnaryOp(lambda v: v + 1)).get(1, 1) == -8
    assert E.symmetric(B.from_array(spark, [[1.0, 7, 3], [7, 4, -5], [3, -5, 6]], layout=layout))
    assert E.skew_symmetric(B.from_array(spark, [[0.0, 2, -1], [-2, 0, -4], [1, 4, 0]], layout=layout)) and not E.symmetric(t)
    with pytest.raises(ValueError):
        E.add(a, t)


def test_reductions(spark):
    cells = [(0, 1), (0, 3), (1, 6), (3, 0), (6, 3)]
    m = edges(spark, cells, 7)
    assert R.to_vector(m).raw() == [1, 1, 0, 1, 0, 0, 1] and R.to_scalar(m).first()[0] == 5
    negative = B.from_array(spark, [[-3.0, 2.0], [-1.0, 0.0]])
    assert R.to_vector(negative).raw() == [0, 2]
    assert R.to_vector(negative, algebra.plus(), mask=lambda i: i == 0).raw() == [-1, 0]
    assert R.row_argmax(B.from_array(spark, [[2.0, 5, 5], [1, 0, 0]])).orderBy("i").collect()[0]["j"] == 1
    folded = algebra.Monoid(0, ops.BinaryOp(lambda acc, v: v - acc), None)
    assert R.to_scalar(B.vector_from_array(spark, [1.0, 2, 5]), folded).first()[0] == 4
    assert spark.range(1).select(algebra.plus().reduce(F.array(F.lit(1.0), F.lit(2.5)))).first()[0] == 3.5
    v = B.vector_from_array(spark, [6.0, 4, 24, 1, 0, 8])
    assert v.stored() == 5 and v.dense().stored() == 6 and v.resize(2).raw() == [6, 4] and v.dense().resize(8).raw()[6:] == [0, 0]


def test_scalar_operators(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (nan, 0.0), (7.0, 2.0)], "a double, b double")
    got = [r[0] for r in df.select(ops.division(F.col("a"), F.col("b"))).collect()]
    assert got[:2] == [inf, -inf] and math.isnan(got[2]) and math.isnan(got[3]) and got[4] == 3.5
    whole = spark.createDataFrame([(-7, 2)], "a long, b long").select(ops.integer_division(F.col("a"), F.col("b")), ops.minimum(F.col("a"), F.col("b")), ops.second_argument(F.col("a"), F.col("b"))).first()
    assert tuple(whole) == (-3, -7, 2)
    truth = spark.createDataFrame([(p, q) for p in (True, False) for q in (True, False)], "p boolean, q boolean")
    for op, want in ((ops.logical_or, [1, 1, 1, 0]), (ops.logical_and, [1, 0, 0, 0]), (ops.logical_xor, [0, 1, 1, 0])):
        assert [int(r[0]) for r in truth.select(op(F.col("p"), F.col("q"))).collect()] == want


def test_runes_and_rows(spark):
    m = B.from_array(spark, [list("cab"), list("bac"), list("abc")], "string", "dense")
    assert runes.text(m).first()[0] == "cabbacabc" and runes.compare(m, m) == 0
    assert runes.text(runes.sort_rows(m)).first()[0] == "abcbaccab"
    assert runes.sort_columns(m).raw() == [list("abc"), list("acb"), list("bca")]
    got = reduced(B.from_array(spark, [[1.0, 2, -1, -4], [2, 3, -1, -11], [-2, 0, -3, 22]])).raw()
    assert np.allclose(got, [[1, 0, 0, -8], [0, 1, 0, 1], [0, 0, 1, -2]])


def test_files_and_streams(spark, tmp_path):
    from loomgraph.streaming import edges as S

    m = edges(spark, [(0, 1, 2), (1, 2, 3)], 3)
    B.to_parquet(m, f"{tmp_path}/m")
    assert E.equal(B.from_parquet(spark, f"{tmp_path}/m", 3, 3, "i", "j", "v"), m)
    source = f"{tmp_path}/in"
    spark.createDataFrame([(0, 1, 2.0), (0, 1, -2.0), (1, 2, 1.0)], "from long, to long, weight double").write.parquet(source)
    stream = spark.readStream.schema("from long, to long, weight double").parquet(source)
    S.fold(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert [tuple(r) for r in S.folded(spark, f"{tmp_path}/out", 3, 3).df.collect()] == [(1, 2, 1.0)]


def test_strassen_is_one_join_over_sides_written_once(spark, monkeypatch):
    from loomgraph.operators import multiply

    written = []
    monkeypatch.setattr(multiply, "cut", lambda df: written.append(df) or df)
    r = np.random.default_rng(7)
    x, y = r.integers(-4, 5, (9, 13)), r.integers(-4, 5, (13, 11))
    got = strassen(B.from_array(spark, x.tolist(), "bigint"), B.from_array(spark, y.tolist(), "bigint"), 3)
    assert got.raw() == (x @ y).tolist() and len(written) == 2
    assert got.df._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def exchanges(df):
    """What each exchange of the plan deals out, as its columns stand there."""
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return ["p#" in (after := next(x for x in plan[k + 1 :] if "Project [" in x or "HashAggregate(" in x)) or "partial_sum(p" in after for k, x in enumerate(plan) if "Exchange hashpartitioning" in x]


def test_products_are_never_shuffled(spark):
    from loomgraph.operators.multiply import mxm_blocks
    from loomgraph.plans.clustering import inflated

    r = np.random.default_rng(5)
    x, y = r.integers(0, 3, (31, 17)), r.integers(0, 3, (17, 23))
    a, b = (B.from_array(spark, m.tolist(), "bigint") for m in (x, y))
    got = mxm(a, b)
    assert got.raw() == (x @ y).tolist() and not any(exchanges(got.df))
    cells = mxm_blocks(a, b)
    assert all(n == 1 for _, n in cells.groupBy("i").agg(F.count_distinct("block")).collect())
    assert len(exchanges(inflated(cells, 2, "block"))) == len(exchanges(cells))
