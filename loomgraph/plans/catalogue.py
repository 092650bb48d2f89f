"""Queries over the driver's tables, one or more for each operator of the library, with their SQL equivalents.

Graphs: SP supplier x part (sum of quantities), NN nation to nation (customers' to suppliers', number of lines) and ND the same
as double, UU user to user and ET event to the next one of the same user, where that is the next of all, CC customer to customer
(consecutive orders), EM embeddings as a dense matrix, RUNES the first three letters of the nations' names. All are over whole
tables. spectral has no SQL (an orthogonal iteration); its test is a brute force.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions import algebra, ops
from loomgraph.operators import elementwise as E
from loomgraph.operators import reduce as R
from loomgraph.operators import runes
from loomgraph.operators.matrix import Matrix, Vector
from loomgraph.operators.multiply import mxm, mxv, strassen, vxm
from loomgraph.operators.row_reduction import reduced
from loomgraph.plans import centrality, clustering, traversal
from loomgraph.sources import builders
from loomgraph.sources.storage import cut, shared_dir
from loomgraph.streaming import edges

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


# ---------------------------------------------------------------- graphs


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def sp(spark: SparkSession, d: str) -> Matrix:
    n, m = (_read(spark, d, t).count() for t in ("supplier", "part"))
    return builders.from_edges(_read(spark, d, "lineitem"), n, m, "l_suppkey", "l_partkey", "l_quantity", check=False)


def nn(spark: SparkSession, d: str) -> Matrix:
    lines = _read(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    orders = _read(spark, d, "orders").select("o_orderkey", "o_custkey")
    customer = _read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("i"))
    supplier = _read(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("j"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return Matrix(rows.groupBy("i", "j").agg(F.count("*").alias("v")), 25, 25)


def nd(spark: SparkSession, d: str) -> Matrix:
    return nn(spark, d).map(lambda i, j, v: v.cast("double"))


def _after(rows: DataFrame, at: str, who: str) -> DataFrame:
    """at, who, to: who has the next row in the order of at. By windows within blocks of ids; what ends a block goes to the first of the next, by a window over one row a block."""
    e = rows.select(F.col(at).alias("at"), F.col(who).alias("who"), F.floor(F.col(at) / 1000).alias("block"))
    first = e.groupBy("block").agg(F.min_by("who", "at").alias("next"))
    after = first.select(F.lag("block").over(W.orderBy("block")).alias("block"), "next").where("block is not null")
    order = W.partitionBy("block").orderBy("at")
    return e.withColumn("to", F.lead("who").over(order)).join(after, "block", "left").select("at", "who", F.coalesce("to", "next").alias("to"))


def _steps(spark: SparkSession, d: str, name: str, at: str, who: str) -> Matrix:
    rows = _after(_read(spark, d, name), at, who).where("to is not null and who <> to")
    n = _read(spark, d, name).agg(F.max(who)).first()[0] + 1
    return Matrix(cut(rows.groupBy(F.col("who").alias("i"), F.col("to").alias("j")).agg(F.count("*").cast("double").alias("v"))), n, n)


def uu(spark: SparkSession, d: str) -> Matrix:
    return _steps(spark, d, "events", "event_id", "user_id")


def cc(spark: SparkSession, d: str) -> Matrix:
    return _steps(spark, d, "orders", "o_orderkey", "o_custkey")


def em(spark: SparkSession, d: str) -> Matrix:
    e = _read(spark, d, "embeddings")
    cells = e.select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))
    return Matrix(cells, e.count(), 64, "dense")


def rune_matrix(spark: SparkSession, d: str) -> Matrix:
    n = _read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("i"), F.upper("n_name").alias("s"))
    cells = n.select("i", F.posexplode(F.array(*(F.substring("s", k, 1) for k in (1, 2, 3)))).alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), "v")
    return Matrix(cells, 25, 3, "dense")


SP = "sp AS (SELECT l_suppkey AS i, l_partkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2 HAVING sum(l_quantity) <> 0)"
NN = """nn AS (SELECT CAST(c_nationkey AS BIGINT) AS i, CAST(s_nationkey AS BIGINT) AS j, count(*) AS v FROM lineitem
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""
ND = f"{NN}, nd AS (SELECT i, j, CAST(v AS DOUBLE) AS v FROM nn)"
_STEPS = "{0} AS MATERIALIZED (SELECT {2} AS i, nxt AS j, CAST(count(*) AS DOUBLE) AS v FROM (SELECT {2}, lead({2}) OVER (ORDER BY {3}) AS nxt FROM {1}) WHERE nxt IS NOT NULL AND {2} <> nxt GROUP BY 1, 2)"
UU = _STEPS.format("uu", "events", "user_id", "event_id")
CC = _STEPS.format("cc", "orders", "o_custkey", "o_orderkey")
RUNES = "runes AS (SELECT CAST(n_nationkey AS BIGINT) AS i, CAST(k - 1 AS BIGINT) AS j, substr(upper(n_name), k, 1) AS v FROM nation, (SELECT unnest([1, 2, 3]) AS k))"


def ones(m: Matrix) -> Vector:
    return Vector(m.spark.range(m.ncols).select(F.col("id").alias("i"), F.lit(1).cast(m.dtype).alias("v")), m.ncols, "dense")


def trade_row_sums(spark: SparkSession, d: str) -> DataFrame:
    m = nn(spark, d)
    return mxv(m, ones(m)).df


query("trade_row_sums", f"WITH {NN} SELECT i, CAST(sum(v) AS BIGINT) AS v FROM nn GROUP BY i")(trade_row_sums)

# ---------------------------------------------------------------- sources, accessors


@query("build_edges", f"WITH {SP} SELECT * FROM sp")
def _(s, d):
    return sp(s, d).df


@query("embedding_cells", "SELECT vec_id AS i, CAST(k - 1 AS BIGINT) AS j, round(CAST(embedding[k] AS DOUBLE), 6) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS k) WHERE embedding[k] <> 0")
def _(s, d):
    return em(s, d).sparse().df.select("i", "j", F.round("v", 6).alias("v"))


def _nations(s: SparkSession, d: str) -> list[list[int]]:
    """The 25 nations' keys and regions on the driver."""
    return [list(map(int, r)) for r in _read(s, d, "nation").select("n_nationkey", "n_regionkey").orderBy("n_nationkey").collect()]


@query("from_array", "SELECT CAST(n_nationkey AS BIGINT) AS i, CAST(k AS BIGINT) AS j, CAST(CASE k WHEN 0 THEN n_nationkey ELSE n_regionkey END AS DOUBLE) AS v FROM nation, (SELECT unnest([0, 1]) AS k) WHERE CASE k WHEN 0 THEN n_nationkey ELSE n_regionkey END <> 0")
def _(s, d):
    return builders.from_array(s, _nations(s, d)).df


@query("from_array_dense", "SELECT CAST(n_nationkey AS BIGINT) AS i, CAST(k AS BIGINT) AS j, CAST(CASE k WHEN 0 THEN n_nationkey ELSE n_regionkey END AS BIGINT) AS v FROM nation, (SELECT unnest([0, 1]) AS k)")
def _(s, d):
    return builders.from_array(s, _nations(s, d), "bigint", "dense").df


@query("vectors", """SELECT 'sparse' AS kind, CAST(n_nationkey AS BIGINT) AS i, CAST(n_regionkey AS DOUBLE) AS v FROM nation WHERE n_regionkey <> 0
UNION ALL SELECT 'dense', CAST(n_nationkey AS BIGINT), CAST(n_regionkey AS DOUBLE) FROM nation UNION ALL SELECT 'zero', CAST(k AS BIGINT), 0 FROM (SELECT unnest(range(4)) AS k)""")
def _(s, d):
    values = [r[1] for r in _nations(s, d)]
    made = {"sparse": builders.vector_from_array(s, values), "dense": builders.vector_from_array(s, values, layout="dense"), "zero": builders.zero_vector(s, 4), "empty": builders.empty_vector(s, 4)}
    parts = [v.df.select(F.lit(k).alias("kind"), "i", "v") for k, v in made.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("to_dense", f"WITH {ND} SELECT a.k AS i, b.k AS j, coalesce(v, 0) AS v FROM (SELECT unnest(range(25)) AS k) a CROSS JOIN (SELECT unnest(range(25)) AS k) b LEFT JOIN nd ON i = a.k AND j = b.k")
def _(s, d):
    return nd(s, d).dense().df


@query("zero_matrix", "SELECT CAST(a AS BIGINT) AS i, CAST(b AS BIGINT) AS j, CAST(0 AS DOUBLE) AS v FROM (SELECT unnest(range(5)) AS a), (SELECT unnest(range(4)) AS b)")
def _(s, d):
    return builders.zeros(s, 5, 4).df


@query("empty_matrix", "SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS j, CAST(0 AS DOUBLE) AS v WHERE 1 = 0")
def _(s, d):
    return builders.empty(s, 5, 4).df


_POINTS = [(0, 1), (3, 4), (24, 24), (7, 7)]


@query("at_point", f"WITH {NN}, p(i, j) AS (VALUES {', '.join(map(str, _POINTS))}) SELECT CAST(p.i AS BIGINT) AS i, CAST(p.j AS BIGINT) AS j, coalesce(v, 0) AS v FROM p LEFT JOIN nn ON nn.i = p.i AND nn.j = p.j")
def _(s, d):
    m = nn(s, d)
    return s.createDataFrame([(i, j, m.get(i, j)) for i, j in _POINTS], "i long, j long, v long")


@query("row_of_supplier", f"WITH {SP} SELECT i, j, v FROM sp WHERE i = 3")
def _(s, d):
    return sp(s, d).row(3).df.select(F.lit(3).cast("long").alias("i"), F.col("i").alias("j"), "v")


@query("entries_by_column", f"WITH {NN} SELECT row_number() OVER (ORDER BY j, i) - 1 AS at, i, j, v FROM nn")
def _(s, d):
    rows = nn(s, d).entries(by_column=True).collect()  # at most 25 x 25
    return s.createDataFrame([(k, r.i, r.j, r.v) for k, r in enumerate(rows)], "at long, i long, j long, v long")


@query("raw_cells", f"WITH {NN} SELECT a.k AS i, string_agg(CAST(coalesce(v, 0) AS VARCHAR), ',' ORDER BY b.k) AS cells FROM (SELECT unnest(range(25)) AS k) a CROSS JOIN (SELECT unnest(range(25)) AS k) b LEFT JOIN nn ON i = a.k AND j = b.k GROUP BY 1")
def _(s, d):
    return s.createDataFrame([(k, ",".join(map(str, row))) for k, row in enumerate(nn(s, d).raw())], "i long, cells string")


@query("row_slice", f"WITH {SP} SELECT j AS i, v FROM sp WHERE i = 5")
def _(s, d):
    return sp(s, d).row(5).df


@query("column_slice", f"WITH {SP} SELECT i, v FROM sp WHERE j = 7")
def _(s, d):
    return sp(s, d).column(7).df


@query("row_array", f"WITH {ND} SELECT string_agg(CAST(CAST(coalesce(v, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY k) AS values FROM (SELECT unnest(range(25)) AS k) LEFT JOIN nd ON i = 2 AND j = k")
def _(s, d):
    return nd(s, d).row_array(2).select(F.array_join(F.transform("values", lambda x: x.cast("long").cast("string")), ",").alias("values"))


@query("set_point", f"WITH {NN} SELECT i, j, v FROM nn WHERE NOT (i = 0 AND j = 0) AND NOT (i = 1 AND j = 2) UNION ALL SELECT 1, 2, 77")
def _(s, d):
    return nn(s, d).set(1, 2, 77).set(0, 0, 0).df


@query("update_point", f"WITH {NN} SELECT i, j, CASE WHEN i = 1 AND j = 2 THEN v * 2 ELSE v END AS v FROM nn")
def _(s, d):
    return nn(s, d).update(1, 2, lambda v: v * 2).df


@query("map_values", f"WITH {NN} SELECT i, j, v + i - j AS v FROM nn WHERE v + i - j <> 0")
def _(s, d):
    return nn(s, d).map(lambda i, j, v: v + i - j).df


@query("resize", f"WITH {SP} SELECT i, CAST(sum(v) AS DOUBLE) AS v FROM sp WHERE i < 4 GROUP BY i")
def _(s, d):
    return R.row_sums(sp(s, d)).resize(4).df


@query("shape_and_stored", f"WITH {SP} SELECT (SELECT count(*) FROM supplier) AS nrows, (SELECT count(*) FROM part) AS ncols, count(*) AS stored FROM sp")
def _(s, d):
    m = sp(s, d)
    return s.createDataFrame([(*m.shape, m.stored())], "nrows long, ncols long, stored long")


@query("clear", f"WITH {NN} SELECT * FROM nn WHERE 1 = 0")
def _(s, d):
    return nn(s, d).clear().df


# ---------------------------------------------------------------- projections, predicates


@query("apply_square", f"WITH {NN} SELECT i, j, v * v AS v FROM nn")
def _(s, d):
    return E.apply(nn(s, d), ops.UnaryOp(lambda v: v * v)).df


@query("apply_masked", f"WITH {NN} SELECT i, j, v + 1 AS v FROM nn WHERE i <> j")
def _(s, d):
    return E.apply(nn(s, d), ops.UnaryOp(lambda v: v + 1), mask=lambda i, j: i == j).df


@query("assign_constant", f"WITH {ND}, g AS (SELECT a.k AS i, b.k AS j FROM (SELECT unnest(range(25)) AS k) a CROSS JOIN (SELECT unnest(range(25)) AS k) b) SELECT g.i, g.j, CASE WHEN g.i < g.j THEN 5 ELSE coalesce(v, 0) END AS v FROM g LEFT JOIN nd USING (i, j)")
def _(s, d):
    return E.assign(nd(s, d), 5, mask=lambda i, j: i >= j).df


@query("scale", f"WITH {NN} SELECT i, j, v * 3 AS v FROM nn")
def _(s, d):
    return E.scale(nn(s, d), 3).df


@query("negate", f"WITH {NN} SELECT i, j, -v AS v FROM nn")
def _(s, d):
    return E.negative(nn(s, d)).df


@query("transpose", f"WITH {SP} SELECT j AS i, i AS j, v FROM sp")
def _(s, d):
    return sp(s, d).transpose().df


@query("transpose_to_rows", f"WITH {SP} SELECT j AS i, i AS j, v FROM sp")
def _(s, d):
    return sp(s, d).transpose_to_rows().df


@query("transpose_to_columns", f"WITH {SP} SELECT j AS i, i AS j, v FROM sp")
def _(s, d):
    return sp(s, d).transpose_to_columns().df


@query("mask_filter", f"WITH {NN} SELECT i, j FROM nn WHERE v - 80 > 0")
def _(s, d):
    from loomgraph.operators.matrix import mask_cells

    m = nn(s, d).map(lambda i, j, v: v - 80)
    return mask_cells(m, m.df, m.keys)


def _one(s: SparkSession, **values: bool | int) -> DataFrame:
    return s.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'int'}" for k, v in values.items()))


@query("equal", f"WITH {NN}, d AS (SELECT count(*) AS n FROM nn a FULL JOIN nn b ON a.i = b.j AND a.j = b.i WHERE coalesce(a.v, 0) <> coalesce(b.v, 0)) SELECT true AS itself, n = 0 AS transposed, n <> 0 AS differs FROM d")
def _(s, d):
    m = nn(s, d)
    return _one(s, itself=E.equal(m, m.copy()), transposed=E.equal(m, m.transpose()), differs=E.not_equal(m, m.transpose()))


_BOTH = "{0} AS (SELECT i, j, sum(v) AS v FROM (SELECT * FROM nn UNION ALL SELECT j, i, {1}v FROM nn) GROUP BY 1, 2)"
_HOLDS = "(SELECT count(*) FROM {0} a FULL JOIN {0} b ON a.i = b.j AND a.j = b.i WHERE coalesce(a.v, 0) <> {1}coalesce(b.v, 0)) = 0"


@query("symmetric", f"WITH {NN}, {_BOTH.format('s', '')}, {_BOTH.format('t', '-')} SELECT {_HOLDS.format('s', '')} AS sum_is, {_HOLDS.format('t', '-')} AS difference_is, {_HOLDS.format('s', '-')} AS skew_sum, {_HOLDS.format('nn', '')} AS itself")
def _(s, d):
    m = nn(s, d)
    total, difference = E.add(m, m.transpose()), E.subtract(m, m.transpose())
    return _one(s, sum_is=E.symmetric(total), difference_is=E.skew_symmetric(difference), skew_sum=E.skew_symmetric(total), itself=E.symmetric(m))


@query("rune_string", f"WITH {RUNES} SELECT string_agg(v, '' ORDER BY i, j) AS s FROM runes")
def _(s, d):
    return runes.text(rune_matrix(s, d))


@query("rune_compare", f"""WITH {RUNES}, r AS (SELECT i, string_agg(v, '' ORDER BY j) AS s FROM runes GROUP BY i), t AS (SELECT string_agg(s, '' ORDER BY i) AS x, string_agg(s, '' ORDER BY s, i) AS y FROM r)
SELECT CAST((x > x) :: INTEGER - (x < x) :: INTEGER AS INTEGER) AS same, CAST((x > y) :: INTEGER - (x < y) :: INTEGER AS INTEGER) AS with_sorted, y < x AS less, y > x AS greater, x < y AS less_back FROM t""")
def _(s, d):
    m = rune_matrix(s, d)
    o = runes.sort_rows(m)
    return _one(s, same=runes.compare(m, m), with_sorted=runes.compare(m, o), less=runes.less(o, m), greater=runes.greater(o, m), less_back=runes.less(m, o))


@query("sort_rows", f"WITH {RUNES}, r AS (SELECT i, string_agg(v, '' ORDER BY j) AS s FROM runes GROUP BY i), p AS (SELECT i, row_number() OVER (ORDER BY s, i) - 1 AS k FROM r) SELECT k AS i, j, v FROM runes JOIN p USING (i)")
def _(s, d):
    return runes.sort_rows(rune_matrix(s, d)).df


@query("sort_columns", f"WITH {RUNES}, r AS (SELECT j, string_agg(v, '' ORDER BY i) AS s FROM runes GROUP BY j), p AS (SELECT j, row_number() OVER (ORDER BY s, j) - 1 AS k FROM r) SELECT i, k AS j, v FROM runes JOIN p USING (j)")
def _(s, d):
    return runes.sort_columns(rune_matrix(s, d)).df


# ---------------------------------------------------------------- products


@query("mxm", f"WITH {SP} SELECT a.i, b.i AS j, CAST(sum(a.v * b.v) AS DOUBLE) AS v FROM sp a JOIN sp b ON a.j = b.j GROUP BY 1, 2")
def _(s, d):
    m = sp(s, d)
    return mxm(m, m.transpose()).df


@query("mxm_masked", f"WITH {NN} SELECT a.i, b.j, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM nn a JOIN nn b ON a.j = b.i WHERE (a.i, b.j) NOT IN (SELECT i, j FROM nn WHERE v > 90) GROUP BY 1, 2 UNION ALL SELECT i, j, v FROM nn WHERE v > 90")
def _(s, d):
    m = nn(s, d)
    return mxm(m, m, mask=m.df.where("v > 90"), out=m).df


@query("mxv", f"WITH {SP} SELECT i, CAST(sum(v * j) AS DOUBLE) AS v FROM sp GROUP BY i HAVING sum(v * j) <> 0")
def _(s, d):
    m = sp(s, d)
    return mxv(m, Vector(s.range(m.ncols).select(F.col("id").alias("i"), F.col("id").cast("double").alias("v")), m.ncols)).df


@query("vxm_transposed", f"WITH {SP} SELECT j AS i, CAST(sum(v) AS DOUBLE) AS v FROM sp GROUP BY j")
def _(s, d):
    m = sp(s, d)
    return vxm(ones(m.transpose()), m, transpose=True).df


@query("mxv_masked", f"WITH {SP} SELECT i, CAST(sum(v) AS DOUBLE) AS v FROM sp WHERE i >= 5 GROUP BY i")
def _(s, d):
    m = sp(s, d)
    return mxv(m, ones(m), mask=lambda i: i < 5).df


def _start(m: Matrix, zero: object, dtype: str = "double") -> Vector:
    return Vector(m.spark.range(3).select(F.col("id").alias("i"), F.col("id").cast(dtype).alias("v")), m.ncols, "sparse", zero)


@query("semiring_min_plus", f"WITH {ND} SELECT j AS i, min(v + i) AS v FROM nd WHERE i < 3 GROUP BY j")
def _(s, d):
    m = nd(s, d).transpose()
    return mxv(m, _start(m, algebra.INF), semiring=algebra.min_plus()).df


@query("semiring_max_min", f"WITH {ND} SELECT j AS i, max(least(v, i * 50)) AS v FROM nd WHERE i < 3 GROUP BY j")
def _(s, d):
    m = nd(s, d).transpose()
    return mxv(m, _start(m, -algebra.INF).map(lambda i, v: v * 50), semiring=algebra.max_min()).df


@query("semiring_plus_times", f"WITH {NN} SELECT i, CAST(sum(v * j) AS BIGINT) AS v FROM nn WHERE j < 3 GROUP BY i")
def _(s, d):
    m = nn(s, d)
    return mxv(m, _start(m, 0, "bigint"), semiring=algebra.plus_times("bigint")).df


@query("semiring_integers", f"WITH {NN} SELECT i, min(v + CASE WHEN j < 3 THEN j ELSE 2147483647 END) AS v FROM nn GROUP BY i")
def _(s, d):
    m = nn(s, d)
    return mxv(m, _start(m, 2147483647, "bigint"), semiring=algebra.Semiring(algebra.least("bigint", 1 << 40), ops.addition, annihilates=False)).df


@query("semiring_or_and", f"WITH {ND} SELECT DISTINCT j AS i, true AS v FROM nd WHERE i < 3")
def _(s, d):
    m = nd(s, d).transpose()
    reach = Matrix(m.df.select("i", "j", F.lit(True).alias("v")), 25, 25)
    x = Vector(s.range(3).select(F.col("id").alias("i"), F.lit(True).alias("v")), 25, "sparse", False)
    return mxv(reach, x, semiring=algebra.or_and()).df


@query("strassen", f"WITH {NN} SELECT a.i, b.j, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM nn a JOIN nn b ON a.j = b.i GROUP BY 1, 2")
def _(s, d):
    m = nn(s, d)
    return strassen(m, m, crossover=8).df


# ---------------------------------------------------------------- cell by cell


@query("ewise_mult", f"WITH {NN} SELECT a.i, a.j, a.v FROM nn a JOIN nn b ON a.i = b.j AND a.j = b.i WHERE a.v = b.v")
def _(s, d):
    m = nn(s, d)
    return E.ewise_mult(m, m.transpose()).df


@query("ewise_mult_product", f"WITH {NN} SELECT a.i, a.j, a.v * b.v AS v FROM nn a JOIN nn b ON a.i = b.j AND a.j = b.i")
def _(s, d):
    m = nn(s, d)
    return E.ewise_mult(m, m.transpose(), op=ops.multiplication).df


@query("ewise_add", f"WITH {ND}, t AS (SELECT j AS i, i AS j, v FROM nd) SELECT coalesce(a.i, b.i) AS i, coalesce(a.j, b.j) AS j, coalesce(b.v, a.v) AS v FROM nd a FULL JOIN t b ON a.i = b.i AND a.j = b.j")
def _(s, d):
    m = nd(s, d)
    return E.ewise_add(m, m.transpose()).df


@query("add", f"WITH {ND} SELECT i, j, CAST(sum(v) AS DOUBLE) AS v FROM (SELECT * FROM nd UNION ALL SELECT j, i, v FROM nd) GROUP BY 1, 2")
def _(s, d):
    m = nd(s, d)
    return E.add(m, m.transpose()).df


@query("subtract", f"WITH {NN} SELECT i, j, CAST(sum(v) AS BIGINT) AS v FROM (SELECT * FROM nn UNION ALL SELECT j, i, -v FROM nn) GROUP BY 1, 2 HAVING sum(v) <> 0")
def _(s, d):
    m = nn(s, d)
    return E.subtract(m, m.transpose()).df


@query("ewise_least", f"WITH {NN} SELECT a.i, a.j, least(a.v, b.v) AS v FROM nn a JOIN nn b ON a.i = b.j AND a.j = b.i")
def _(s, d):
    m = nn(s, d)
    return E.least(m, m.transpose()).df


# ---------------------------------------------------------------- reductions


@query("reduce_columns", f"WITH {SP} SELECT p_partkey AS i, greatest(0, coalesce(max(v), 0)) AS v FROM part LEFT JOIN sp ON j = p_partkey GROUP BY 1")
def _(s, d):
    return R.to_vector(sp(s, d)).df


@query("reduce_columns_monoid", f"WITH {SP} SELECT p_partkey AS i, CAST(coalesce(sum(v), 0) AS DOUBLE) AS v FROM part LEFT JOIN sp ON j = p_partkey AND sp.i >= 5 GROUP BY 1")
def _(s, d):
    return R.to_vector(sp(s, d), algebra.plus(), mask=lambda i: i < 5).df


@query("reduce_scalar", f"WITH {SP} SELECT CAST(sum(v) AS DOUBLE) AS v FROM sp")
def _(s, d):
    return R.to_scalar(sp(s, d))


@query("reduce_scalar_monoid", f"WITH {NN} SELECT CAST(min(v) AS BIGINT) AS v FROM nn WHERE i <> j")
def _(s, d):
    return R.to_scalar(nn(s, d), algebra.least("bigint", 1 << 40), mask=lambda i, j: i == j)


@query("reduce_vector", f"WITH {SP} SELECT CAST(sum(v) AS DOUBLE) AS v FROM sp WHERE i = 5")
def _(s, d):
    return R.to_scalar(sp(s, d).row(5))


@query("reduce_custom", f"WITH {NN} SELECT CAST(sum(v * CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT) AS v FROM (SELECT v, row_number() OVER (ORDER BY i, j) + (SELECT count(*) FROM nn) AS k FROM nn)")
def _(s, d):
    # a fold that depends on the order: v - accumulated; from 0 over an odd count the signs alternate, the last being plus
    folded = algebra.Monoid(0, ops.BinaryOp(lambda acc, v: v - acc), None, "bigint")
    return R.to_scalar(nn(s, d), folded)


@query("monoid_reduce", f"WITH {NN} SELECT i, CAST(sum(v) AS BIGINT) AS v FROM nn GROUP BY i")
def _(s, d):
    rows = nn(s, d).df.groupBy("i").agg(F.collect_list("v").alias("a"))
    return rows.select("i", algebra.plus("bigint").reduce(F.col("a")).alias("v"))


@query("row_sums", f"WITH {SP} SELECT i, CAST(sum(v) AS DOUBLE) AS v FROM sp GROUP BY i")
def _(s, d):
    return R.row_sums(sp(s, d)).df


@query("row_largest", f"WITH {SP} SELECT i, max(v) AS v FROM sp GROUP BY i")
def _(s, d):
    return R.row_largest(sp(s, d)).df


@query("row_argmax", f"WITH {NN} SELECT i, j FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY v DESC, j) AS nth FROM nn) WHERE nth = 1")
def _(s, d):
    return R.row_argmax(nn(s, d))


@query("dot", f"WITH {SP} SELECT CAST(coalesce(sum(a.v * b.v), 0) AS DOUBLE) AS v FROM sp a JOIN sp b ON a.i = 5 AND b.i = 6 AND a.j = b.j")
def _(s, d):
    m = sp(s, d)
    return R.dot(m.row(5), m.row(6))


@query("change", f"WITH {NN} SELECT CAST(sum(abs(coalesce(a.v, 0) - coalesce(b.v, 0))) AS DOUBLE) AS total, CAST(max(abs(coalesce(a.v, 0) - coalesce(b.v, 0))) AS DOUBLE) AS largest FROM nn a FULL JOIN nn b ON a.i = b.j AND a.j = b.i")
def _(s, d):
    m = nd(s, d)
    total, largest = R.change(m, m.transpose())
    return s.createDataFrame([(total, largest)], "total double, largest double")


# ---------------------------------------------------------------- scalar operators

_LINES = "SELECT l_orderkey, l_linenumber, "


def _lines(s: SparkSession, d: str, /, **columns: Column) -> DataFrame:
    return _read(s, d, "lineitem").select("l_orderkey", "l_linenumber", *(c.alias(k) for k, c in columns.items()))


def _arithmetic(s: SparkSession, d: str) -> DataFrame:
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    out = dict(a=ops.addition(q, n), sb=ops.subtraction(q, n), m=ops.multiplication(q, n), d=F.round(ops.division(q, n), 6), di=ops.integer_division(F.col("l_orderkey") - 100, n.cast("long")), mi=ops.minimum(q, n * 10), ma=ops.maximum(q, n * 10), f=ops.first_argument(q, n), g=ops.second_argument(q, n))
    return _lines(s, d, **out)


@query("scalar_arithmetic", _LINES + "l_quantity + l_linenumber AS a, l_quantity - l_linenumber AS sb, l_quantity * l_linenumber AS m, round(l_quantity / l_linenumber, 6) AS d, CAST((l_orderkey - 100) // l_linenumber AS BIGINT) AS di, least(l_quantity, l_linenumber * 10) AS mi, greatest(l_quantity, l_linenumber * 10) AS ma, l_quantity AS f, l_linenumber AS g FROM lineitem")
def _(s, d):
    return _arithmetic(s, d)


@query("scalar_comparison", _LINES + "l_quantity = l_linenumber AS eq, l_quantity <> l_linenumber AS ne, l_quantity > l_linenumber AS gt, l_quantity < l_linenumber AS lt, l_quantity >= l_linenumber AS ge, l_quantity <= l_linenumber AS le FROM lineitem")
def _(s, d):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    return _lines(s, d, eq=ops.equal(q, n), ne=ops.not_equal(q, n), gt=ops.greater_than(q, n), lt=ops.less_than(q, n), ge=ops.greater_than_or_equal(q, n), le=ops.less_than_or_equal(q, n))


@query("scalar_boolean", _LINES + "(l_quantity > 25) OR (l_linenumber > 2) AS o, (l_quantity > 25) AND (l_linenumber > 2) AS a, (l_quantity > 25) <> (l_linenumber > 2) AS x, NOT (l_quantity > 25) AS n FROM lineitem")
def _(s, d):
    p, q = F.col("l_quantity") > 25, F.col("l_linenumber") > 2
    return _lines(s, d, o=ops.logical_or(p, q), a=ops.logical_and(p, q), x=ops.logical_xor(p, q), n=ops.logical_inverse(p))


@query("scalar_functions", _LINES + "round(pow(l_quantity, 1.5), 4) AS p, abs(l_quantity - 25) AS b, round(sqrt(l_quantity), 6) AS r, l_quantity - 1 = 0 AS z FROM lineitem")
def _(s, d):
    q = F.col("l_quantity")
    return _lines(s, d, p=F.round(ops.power(1.5)(q), 4), b=ops.absolute(q - 25), r=F.round(ops.square_root(q), 6), z=ops.is_zero(q - 1, "double"))


# ---------------------------------------------------------------- graphs


def _reach(graph: str, name: str, start: int) -> str:
    return f"WITH RECURSIVE {graph}, r(i, level) AS (SELECT CAST({start} AS BIGINT), CAST(0 AS BIGINT) UNION SELECT g.j, r.level + 1 FROM r JOIN {name} g ON g.i = r.i WHERE r.level < 25) SELECT i, min(level) AS level FROM r GROUP BY i"


@query("bfs_levels", _reach(CC, "cc", 0))
def _(s, d):
    return traversal.levels(cc(s, d), 0)


@query(
    "bfs_search",
    f"""WITH {CC}, f1 AS (SELECT j AS i, CAST(sum(v) AS DOUBLE) AS v FROM cc WHERE i = 0 AND j <> 0 GROUP BY j)
SELECT n.j AS i, CAST(sum(n.v * f1.v) AS DOUBLE) AS v FROM cc n JOIN f1 ON f1.i = n.i WHERE n.j <> 0 AND n.j NOT IN (SELECT i FROM f1) GROUP BY n.j""",
)
def _(s, d):
    rounds = []
    return traversal.search(cc(s, d).transpose(), 0, lambda f: rounds.append(f) or len(rounds) == 2).df


ROUNDS = 24


def _distances(graph: str, name: str, start: int, rounds: int = ROUNDS) -> str:
    steps = [f"d0(i, d) AS (SELECT CAST({start} AS BIGINT), CAST(0 AS DOUBLE))"]
    steps += [f"d{k}(i, d) AS MATERIALIZED (SELECT i, min(d) FROM (SELECT i, d FROM d{k - 1} UNION ALL SELECT g.j, p.d + g.v FROM d{k - 1} p JOIN {name} g ON g.i = p.i) GROUP BY i)" for k in range(1, rounds + 1)]
    return f"{graph}, {', '.join(steps)}"


@query("sssp", f"WITH {_distances(CC, 'cc', 0)} SELECT i, d AS v FROM d{ROUNDS}")
def _(s, d):
    return traversal.single_source(cc(s, d), 0).df


_TARGETS = (0, 7, 13)


# The last step to a vertex comes from the nearest vertex of those that its distance may come from, then the smallest.
@query(
    "between",
    f"""WITH RECURSIVE {_distances(CC, 'cc', 0)},
b AS MATERIALIZED (SELECT v, u FROM (SELECT x.i AS v, g.i AS u, row_number() OVER (PARTITION BY x.i ORDER BY y.d, g.i) AS nth FROM d{ROUNDS} x JOIN cc g ON g.j = x.i JOIN d{ROUNDS} y ON y.i = g.i WHERE y.d + g.v = x.d AND x.i <> 0) WHERE nth = 1),
w(target, here, path) AS (SELECT CAST(t AS BIGINT), CAST(t AS BIGINT), CAST(t AS VARCHAR) FROM (SELECT unnest({list(_TARGETS)}) AS t) UNION ALL SELECT target, u, concat(u, '>', path) FROM w JOIN b ON b.v = w.here)
SELECT target, d AS distance, path FROM w JOIN d{ROUNDS} ON d{ROUNDS}.i = target WHERE here = 0""",
)
def _(s, d):
    m = cc(s, d)
    found = [(t, *traversal.between(m, 0, t)) for t in _TARGETS]
    return s.createDataFrame([(t, x, ">".join(map(str, path))) for t, x, path in found if path], "target long, distance double, path string")


@query("components", "WITH RECURSIVE e AS MATERIALIZED (SELECT i, j FROM (SELECT event_id AS i, lead(event_id) OVER (ORDER BY event_id) AS j, user_id = lead(user_id) OVER (ORDER BY event_id) AS same FROM events) WHERE same), r(vertex, label) AS (SELECT event_id, event_id FROM events UNION ALL SELECT e.j, r.label FROM r JOIN e ON e.i = r.vertex) SELECT vertex, min(label) AS label FROM r GROUP BY 1")
def _(s, d):
    """Runs of events of one user."""
    events = _read(s, d, "events").select("event_id", "user_id")
    after = _after(events, "event_id", "user_id").where("who = to").select(F.col("at").alias("i"))
    ids = _after(events.withColumn("same", F.col("event_id")), "event_id", "same").select(F.col("at").alias("i"), F.col("to").alias("j"))
    n = events.agg(F.max("event_id")).first()[0] + 1
    return clustering.components(ids.join(after, "i"), n).join(events.select(F.col("event_id").alias("vertex")), "vertex", "left_semi")


def _ranks(rounds: int) -> str:
    steps = ["n AS (SELECT max(user_id) + 1 AS n FROM events)", "o AS MATERIALIZED (SELECT i, sum(v) AS t FROM uu GROUP BY i)", "v AS MATERIALIZED (SELECT unnest(range(n)) AS i FROM n)", "r0 AS (SELECT i, 1.0 / n AS r FROM v, n)"]
    for k in range(1, rounds + 1):
        loose = f"(SELECT coalesce(sum(r), 0) AS l FROM r{k - 1} WHERE i NOT IN (SELECT i FROM o))"
        got = f"(SELECT uu.j AS i, sum(r * uu.v / t) AS g FROM uu JOIN r{k - 1} p ON p.i = uu.i JOIN o ON o.i = uu.i GROUP BY 1)"
        steps.append(f"r{k} AS MATERIALIZED (SELECT v.i, 0.85 * coalesce(g, 0) + 0.15 / n + 0.85 * l / n AS r FROM v CROSS JOIN n CROSS JOIN {loose} LEFT JOIN {got} g ON g.i = v.i)")
    return f"WITH {UU}, {', '.join(steps)} SELECT i, round(CAST(r AS DOUBLE), 8) AS v FROM r{rounds}"


@query("pagerank", _ranks(10))
def _(s, d):
    return centrality.pagerank(uu(s, d), tolerance=-1, rounds=10).df.select("i", F.round("v", 8).alias("v"))


@query("pagerank_converged", _ranks(60))
def _(s, d):
    return centrality.pagerank(uu(s, d), tolerance=1e-12).df.select("i", F.round("v", 8).alias("v"))


def _betweenness(sources: str, levels: int = 8) -> str:
    """By numbers of shortest paths: through v go those from s to v times those from v to t, where the distances add up. A source counts as often as it is given."""
    vertices = "unnest(range((SELECT max(user_id) + 1 FROM events)))"
    steps = [f"vs AS MATERIALIZED (SELECT {vertices} AS s)", "s0 AS MATERIALIZED (SELECT s, s AS t, 0 AS d, CAST(1 AS DOUBLE) AS p FROM vs)"]
    for k in range(1, levels + 1):
        seen = " UNION ALL ".join(f"SELECT s, t FROM s{m}" for m in range(k))
        steps.append(f"s{k} AS MATERIALIZED (SELECT a.s, uu.j AS t, {k} AS d, sum(p) AS p FROM s{k - 1} a JOIN uu ON uu.i = a.t WHERE (a.s, uu.j) NOT IN ({seen}) GROUP BY 1, 2)")
    every = " UNION ALL ".join(f"SELECT * FROM s{m}" for m in range(levels + 1))
    through = "(SELECT x.t AS v, sum(n * x.p * y.p / z.p) AS b FROM a x JOIN g ON g.s = x.s JOIN a y ON y.s = x.t JOIN a z ON z.s = x.s AND z.t = y.t AND z.d = x.d + y.d WHERE x.s <> x.t AND y.t <> x.t GROUP BY 1)"
    return f"WITH {UU}, {', '.join(steps)}, a AS MATERIALIZED ({every}), g AS (SELECT s, count(*) AS n FROM ({sources}) GROUP BY s) SELECT vs.s AS i, round(coalesce(b, 0), 6) AS v FROM vs LEFT JOIN {through} ON v = vs.s"


@query("betweenness", _betweenness("SELECT s FROM vs"))
def _(s, d):
    return centrality.betweenness(uu(s, d)).df.select("i", F.round("v", 6).alias("v"))


@query("betweenness_sources", _betweenness("SELECT unnest([0, 3, 3]) AS s"))
def _(s, d):
    return centrality.betweenness(uu(s, d), [0, 3, 3], batch=2).df.select("i", F.round("v", 6).alias("v"))


_USERS = "(SELECT unnest(range((SELECT max(user_id) + 1 FROM events))) AS k)"


def _all_distances(rounds: int = ROUNDS) -> str:
    steps = [f"d0(s, v, d) AS (SELECT CAST(k AS BIGINT), CAST(k AS BIGINT), CAST(0 AS DOUBLE) FROM {_USERS})"]
    steps += [f"d{k}(s, v, d) AS MATERIALIZED (SELECT s, v, min(d) FROM (SELECT s, v, d FROM d{k - 1} UNION ALL SELECT p.s, g.j, p.d + g.v FROM d{k - 1} p JOIN uu g ON g.i = p.v) GROUP BY 1, 2)" for k in range(1, rounds + 1)]
    return f"WITH {UU}, {', '.join(steps)}"


@query("closeness", f"{_all_distances()} SELECT CAST(k AS BIGINT) AS i, round(coalesce(max(r / t * r / (SELECT max(user_id) FROM events)), 0), 8) AS v FROM {_USERS} LEFT JOIN (SELECT s, CAST(count(*) AS DOUBLE) AS r, sum(d) AS t FROM d{ROUNDS} WHERE s <> v GROUP BY s) ON s = k GROUP BY k")
def _(s, d):
    return centrality.closeness(uu(s, d)).df.select("i", F.round("v", 8).alias("v"))


@query("all_pairs", f"{_all_distances()} SELECT s AS source, v, d FROM d{ROUNDS}")
def _(s, d):
    return traversal.all_pairs(uu(s, d))


@query("symmetrized", f"WITH {ND} SELECT i, CAST(sum(v) AS DOUBLE) AS v FROM (SELECT i, v FROM nd UNION ALL SELECT j, v FROM nd) GROUP BY i")
def _(s, d):
    return clustering.symmetrized(nd(s, d))[1].df


def _flow(graph: str, name: str, rounds: int, inflation: int) -> str:
    steps = [f"w AS MATERIALIZED (SELECT i, j, sum(v) AS v FROM (SELECT * FROM {name} UNION ALL SELECT j, i, v FROM {name}) GROUP BY 1, 2)", "l AS (SELECT * FROM w UNION ALL SELECT i, i, max(v) FROM w GROUP BY i)"]
    steps += ["m0 AS MATERIALIZED (SELECT i, j, sum(v) / sum(sum(v)) OVER (PARTITION BY i) AS v FROM l GROUP BY 1, 2)"]
    for k in range(1, rounds + 1):
        steps += [f"x{k} AS (SELECT a.i, b.j, pow(sum(a.v * b.v), {inflation}) AS p FROM m{k - 1} a JOIN m{k - 1} b ON a.j = b.i GROUP BY 1, 2)"]
        steps += [f"p{k} AS (SELECT i, j, p, sum(p) OVER (PARTITION BY i) AS t, max(p) OVER (PARTITION BY i) AS h FROM x{k})"]
        steps += [f"m{k} AS MATERIALIZED (SELECT i, j, p / sum(p) OVER (PARTITION BY i) AS v FROM p{k} WHERE p = h OR p / t >= 1e-5)"]
    return f"{graph}, {', '.join(steps)}"


@query("markov_flow", f"WITH {_flow(ND, 'nd', 1, 2)} SELECT i, j, round(v, 8) AS v FROM m1")
def _(s, d):
    return clustering.flow(nd(s, d), 2, 1).df.select("i", "j", F.round("v", 8).alias("v"))


# The number of clusters by their lowest vertices, as canonical() has it.
_NUMBERED = "SELECT vertex, dense_rank() OVER (ORDER BY first) - 1 AS label FROM (SELECT vertex, min(vertex) OVER (PARTITION BY label) AS first FROM {0})"


@query("markov", f"WITH RECURSIVE {_flow(UU, 'uu', 40, 4)}, e AS MATERIALIZED (SELECT i, j FROM m40 UNION SELECT j, i FROM m40), r(vertex, label) AS (SELECT CAST(k AS BIGINT), CAST(k AS BIGINT) FROM {_USERS} UNION SELECT r.vertex, e.j FROM r JOIN e ON e.i = r.label), c AS (SELECT vertex, min(label) AS label FROM r GROUP BY 1) {_NUMBERED.format('c')}")
def _(s, d):
    return clustering.markov(uu(s, d), inflation=4)


def _votes(rounds: int = 50) -> str:
    steps = [f"e AS (SELECT * FROM uu UNION ALL SELECT k, k, coalesce(h, 1) FROM {_USERS} LEFT JOIN (SELECT i, max(v) AS h FROM uu GROUP BY i) ON i = k)"]
    steps += ["s AS MATERIALIZED (SELECT j AS vertex, i AS who, sum(v) / any_value(t) AS share FROM (SELECT *, sum(v) OVER (PARTITION BY i) AS t FROM e) GROUP BY 1, 2)", "c0 AS (SELECT DISTINCT vertex, vertex AS label FROM s)"]
    for k in range(1, rounds + 1):
        steps += [f"c{k} AS MATERIALIZED (SELECT vertex, label FROM (SELECT vertex, label, row_number() OVER (PARTITION BY vertex ORDER BY round(sum(share), 10) DESC, label) AS nth FROM s JOIN (SELECT vertex AS who, label FROM c{k - 1}) USING (who) GROUP BY 1, 2) WHERE nth = 1)"]
    return f"WITH {UU}, {', '.join(steps)} {_NUMBERED.format(f'c{rounds}')}"


@query("peer_pressure", _votes())
def _(s, d):
    return clustering.peer_pressure(uu(s, d))


@query("groups", f"WITH {ND} SELECT i % 4 AS label, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS members FROM (SELECT DISTINCT i FROM nd) GROUP BY 1")
def _(s, d):
    labels = nd(s, d).df.select(F.col("i").alias("vertex"), (F.col("i") % 4).alias("label")).distinct()
    return clustering.groups(labels).select("label", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


@query("canonical", f"WITH {ND}, l AS (SELECT DISTINCT i AS vertex, (i * 7) % 5 AS label FROM nd), f AS (SELECT label, row_number() OVER (ORDER BY min(vertex)) - 1 AS k FROM l GROUP BY label) SELECT vertex, k AS label FROM l JOIN f USING (label)")
def _(s, d):
    return clustering.canonical(nd(s, d).df.select(F.col("i").alias("vertex"), (F.col("i") * 7 % 5).alias("label")).distinct())


EPSILON = 1e-4


def _local(seed: int, rounds: int = 60, share: float = 0.15) -> str:
    steps = ["w AS MATERIALIZED (SELECT i, j, sum(v) AS v FROM (SELECT * FROM uu UNION ALL SELECT j, i, v FROM uu) GROUP BY 1, 2)", "d AS MATERIALIZED (SELECT i, sum(v) AS deg FROM w GROUP BY i)"]
    steps += [f"q0 AS (SELECT i, CAST(0 AS DOUBLE) AS p, CAST(1 AS DOUBLE) AS r, deg FROM d WHERE i = {seed})"]
    goes = f"r > 0 AND r >= {EPSILON} * deg"
    for k in range(1, rounds + 1):
        kept = f"SELECT i, CASE WHEN {goes} THEN p + {share} * r ELSE p END AS p, CASE WHEN {goes} THEN (1 - {share}) * r / 2 ELSE r END AS r FROM q{k - 1}"
        sent = f"SELECT w.j, 0, (1 - {share}) / 2 * w.v * a.r / a.deg FROM (SELECT * FROM q{k - 1} WHERE {goes}) a JOIN w ON w.i = a.i"
        steps += [f"q{k} AS MATERIALIZED (SELECT i, p, r, deg FROM (SELECT i, sum(p) AS p, sum(r) AS r FROM ({kept} UNION ALL {sent}) GROUP BY i) JOIN d USING (i))"]
    steps += [f"o AS MATERIALIZED (SELECT i, deg, row_number() OVER (ORDER BY round(p / deg, 12) DESC, i) AS pos FROM q{rounds} WHERE p > 0)"]
    # An edge is cut while exactly one of its ends is in.
    steps += ["c AS MATERIALIZED (SELECT a.pos, sum(w.v) AS cut FROM (SELECT DISTINCT pos FROM o) a JOIN o x ON x.pos <= a.pos JOIN w ON w.i = x.i LEFT JOIN o y ON y.i = w.j WHERE y.pos IS NULL OR y.pos > a.pos GROUP BY 1)"]
    steps += ["v AS (SELECT pos, sum(deg) OVER (ORDER BY pos) AS volume FROM o)", "g AS (SELECT pos, least(volume, (SELECT sum(deg) FROM d) - volume) AS side, coalesce(cut, 0) AS cut FROM v LEFT JOIN c USING (pos))"]
    steps += [f"b AS (SELECT pos FROM g WHERE side > 0 AND pos >= (SELECT pos FROM o WHERE i = {seed}) ORDER BY round(cut / side, 12), pos LIMIT 1)"]
    return f"WITH {UU}, {', '.join(steps)} SELECT i AS vertex FROM o WHERE pos <= (SELECT pos FROM b)"


@query("local_cluster", _local(0))
def _(s, d):
    return clustering.local(uu(s, d), 0, epsilon=EPSILON)


@query("spectral")
def _(s, d):
    return clustering.spectral(uu(s, d), 3, rounds=40)


@query("row_reduction", "SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(v AS DOUBLE) AS v FROM (VALUES (0, 0, 1), (0, 1, 0), (0, 2, 0), (0, 3, -8), (1, 0, 0), (1, 1, 1), (1, 2, 0), (1, 3, 1), (2, 0, 0), (2, 1, 0), (2, 2, 1), (2, 3, -2)) t(i, j, v)")
def _(s, d):
    m = builders.from_array(s, [[1.0, 2.0, -1.0, -4.0], [2.0, 3.0, -1.0, -11.0], [-2.0, 0.0, -3.0, 22.0]], layout="dense")
    return reduced(m).df.select("i", "j", (F.round("v", 6) + 0.0).alias("v"))


# ---------------------------------------------------------------- streams

#: Lines of a file of arrivals at most.
ARRIVAL = 250_000


@query("stream_edges", f"WITH {SP} SELECT * FROM sp")
def _(s, d):
    """The lines as a stream, folded into a stored matrix. Files and batches have a bounded number of lines: more lines are more batches, of 16 files, two at least."""
    path = f"{shared_dir(s)}/loomgraph/stream-{uuid.uuid4().hex}"
    lines = _read(s, d, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    lines.write.option("maxRecordsPerFile", max(1, min(ARRIVAL, lines.count() // 32))).parquet(f"{path}/arrivals")
    stream = s.readStream.schema(lines.schema).option("maxFilesPerTrigger", 16).parquet(f"{path}/arrivals")
    edges.fold(stream, f"{path}/sums", f"{path}/state", "l_suppkey", "l_partkey", "l_quantity").awaitTermination()
    n, m = (_read(s, d, t).count() for t in ("supplier", "part"))
    return edges.folded(s, f"{path}/sums", n, m).df
