"""Exact top-k by inner product with a vector-approximation file.

Vectors are integers, floor(SCALE * x). The approximation file holds each component's cell number in a byte (the component
shifted right by BITS, and by more in vectors with components that need it), in blocks. Scanning it gives every (query, vector)
bounds of the score: each component lies between its cell's ends.

Two scans. The first keeps, per query and block, the k + 1 best lower bounds; the best k + 1 of all blocks are the query's
cutoff. The second gives the vectors whose upper bound reaches it. These are read exactly in the order of their upper bounds: a
first lot, whose scores raise the cutoff, and then only those that can still reach the kth result, which makes it certain.

Queries go in blocks, and as many blocks as fit in BROADCAST_BYTES are sent to all tasks at a time, so the approximation file
is never shuffled and the number of queries has no limit. The rows that come out of a scan grow with queries, not with pairs.

Equal vectors are one class; of a class, only the k + 1 smallest ids can be among a query's k best besides itself, so the
others are left out before the search (which loses nothing). Equal queries are searched once, for k + 1 results, of which
each drops its own row.

Defined cases: vectors that are null or hold a null, a NaN or an infinity take no part, as query or candidate, nor do rows
with a null vec_id, nor those with a component whose SCALE-fold isn't finite; an empty vector scores 0. Vectors are compared
with vectors of their own length only. Repeated rows are candidates each, and a query row excludes one row with its own id;
further rows with that id and vector count as others. Ties go to the smaller vec_id. Components of any size are exact; scores
beyond 64 bits count as the largest or smallest number of 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm.common import dropped, freed, new_path, table, written

SCALE = 64
K = 20
EVERY = 20
#: Cells are 2^BITS integers wide, or more where a component needs it to be a byte's number.
BITS = 1
#: Vectors in a block of cells, and queries in a block.
CELL_BLOCK = 16384
QUERY_BLOCK = 2048
#: Query blocks that are sent to every task at a time.
BROADCAST_BYTES = 32 << 20
#: Whole numbers below are exact in doubles.
EXACT = float(1 << 52)


def integers(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, v (array of double, whole numbers) of the rows that take part."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double") * F.lit(float(scale)))
    kept = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("x")).where("vec_id is not null and x is not null")
    kept = kept.where(F.forall("x", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
    # from 2^52 on every double is whole; minus zero becomes zero
    return kept.select("vec_id", F.transform("x", lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x) + F.lit(0.0)).alias("v"))


def cells_of(v: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell numbers (bytes) of vectors, and the bits that each vector's cells are wide."""
    most = np.abs(v).max(axis=1, initial=0)
    wide = np.maximum(bits, np.frexp(most)[1] - 7)
    return np.floor(np.ldexp(v, -wide[:, None])).astype(np.int8), wide.astype(np.int16)


def bounds(q: np.ndarray, cells: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of q (queries x dim) and the vectors of cells (vectors x dim)."""
    with np.errstate(over="ignore", invalid="ignore"):
        lo = np.ldexp(cells.astype(np.float64), wide[:, None].astype(np.int64))
        step = np.ldexp(1.0, wide.astype(np.int64)) - (wide < 40)  # whole numbers are one less wide
        middle = q @ lo.T
        low, high = middle + np.minimum(q, 0).sum(axis=1)[:, None] * step, middle + np.maximum(q, 0).sum(axis=1)[:, None] * step
        size = np.abs(q).sum(axis=1)[:, None] * (np.abs(lo).max(axis=1, initial=0) + step)
        if not (size < EXACT).all():  # sums that doubles may have rounded
            slack = np.where(size < EXACT, 0, size * 1e-12)
            low, high = low - slack, high + slack
            low, high = np.where(np.isfinite(low), low, -np.inf), np.where(np.isfinite(high), high, np.inf)
    return low, high


def _packed(rows: DataFrame, size: int, bits: int | None) -> DataFrame:
    """dim, block, ids, data, wide: rows (id, v and maybe cut) in blocks of at most size vectors; data holds v, or its cell numbers with their widths. Without bits, wide holds the cuts."""
    has_cut = "cut" in rows.columns

    def run(batches):
        waiting: dict[int, list[tuple]] = {}

        def block(dim: int):
            got = waiting.pop(dim)
            ids = np.array([g[0] for g in got], "<i8")
            data = np.array([g[1] for g in got], "<f8").reshape(len(got), dim)
            more = np.array([-np.inf if len(g) < 3 or g[2] is None else g[2] for g in got], "<f8")
            if bits is not None:
                data, more = cells_of(data, bits)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([int(ids.min())], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, data, more))], names=["dim", "block", "ids", "data", "wide"])

        for batch in batches:
            for got in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = waiting.setdefault(len(got[1]), [])
                own.append(got)
                if len(own) >= size:
                    yield block(len(got[1]))
        for dim in list(waiting):
            yield block(dim)

    rows = rows.select("id", "v", "cut") if has_cut else rows.select("id", "v")
    return rows.coalesce(max(1, -(-rows.count() // size))).mapInArrow(freed(run), "dim int, block long, ids binary, data binary, wide binary")


def _scan(cells: DataFrame, blocks: DataFrame):
    """Pairs of a block of cells and a block of queries, for _bounded()."""
    asked = blocks.select("dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("wide").alias("q_cut"))
    return cells.join(F.broadcast(asked), "dim").select("dim", "q_ids", "q_data", "q_cut", "ids", "data", "wide")


def _bounded(batches):
    """Ids of 128 queries, their cuts, ids of vectors, lower and upper bounds."""
    for batch in batches:
        for row in range(batch.num_rows):
            dim, q_ids, q_data, q_cut, ids, data, wide = (c[row].as_py() for c in batch.columns)
            q_ids, ids, q_cut = np.frombuffer(q_ids, "<i8"), np.frombuffer(ids, "<i8"), np.frombuffer(q_cut, "<f8")
            q, c, wide = np.frombuffer(q_data, "<f8").reshape(len(q_ids), dim), np.frombuffer(data, np.int8).reshape(len(ids), dim), np.frombuffer(wide, "<i2")
            for at in range(0, len(q_ids), 128):
                yield q_ids[at : at + 128], q_cut[at : at + 128], ids, *bounds(q[at : at + 128], c, wide)


def _lows(pairs: DataFrame, k: int) -> DataFrame:
    """query, lows: the k best lower bounds of each query in each block."""

    def run(batches):
        for q_ids, _, ids, low, _ in _bounded(batches):
            n = min(k, len(ids))
            best = np.partition(low, len(ids) - n, axis=1)[:, len(ids) - n :]
            yield pa.RecordBatch.from_arrays([pa.array(q_ids), pa.ListArray.from_arrays(pa.array(np.arange(len(q_ids) + 1, dtype=np.int32) * n), pa.array(best.reshape(-1)))], names=["query", "lows"])

    return pairs.mapInArrow(freed(run), "query long, lows array<double>")


def _reaching(pairs: DataFrame) -> DataFrame:
    """query, key, high: the vectors whose upper bound reaches the query's cut."""

    def run(batches):
        for q_ids, cut, ids, _, high in _bounded(batches):
            r, s = np.nonzero(high >= cut[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[r]), pa.array(ids[s]), pa.array(high[r, s])], names=["query", "key", "high"])

    return pairs.mapInArrow(freed(run), "query long, key long, high double")


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products row by row, as 64-bit numbers."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.einsum("ij,ij->i", q, c)
        large = ~(np.abs(q).sum(axis=1) * np.abs(c).max(axis=1, initial=0) < EXACT)
    found = np.where(large, 0, out).astype(np.int64)
    for k in np.flatnonzero(large):
        found[k] = min(max(sum(int(x) * int(y) for x, y in zip(q[k], c[k])), -(1 << 63)), (1 << 63) - 1)
    return found


def _scored(pairs: DataFrame, classes: DataFrame, asked: DataFrame) -> DataFrame:
    """query, key, score of the pairs, from the exact vectors."""

    def run(batches):
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy()
            score = np.zeros(batch.num_rows, np.int64)
            flat = [c.flatten().to_numpy() for c in (batch.column(2), batch.column(3))]
            ends = np.cumsum(sizes)
            for dim in np.unique(sizes):
                mine = np.flatnonzero(sizes == dim)
                at = (ends[mine] - dim)[:, None] + np.arange(dim)
                score[mine] = exact(flat[0][at], flat[1][at])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["query", "key", "score"])

    rows = pairs.join(classes.select("key", F.col("v").alias("c")), "key").join(asked.select(F.col("id").alias("query"), "v"), "query")
    return rows.select("query", "key", "v", "c").mapInArrow(freed(run), "query long, key long, score long")


def _chunks(blocks: DataFrame) -> list[tuple[int, int]]:
    """First and last number of query blocks that are sent together."""
    out, size = [], 0
    for row in blocks.select("block", (F.octet_length("data") + F.octet_length("ids") + F.octet_length("wide")).alias("n")).orderBy("block").collect():
        if out and size + row["n"] <= BROADCAST_BYTES:
            out[-1], size = (out[-1][0], row["block"]), size + row["n"]
        else:
            out.append((row["block"], row["block"]))
            size = row["n"]
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, bits: int = BITS, cell_block: int = CELL_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score. Both tables: vec_id, v; a query's own row is no candidate."""
    spark = vectors.sparkSession
    # Classes of equal vectors, with keys of their own.
    smallest = W.partitionBy("v").orderBy("vec_id", "at")
    few = vectors.select("vec_id", "v").withColumn("at", F.monotonically_increasing_id()).withColumn("nth", F.row_number().over(smallest)).where(F.col("nth") <= k + 1)
    members = written(few.select("vec_id", "v", "nth"), "members")
    classes = written(members.where("nth = 1").select(F.monotonically_increasing_id().alias("key"), "v"), "classes")
    asked = written(queries.select("v").distinct().select(F.monotonically_increasing_id().alias("id"), "v"), "queries")

    cells = written(_packed(classes.select(F.col("key").alias("id"), "v"), cell_block, bits), "cells")
    blocks = written(_packed(asked, query_block, None), "blocks")
    path = new_path(spark, "reaching")
    _reaching(_scan(cells.limit(0), blocks.limit(0))).write.parquet(path)  # so that there is a table without any query
    for lo, hi in _chunks(blocks):  # the stated query set against all rows, a lot of queries at a time
        here = blocks.where(F.col("block").between(lo, hi))
        lows = _lows(_scan(cells, here), k + 1)
        best = F.sort_array(F.flatten(F.collect_list("lows")), asc=False)
        cuts = lows.groupBy("query").agg(F.get(best, F.lit(k)).alias("cut"))
        again = written(_packed(asked.join(cuts, F.col("id") == F.col("query")).select("id", "v", "cut"), query_block, None), "blocks")
        _reaching(_scan(cells, again)).write.mode("append").parquet(path)
        dropped(again)
    found = spark.read.schema("query long, key long, high double").parquet(path)

    # Exact vectors in the order of their upper bounds, until no other can reach the kth score.
    order = W.partitionBy("query").orderBy(F.desc("high"), "key")
    found = written(found.withColumn("nth", F.row_number().over(order)), "order")
    first = 2 * (k + 1)
    scored = written(_scored(found.where(F.col("nth") <= first), classes, asked), "scored")
    by_score = W.partitionBy("query").orderBy(F.desc("score"))
    kth = scored.withColumn("nth", F.row_number().over(by_score)).where(F.col("nth") == k + 1).select("query", F.col("score").cast("double").alias("kth"))
    late = found.where(F.col("nth") > first).join(kth, "query").where("high >= kth")
    scored = scored.unionByName(written(_scored(late, classes, asked), "scored"))

    # k + 1 classes by score, and all that tie with the last; then their members.
    scored = scored.withColumn("nth", F.rank().over(by_score)).where(F.col("nth") <= k + 1).select("query", "key", "score")
    its = members.join(classes, "v").select("key", "vec_id")
    rows = scored.join(its, "key").select("query", "vec_id", "score")
    order = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1).select("query", "vec_id", "score", "nth")

    each = queries.select(F.col("vec_id").alias("query_id"), "v").join(asked, "v").select("query_id", F.col("id").alias("query"))
    each = each.withColumn("row", F.monotonically_increasing_id())
    joined = each.join(top, "query")
    own = W.partitionBy("row").orderBy("nth")
    first_own = F.min(F.when(F.col("vec_id") == F.col("query_id"), F.col("nth"))).over(W.partitionBy("row"))
    kept = joined.withColumn("own", first_own).where(F.col("own").isNull() | (F.col("nth") != F.col("own")))
    return kept.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op7_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(integers(table(spark, sf_dir, "embeddings")), "integers")
    return top_k(rows, rows.where(F.col("vec_id") % EVERY == 0))


QUERIES = {"op7_vector_search": op7_vector_search}
ORACLES = {
    "op7_vector_search": """
WITH fine AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM fine q JOIN fine c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 20 = 0
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
}
