"""Best-fit packing of tokenised documents into sequences of bounded length, under several capacities at once.

Every document (its ids, then the end id) becomes one piece, or several where it is longer than a sequence. Pieces are
dealt at random into groups of about GROUP pieces; within a group they go, longest first, each into the open sequence that
scores best among those with room in every dimension: tokens, number of pieces, attention cost (sum of squared lengths).
The score is the weighted residual norm after placing (least wins) or the weighted dot product of demand and room (most
wins), over all three dimensions (WEIGHTS). By itself the capacity on tokens bounds the others: there are at most as many pieces as tokens, and
the sum of squares is at most the square of the sum. Smaller capacities bind; a piece that is beyond the one on attention by
itself takes a sequence alone. A group leaves about one sequence part empty, so the loss against packing all pieces at once is about 1 in 3,000.

Defined cases: a null text counts as empty (one piece, the end id alone); null or repeated doc_ids are kept, each row
being a document; columns that aren't named are ignored; an empty table gives no rows. Ties go to the sequence that was
opened first.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from typing import Any

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.bpe_codec import codec
from loomgraph.llm.common import freed, table, written

LENGTH = 2048
#: Pieces that are packed together, on average.
GROUP = 8192
#: Of tokens, pieces and attention cost, in the score.
WEIGHTS = (1.0, 0.3, 0.3)
#: Texts whose pieces are held at once.
ROWS = 256
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, sequence_id long, offset long"


def cuts(n: int, length: int) -> list[tuple[int, int]]:
    """(start, size) of the pieces of n tokens: the first takes what full pieces leave."""
    first = n - (-(-n // length) - 1) * length
    return [(0, first), *((at, length) for at in range(first, n, length))]


def pieces(docs: DataFrame, length: int = LENGTH, end_id: int = 0, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """The pieces of all documents; with keep_ids also their ids."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches):
        enc, end = codec(path), np.array([end_id], "<u4").tobytes()
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = enc.encode(text.as_py() or "") + end
                for k, (at, n) in enumerate(cuts(len(raw) // 4, length)):
                    part = raw[4 * at : 4 * (at + n)]
                    rows.append((doc_id, k, at, n, zlib.crc32(part), *([np.frombuffer(part, "<u4").astype("i4")] if keep_ids else [])))
            columns = [*zip(*rows, strict=True)] or [[]] * (5 + keep_ids)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(freed(run, "codecs"), PIECES + (", ids array<int>" if keep_ids else ""))


def best_fit(lengths: np.ndarray, capacity: Sequence[float], weights: Sequence[float], score: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each piece. capacity: tokens, pieces, attention cost; each piece alone must fit in the first two."""
    order = np.argsort(-lengths, kind="stable")
    limit, weight = np.asarray(capacity, float), np.asarray(weights, float)
    place, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room = np.empty((3, len(lengths)))  # of the open bins, as shares of the capacity
    number = np.empty(len(lengths), np.int64)
    n_open = made = 0
    least = lengths.min(initial=0) / limit[0]
    for done, k in enumerate(order):
        size = float(lengths[k])
        need = np.array([size, 1.0, size * size]) / limit
        if (need[:2] > 1).any():
            raise ValueError(f"a piece of {int(size)} tokens is beyond a sequence's capacities")
        best = -1
        if n_open:
            left = room[:, :n_open] - need[:, None]
            fits = (left >= -1e-12).all(axis=0)
            if fits.any():
                worth = -(weight[:, None] * left * left).sum(axis=0) if score == "norm" else (weight[:, None] * room[:, :n_open] * need[:, None]).sum(axis=0)
                worth[~fits] = -np.inf
                best = int(worth.argmax())
        if best < 0:
            room[:, n_open], number[n_open] = 1.0, made
            best, n_open, made = n_open, n_open + 1, made + 1
        place[k] = number[best]
        offset[k] = round((1.0 - room[0, best]) * limit[0])
        room[:, best] -= need
        if done % 256 == 255:  # full ones are closed; the order of the others stays
            still = (room[0, :n_open] >= least - 1e-12) & (room[1, :n_open] > 0)
            room[:, : still.sum()], number[: still.sum()] = room[:, :n_open][:, still], number[:n_open][still]
            n_open = int(still.sum())
    return place, offset


def pack(found: DataFrame, length: int = LENGTH, max_pieces: int | None = None, max_attention: float | None = None, weights: Sequence[float] = WEIGHTS, score: str = "norm", group: int = GROUP) -> DataFrame:
    """found (rows of pieces(), computed once) with sequence_id and offset. The capacities besides length default to what any full sequence has, and so don't bind."""
    capacity = (float(length), float(max_pieces or length), float(max_attention or length * length))
    groups = max(1, -(-found.count() // group))
    names = found.columns

    def run(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable", na_position="first")
        place, offset = best_fit(rows["length"].to_numpy(), capacity, weights, score)
        return rows[names].assign(sequence_id=(np.int64(key[0]) << 32) + place, offset=offset)

    dealt = found.withColumn("grp", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    return dealt.groupBy("grp").applyInPandas(run, f"{', '.join(f'`{n}` {t}' for n, t in found.dtypes)}, sequence_id long, offset long")


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids, offsets of placed pieces that hold their ids. A sequence's rows are bounded by its length."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return placed.groupBy("sequence_id").agg(rows.alias("rows")).select("sequence_id", F.flatten(F.col("rows.ids")).alias("ids"), F.col("rows.doc_id").alias("doc_ids"), F.col("rows.offset").alias("offsets"))


def pack_documents(docs: DataFrame, max_pieces: int | None = None, max_attention: float | None = None) -> DataFrame:
    return pack(written(pieces(docs), "pieces"), max_pieces=max_pieces, max_attention=max_attention)


def op3_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op3_best_fit": op3_best_fit}
ORACLES: dict[str, str] = {}
