"""Substring deduplication by relative Lempel-Ziv parsing: each document is factored against all documents with smaller ids.

What is removed: every word inside a window of WINDOW consecutive words whose word sequence also starts in a document with
a smaller doc_id, as judged on the input.

Index of reference blocks. Each window has an anchor, the least hash among its SHORT-word grams; consecutive windows with one
anchor form a block. A document has about one block for 18 words. All blocks of all documents are indexed by anchor, with the
smallest document that has it and the block's place there. An anchor that stands in one document only needs nothing more. If
all blocks of an anchor are equal, that place is the reference of the whole block. Otherwise (mostly at the ends of passages)
each window of these blocks is indexed by itself, in the same way.

Parse. A document is read left to right. A factor copies from one place of one reference: it starts at the first match that
ends behind the factor before, takes the match that reaches farthest there, and goes on greedily for as long as the next
block or window continues at the next word of the same reference. Where a reference stops to agree, that is at every factor
boundary, the windows that cross it have been looked up by themselves, so factors may overlap and no window is missed. A
factor has at least WINDOW words and becomes a duplicate span.

Windows are compared by 128-bit fingerprints of their words' 64-bit hashes, blocks by one of 64 bits and their anchor.

Defined cases: a null or empty text has no words; documents under WINDOW words lose nothing. A null doc_id is neither
smaller nor larger than another: nothing is removed from such rows and they are no reference. Rows that share a doc_id are
each judged against smaller ids only; a factor's place is in one of the reference's rows. Texts of any length are hashed in
slices. Columns that aren't named are ignored, or passed on unchanged by remove(), whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import wordhash as H
from loomgraph.llm.common import dropped, freed, table, written

WINDOW = 50
SHORT = 16
#: Anchors (8 bytes each, to Python workers; some 40 bytes with their places, to joins) are sent to all tasks up to so many;
#: beyond that both sides are shuffled.
BROADCAST_ROWS = 1_000_000
#: Texts whose blocks or windows are held at once.
ROWS = 512
SPANS = "doc_id long, th long, spans array<struct<start: long, size: long, ref: long, place: long>>"


def _anchors(h: np.ndarray, window: int, short: int) -> np.ndarray:
    return H.sliding_min(H.ngrams(h, short), window - short + 1)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), text of the rows that have a doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("th"), "text")


def _blocks_of(h: np.ndarray, window: int, short: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first word and number of words of the blocks of a word sequence."""
    if len(h) < window:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    m = _anchors(h, window, short)
    first = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
    return m[first], first, np.diff(np.concatenate([first, [len(m)]])) + window - 1


def _rows(part: pa.RecordBatch, sizes: list[int], found: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    """One row for each element of the arrays in found, with doc_id and th of its document."""
    at = pa.array(np.repeat(np.arange(part.num_rows), sizes))
    return pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), *(_signed(np.concatenate([*x, np.empty(0, np.int64 if not x else x[0].dtype)])) for x in found)], names=["doc_id", "th", *names])


def blocks(docs: DataFrame, window: int = WINDOW, short: int = SHORT) -> DataFrame:
    """doc_id, th, anchor, print, start, size (words): the blocks of all documents that have a doc_id."""

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                found: list[list[np.ndarray]] = [[], [], [], []]
                for text in part.column(2):
                    h = H.hashed((text.as_py() or "").encode())
                    anchor, first, size = _blocks_of(h, window, short)
                    prints = H.Spans(h).of(first, size, 0) if len(first) else anchor
                    for to, x in zip(found, (anchor, prints, first, size), strict=True):
                        to.append(x)
                yield _rows(part, [len(x) for x in found[0]], found, ["anchor", "print", "start", "size"])

    return _keyed(docs).mapInArrow(freed(run), "doc_id long, th long, anchor long, print long, start long, size long")


def windows(docs: DataFrame, anchors: np.ndarray, window: int = WINDOW, short: int = SHORT) -> DataFrame:
    """doc_id, th, w1, w2, start: each window of the blocks with one of the anchors (sorted)."""
    shared = docs.sparkSession.sparkContext.broadcast(anchors)

    def run(batches):
        wanted = shared.value
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                found: list[list[np.ndarray]] = [[], [], []]
                for text in part.column(2):
                    h = H.hashed((text.as_py() or "").encode())
                    anchor, first, size = _blocks_of(h, window, short)
                    mine = wanted[np.minimum(np.searchsorted(wanted, anchor), len(wanted) - 1)] == anchor if len(wanted) else np.zeros(len(anchor), bool)
                    _windows_of(h, first[mine], size[mine], window, found)
                yield _rows(part, [len(x) for x in found[0]], found, ["w1", "w2", "start"])

    return _keyed(docs).mapInArrow(freed(run), "doc_id long, th long, w1 long, w2 long, start long")


def _windows_of(h: np.ndarray, first: np.ndarray, size: np.ndarray, window: int, found: list[list[np.ndarray]]) -> None:
    """Fingerprints and starts of the windows of some blocks, which don't share any."""
    n = size - window + 1
    at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)
    spans = H.Spans(h) if len(at) else None
    for to, x in zip(found, (spans.of(at, window, 0), spans.of(at, window, 1), at) if spans else (np.empty(0, np.uint64), np.empty(0, np.uint64), at), strict=True):
        to.append(x)


def windows_by_join(docs: DataFrame, wanted: DataFrame, window: int = WINDOW) -> DataFrame:
    """The same for any number of blocks, which are given by document: wanted has doc_id, th, start, size."""
    lists = wanted.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "size")).alias("blocks"))

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                found: list[list[np.ndarray]] = [[], [], []]
                for text, own in zip(part.column(2), part.column(3), strict=True):
                    own = sorted((b["start"], b["size"]) for b in own.as_py())
                    _windows_of(H.hashed((text.as_py() or "").encode()), np.array([b[0] for b in own], np.int64), np.array([b[1] for b in own], np.int64), window, found)
                yield _rows(part, [len(x) for x in found[0]], found, ["w1", "w2", "start"])

    # rows that repeat an id and a text are one reference as well as several
    texts = _keyed(docs).dropDuplicates(["doc_id", "th"]).join(lists, ["doc_id", "th"]).select("doc_id", "th", "text", "blocks")
    return texts.mapInArrow(freed(run), "doc_id long, th long, w1 long, w2 long, start long")


def matches(docs: DataFrame, window: int = WINDOW, short: int = SHORT) -> DataFrame:
    """doc_id, th, spans (array of start, size, ref, place): the factors of each document that has any."""
    every = written(blocks(docs, window, short), "blocks")
    least = [F.min("doc_id").alias("ref"), F.min_by("start", "doc_id").alias("place"), F.max("doc_id").alias("last")]
    shared = every.groupBy("anchor").agg(*least, (F.min("print") != F.max("print")).alias("uneven")).where("ref < last").drop("last")
    shared = written(shared, "index")
    uneven = shared.where("uneven").select("anchor")
    even = _sent(shared.where("not uneven").drop("uneven"))
    whole = every.join(even, "anchor").where("ref < doc_id")
    if uneven.count() <= BROADCAST_ROWS:
        anchors = np.sort(uneven.toPandas()["anchor"].to_numpy(np.int64).view(np.uint64))
        single = written(windows(docs, anchors, window, short), "windows")
    else:
        single = written(windows_by_join(docs, every.join(uneven, "anchor", "left_semi"), window), "windows")
    # The index of windows grows with the text, so it is joined by shuffle at any size; it is a table, so that a very common window can be split.
    first = written(single.groupBy("w1", "w2").agg(*least).where("ref < last").drop("last"), "index")
    hits = single.join(first.hint("merge"), ["w1", "w2"]).where("ref < doc_id").withColumn("size", F.lit(window).cast("long"))
    names = ["doc_id", "th", "start", "size", "ref", "place"]
    seeds = whole.select(*names).unionByName(hits.select(*names)).groupBy("doc_id", "th").agg(F.collect_set(F.struct(*names[2:])).alias("spans"))

    def run(batches):
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            found = [[dict(zip(names[2:], f)) for f in factors(own)] for own in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, batch.column(2).type)], names=["doc_id", "th", "spans"])

    out = written(seeds.mapInArrow(freed(run), SPANS), "spans")
    dropped(every, single, first)
    return out


def _sent(rows: DataFrame) -> DataFrame:
    """rows (of a written table), to be broadcast where they are few enough."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def factors(spans: list[dict]) -> list[tuple[int, int, int, int]]:
    """(start, size, reference, place there) of the factors of one document, left to right."""
    lines: dict[tuple[int, int], list[list[int]]] = {}
    for start, size, ref, place in sorted((x["start"], x["size"], x["ref"], x["place"]) for x in spans):
        own = lines.setdefault((ref, place - start), [])
        if own and start <= own[-1][0] + own[-1][1]:  # goes on in the same place
            own[-1][1] = max(own[-1][1], start + size - own[-1][0])
        else:
            own.append([start, size, ref, place])
    out: list[tuple[int, int, int, int]] = []
    for f in sorted((f for own in lines.values() for f in own), key=lambda f: (f[0], -f[1], f[2])):
        if not out or f[0] + f[1] > out[-1][0] + out[-1][1]:
            out.append(tuple(f))
    return out


def kept_words(text: str | None, spans: list[dict] | None) -> tuple[int, list[bytes]]:
    """The number of all words, and the words that stay."""
    found = H.words(text)
    if not spans:
        return len(found), found
    gone = np.zeros(len(found) + 1, np.int64)
    for start, size, *_ in factors(spans):
        gone[start] += 1
        gone[start + size] -= 1
    return len(found), [found[k] for k in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()]


def _with_spans(rows: DataFrame, window: int) -> DataFrame:
    """rows, which have doc_id (long) and text (string) besides columns of other names than th and spans, with th and spans."""
    # Factors grow with the text, so this is a shuffle at any size, too.
    return rows.withColumn("th", F.xxhash64("text")).join(matches(rows, window).hint("merge"), ["doc_id", "th"], "left")


def duplicate_factors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, start, size, ref_doc_id, ref_start: one row for each factor, in words."""

    def run(batches):
        for batch in batches:
            rows = [(k, *f) for k, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for f in factors(own)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)], names=["doc_id", "start", "size", "ref_doc_id", "ref_start"])

    return matches(docs, window).select("doc_id", "spans").mapInArrow(run, "doc_id long, start long, size long, ref_doc_id long, ref_start long")


def summary(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""

    def run(batches):
        for batch in batches:
            n, gone, sha = [], [], []
            for text, own in zip(batch.column(1), batch.column(2), strict=True):
                total, kept = kept_words(text.as_py(), own.as_py())
                n.append(total)
                gone.append(total - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = _with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), window)
    return rows.select("doc_id", "text", "spans").mapInArrow(freed(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the duplicate spans cut from text (words joined by one blank); rows that lose nothing keep their text as it is, rows that lose every word go.

    Other columns stay, but n_chars, if there, becomes the length of the new text."""
    names, kinds = docs.columns, [t for _, t in docs.dtypes]
    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))
    own_id, own_text = f"c{names.index('doc_id')}", f"c{names.index('text')}"
    rest = [f"c{k}" for k, c in enumerate(names) if c not in ("text", "n_chars")]

    def run(batches):
        for batch in batches:
            texts, stays = [], []
            for text, own in zip(batch.column("text"), batch.column("spans"), strict=True):
                if not own.is_valid:
                    texts.append(text.as_py())
                    stays.append(True)
                else:
                    _, kept = kept_words(text.as_py(), own.as_py())
                    texts.append(b" ".join(kept).decode())
                    stays.append(bool(kept))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(texts, pa.string())], names=[*rest, own_text]).filter(pa.array(stays, pa.bool_()))

    rows = _with_spans(plain.select(*rest, F.col(own_id).cast("long").alias("doc_id"), F.col(own_text).cast("string").alias("text")), window)
    schema = ", ".join(f"{c} {kinds[int(c[1:])]}" for c in rest) + f", {own_text} string"
    cut = rows.select(*rest, "text", "spans").mapInArrow(freed(run), schema)
    if "n_chars" in names:
        at = names.index("n_chars")
        cut = cut.withColumn(f"c{at}", F.char_length(own_text).cast(kinds[at]))
    return cut.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(names)))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(table(spark, sf_dir, "documents"))


QUERIES = {"op10_substring_dedup": op10_substring_dedup}
ORACLES = {
    "op10_substring_dedup": r"""
WITH w AS (
    SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), k AS (
    SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50
), h AS (
    SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS g FROM k
), f AS (
    SELECT g, min(doc_id) AS first FROM h GROUP BY g
), gone AS (
    SELECT DISTINCT doc_id, i + j AS p FROM h JOIN f USING (g), (SELECT unnest(range(50)) AS j) WHERE first < doc_id
), words AS (
    SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w
), kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS c FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(c, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
}
