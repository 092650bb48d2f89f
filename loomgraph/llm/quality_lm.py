"""Quality classifier: an interpolated modified Kneser-Ney model of character n-grams, trained on trusted text.

Symbols. Every code point is a symbol of its own, whatever its script; white space before a word that repeats the one before
it is one more. An n-gram is its context (the symbols before, BITS bits each, exact) and its last symbol.

Training. Trusted documents (labels: quality 1 and never 0) are counted, but for one in HELD, by a hash of the id, which is
held out. Each task sends sums of its n-grams; counts of all orders, their contexts' sums and the lower orders' continuation
counts are tables that grow with the text, spread by hash. Discounts come from the counts of counts of each order.

Scoring. The probabilities of all n-grams of the corpus, seen in trusted text or not, come from joins with these tables on
n-gram, context and suffix, a level at a time. Every document's distinct n-grams, with their numbers, are joined to that
table and summed up by document. A document's figure is the mean negative log probability of its symbols; perplexity is its
exponential.

Thresholds. Per language, the QUANTILE of the figure over held-out trusted documents, which the model hasn't seen, times
MARGIN; languages with fewer than FEWEST of them, and null ones, use that over all held-out documents. A document is rejected
if its figure, less ERRORS standard errors (short texts vary), is above the threshold.

Defined cases: a null or empty text has no perplexity and is kept, since there is nothing against it. Without any held-out
document everything is kept. Null and repeated ids are rows like others; ids in labels that are null count for nothing, and
conflicting labels mean not trusted. Texts of any length are worked through in slices. Extra columns stay in
filter_documents(), whatever their names; texts aren't shuffled, but for the rejection of more than BROADCAST_ROWS documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import wordhash as H
from loomgraph.llm.common import dropped, freed, table, unused, written

ORDER = 4
#: Bits of a code point's symbol, the symbol of a repeated word, and the number of symbols (0 is what stands before a text).
BITS, AGAIN = 21, 0x110001
ALPHABET = AGAIN + 1
QUANTILE = 0.995
MARGIN = 1.05
ERRORS = 1.0
FEWEST = 30
#: One trusted document in so many is held out of training, for the thresholds (0: none is, and all of them set thresholds).
HELD = 5
#: A table of ids or n-grams is broadcast up to so many rows (8 and 20 bytes a row); beyond that both sides are shuffled.
BROADCAST_ROWS = 1_000_000
#: Characters that are looked up at once (more only where a word is longer).
SLICE = 1 << 20
#: N-grams of documents that are held at once, before they are counted by document.
WAITING = 1 << 18
BLANK = re.compile(r"[ \t\r\n]")


def symbols(text: str, before: int | None = None) -> tuple[np.ndarray, int | None]:
    """The characters' symbols (code points + 1), and the hash of the last word; before is that of the text so far."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    s = c.astype(np.int64) + 1
    inside = np.zeros(len(s) + 2, np.int8)
    inside[1:-1] = (c != 32) & (c != 9) & (c != 10) & (c != 13)
    edge = np.diff(inside)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(first):
        return s, before
    up, down = H.powers(len(c) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(H.mixed(c.astype(np.uint64) + H.ONE) * up[: len(c)], dtype=np.uint64)])
    word = (sums[last] - sums[first]) * down[first]
    same = np.concatenate([[before is not None and int(word[0]) == before], word[1:] == word[:-1]])
    at = first[same] - 1
    s[at[at >= 0]] = AGAIN
    return s, int(word[-1])


def slices(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > SLICE and (m := BLANK.search(text, at + SLICE)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("trusted")).agg(F.min("quality").alias("lo")).where("lo = 1").select("trusted")


def prepared(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, text, trusted, weight (1 for the documents of training, else 0) and nothing else."""
    ids = written(trusted_ids(labels), "trusted")
    if ids.count() <= BROADCAST_ROWS:  # else both sides are shuffled
        ids = F.broadcast(ids)
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.join(ids, F.col("doc_id").cast("long") == F.col("trusted"), "left")
    held = F.pmod(F.xxhash64("trusted"), F.lit(HELD)) == 0 if HELD else F.lit(False)
    weight = F.when(F.col("trusted").isNotNull() & ~held, 1).otherwise(0)
    return rows.select("doc_id", "lang", "text", F.col("trusted").isNotNull().alias("trusted"), weight.alias("weight"))


def code_grams(text: str, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Context and symbol of the n-grams that end at each character, a slice of the text at a time."""
    ahead, before = np.zeros(order - 1, np.int64), None
    for part in slices(text):
        s, before = symbols(part, before)
        s = np.concatenate([ahead, s])
        context = np.zeros(len(s) - order + 1, np.int64)
        for k in range(order - 1):
            context = context << BITS | s[k : k + len(context)]
        yield context, s[order - 1 :].astype(np.int32)
        ahead = s[len(context) :]


def code_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """context, symbol, n over all texts, n being the sum of the documents' weight."""

    def run(batches):
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by(["context", "symbol"], use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(["context", "symbol", "n"])

        size = 0
        for batch in batches:
            for t, w in zip(batch.column(0), batch.column(1)):
                for context, symbol in code_grams(t.as_py() or "", order):
                    held.append(pa.table({"context": context, "symbol": symbol, "n": np.full(len(symbol), w.as_py(), np.int64)}))
                    size += len(symbol)
                    if size >= SLICE:
                        held = [merged()]
                        size = held[0].num_rows
                        if 2 * size >= SLICE:
                            yield from held[0].to_batches()
                            held, size = [], 0
        if held:
            yield from merged().to_batches()

    rows = docs.select("text", "weight").mapInArrow(freed(run), "context long, symbol int, n long")
    return rows.groupBy("context", "symbol").agg(F.sum("n").alias("n"))


def _suffix(k: int) -> Column:
    """The context of an n-gram's suffix of order k."""
    return F.col("context").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1))


def code_probabilities(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """context, symbol, p of all grams, by those with n above 0."""
    levels, asked = {order: grams.where("n > 0")}, {order: grams.select("context", "symbol")}
    for k in range(order - 1, 0, -1):
        levels[k] = written(levels[k + 1].groupBy(_suffix(k).alias("context"), "symbol").agg(F.count("*").alias("n")), "counts")
        asked[k] = written(asked[k + 1].select(_suffix(k).alias("context"), "symbol").distinct(), "asked")
    out, older = None, []
    for k in range(1, order + 1):
        d1, d2, d3 = discounts(levels[k])
        rows = levels[k].withColumn("off", F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3))
        contexts = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum("off").alias("open"))
        found = asked[k].join(rows, ["context", "symbol"], "left").join(F.broadcast(contexts) if k == 1 else contexts, "context", "left")
        if out is None:
            found = found.withColumn("low", F.lit(1 / ALPHABET))
        else:
            below = out.select(F.col("context").alias("suffix"), "symbol", F.col("p").alias("low"))
            found = found.withColumn("suffix", _suffix(k - 1)).join(below, ["suffix", "symbol"])
        p = F.coalesce((F.col("n") - F.col("off")) / F.col("total"), F.lit(0.0)) + F.coalesce(F.col("open") / F.col("total"), F.lit(1.0)) * F.col("low")
        older.append(out := written(found.select("context", "symbol", p.alias("p")), "level"))
    dropped(*older[:-1], *(x for k in range(1, order) for x in (levels[k], asked[k])))
    return out


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """D1, D2 and D3+ from the numbers of n-grams that were seen once to four times."""
    n1, n2, n3, n4 = counts.agg(*(F.count(F.when(F.col("n") == k, 1)) for k in (1, 2, 3, 4))).first()
    y = n1 / max(n1 + 2 * n2, 1)
    raw = (k - (k + 1) * y * above / max(own, 1) for k, own, above in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))
    return tuple(min(max(d, 0.05), k - 0.01) for k, d in zip((1, 2, 3), raw, strict=True))


def key_of(doc_id: str = "doc_id", lang: str = "lang", text: str = "text") -> Column:
    """What a document's figure is kept by: 128 bits of its id, language and text; null where the text is."""
    own = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (doc_id, lang)]
    return F.unhex(F.md5(F.concat(own[0], F.lit(":"), F.coalesce(F.octet_length(F.col(lang).cast("string")), F.lit(-1)).cast("string"), F.lit(":"), own[1], F.col(text).cast("string"))))


def document_grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """key, context, symbol, n: the distinct n-grams of each text, or of each part of it that is held at once."""

    def run(batches):
        for batch in batches:
            held: list[tuple[int, np.ndarray, np.ndarray]] = []

            def grouped() -> Iterator[pa.RecordBatch]:
                doc = np.repeat([h[0] for h in held], [len(h[1]) for h in held])
                rows = pa.table({"doc": doc, "context": np.concatenate([h[1] for h in held]), "symbol": np.concatenate([h[2] for h in held])})
                rows = rows.group_by(["doc", "context", "symbol"], use_threads=False).aggregate([([], "count_all")])
                keys = batch.column(0).take(rows["doc"].combine_chunks())
                yield from pa.table({"key": keys, "context": rows["context"], "symbol": rows["symbol"], "n": rows["count_all"]}).to_batches()

            size = 0
            for k, t in enumerate(batch.column(1)):
                for context, symbol in code_grams(t.as_py() or "", order):
                    for at in range(0, len(symbol), WAITING):
                        held.append((k, context[at : at + WAITING], symbol[at : at + WAITING]))
                        size += len(held[-1][1])
                        if size >= WAITING:
                            yield from grouped()
                            held, size = [], 0
            if size:
                yield from grouped()

    rows = docs.select(key_of().alias("key"), "text").where("key is not null")
    return rows.mapInArrow(freed(run), "key binary, context long, symbol int, n long")


def figures(docs: DataFrame, probabilities: DataFrame, order: int = ORDER) -> DataFrame:
    """key, figure and variance of the symbols' negative log probabilities; documents with the same key count as one."""
    if probabilities.count() <= BROADCAST_ROWS:
        probabilities = F.broadcast(probabilities)
    x = -F.log("p")
    rows = document_grams(docs, order).join(probabilities, ["context", "symbol"]).select("key", "n", x.alias("x"))
    sums = rows.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("x")).alias("s"), F.sum(F.col("n") * F.col("x") * F.col("x")).alias("q"))
    mean = F.col("s") / F.col("n")
    return sums.select("key", mean.alias("figure"), F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean).alias("variance"))


def thresholds(trusted: DataFrame, quantile: float = QUANTILE) -> tuple[DataFrame, float | None]:
    """trusted: lang, figure. Gives its, threshold of the languages with enough rows, and the threshold over all of them."""
    rows = written(trusted.where("figure is not null").select("lang", "figure"), "figures")
    cut = F.percentile_approx("figure", F.lit(quantile), F.lit(10_000)) * MARGIN
    by = rows.where("lang is not null").groupBy(F.col("lang").alias("its")).agg(cut.alias("threshold"), F.count("*").alias("n")).where(F.col("n") >= FEWEST).drop("n")
    return by, rows.agg(cut).first()[0]


def judged(docs: DataFrame, labels: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, lang, key, figure, error, threshold, keep of every row."""
    rows = prepared(docs, labels)
    grams = written(code_counts(rows, order), "grams")
    probabilities = code_probabilities(grams, order)
    found = written(figures(rows, probabilities, order), "figures")
    dropped(grams, probabilities)
    # Without the texts, so that what is joined and shuffled is small.
    small = rows.select("doc_id", "lang", key_of().alias("key"), F.length("text").alias("size"), (F.col("trusted") & (F.col("weight") == (0 if HELD else 1))).alias("sets"))
    small = written(small.join(found, "key", "left"), "judged")
    dropped(found)
    by, overall = thresholds(small.where("sets").select("lang", "figure"))
    out = small.join(F.broadcast(by), F.col("lang") == F.col("its"), "left")  # one row a language
    out = out.withColumns({"error": F.sqrt(F.col("variance") / F.col("size")), "threshold": F.coalesce("threshold", F.lit(overall).cast("double"))})
    keep = F.coalesce(F.col("figure") - ERRORS * F.col("error") <= F.col("threshold"), F.lit(True))
    return out.select("doc_id", "lang", "key", "figure", "error", "threshold", keep.alias("keep"))


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns."""
    gone = unused(docs, "gone")
    bad = written(judged(docs, labels).where("not keep").select(F.col("key").alias(gone)).distinct(), "gone")
    if bad.count() <= BROADCAST_ROWS:  # else both sides are shuffled
        bad = F.broadcast(bad)
    return docs.join(bad, key_of() == F.col(gone), "left_anti")


def op6_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "lang", F.exp("figure").alias("perplexity"), F.exp("threshold").alias("threshold"), "keep")


QUERIES = {"op6_quality_lm": op6_quality_lm}
ORACLES: dict[str, str] = {}
