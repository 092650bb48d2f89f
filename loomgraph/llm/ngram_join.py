"""N-gram Jaccard join with adaptive multi-match prefixes, and the connected components of its links.

Sets. A document's set holds the 64-bit hashes of its distinct 5-word shingles; equal sets are one node (64 bits of their
128-bit digest), so copies cost one row each and are never paired.

Order. Any order of the shingles that all documents share gives right results; frequent ones go last. Their counts come
from all documents: each task counts its shingles and reports those it has seen twice or more, the reports are summed, and
the KEPT_FREQUENT most frequent are handed to all tasks (a bound on their number only: what is left out is ordered by hash).

Prefixes. Two sets of sizes n and m that are similar enough share at least l of their first n - ceil(t n) + l and
m - ceil(t m) + l shingles. Every set starts with l = 1. Its cost is estimated by the number of other rows that its prefix
meets; l grows with the logarithm of the cost, and the prefix with l. Of a pair, the prefix that ends first in the order has all
common shingles up to there; so a pair is verified if the shingles that its prefixes share, and all that the longer rest
could add, reach the overlap that sets of these sizes need. That is min(l, l') shared shingles, and more where sizes are near.

Links. In large groups of near copies, all pairs of a shingle's nodes would be too many. So each node is first verified
against one head: in the list of each shingle that is the node whose prefix meets most, which in a group of near copies is
what they were copied from, and of these heads the one that it shares most with. Linked nodes are one component, and shingles whose nodes are all of one component can't add a link between components. Of the other shingles,
all pairs of nodes from different components that can have their first common shingle there are counted and verified as
above, so no link that matters is lost.

Defined cases: null or empty texts, and texts of blanks only, have the empty set and are linked with nothing, not even with
each other. Rows with a null doc_id get the size of their set and component_id null, and are linked with nothing. Rows that
share a doc_id count as one document in components; each shows the size of its own set. Repeated rows stay. Columns that
aren't named are ignored, or passed on unchanged by keep_one(). An empty table gives no rows.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomgraph.llm import wordhash as H
from loomgraph.llm.common import dropped, freed, table, unused, written
from loomgraph.llm.components import components

WORDS = 5
PERCENT = 75
#: The longest prefix asks for so many shared shingles.
MOST = 8
#: A prefix that meets so many rows is lengthened by one, and by one more whenever that doubles.
COST = 64
KEPT_FREQUENT = 1 << 18
#: A table of ids (16 bytes a row) is broadcast up to so many rows.
BROADCAST_ROWS = 1_000_000
#: Shingles that a task collects before it counts them, and texts whose sets are held at once.
WAITING = 1 << 20
ROWS = 256
#: Nodes that a task remembers.
DONE = 1 << 18
#: Pairs of one node that a task compares.
GROUP = 256


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct hashes of the shingles; of a shorter text, the whole sequence as one."""
    h = H.hashed((text or "").encode().lower())  # bytes: A-Z only
    if not len(h):
        return h
    every = np.sort(H.ngrams(h, min(n, len(h))))
    return every[np.concatenate([[True], every[1:] != every[:-1]])]


def node_of(found: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_128_intdigest(found.tobytes()) & 0xFFFFFFFFFFFFFFFF)))


def least_shared(size: int, percent: int) -> int:
    """What a set of this size shares with any set that is similar enough."""
    return -(-percent * size // 100)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def survey(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """One pass over all texts. doc_id, n_shingles, node of every row (node null where the set is empty; token null); token, seen of shingles that a task has seen twice or more."""

    def run(batches):
        names = ["doc_id", "n_shingles", "node", "token", "seen"]
        kinds = [pa.int64()] * 5
        parts: list[np.ndarray] = []
        tokens, counts, waiting = np.empty(0, np.uint64), np.empty(0, np.int64), 0

        def merged():
            new, one = np.unique(np.concatenate(parts), return_counts=True)
            new, one = np.concatenate([tokens, new]), np.concatenate([counts, one])
            order = np.argsort(new, kind="stable")
            new, one = new[order], one[order]
            first = np.flatnonzero(np.concatenate([[True], new[1:] != new[:-1]]))
            total = np.add.reduceat(one, first)
            return new[first][total > 1], total[total > 1]  # what has been seen once goes

        def reported():
            none = pa.nulls(len(tokens), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, pa.array(tokens.view(np.int64)), pa.array(counts)], names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = []
                part = batch.slice(at, ROWS)
                for doc_id, t in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    s = shingles(t.as_py(), n)
                    rows.append((doc_id, len(s), node_of(s) if len(s) else None, None, None))
                    parts.append(s)
                    waiting += len(s)
                    if waiting > WAITING:
                        tokens, counts = merged()
                        parts, waiting = [], 0
                        if len(tokens) > WAITING // 2:  # summed up by the tables
                            yield reported()
                            tokens, counts = tokens[:0], counts[:0]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        if parts:
            tokens, counts = merged()
        yield reported()

    return _texts(docs).mapInArrow(freed(run), "doc_id long, n_shingles long, node long, token long, seen long")


def frequent(surveyed: DataFrame, kept: int = KEPT_FREQUENT) -> DataFrame:
    """token, seen: the most frequent shingles of all documents."""
    return surveyed.where("token is not null").groupBy("token").agg(F.sum("seen").alias("seen")).where("seen >= 4").orderBy(F.desc("seen"), "token").limit(kept)


def prefixes(docs: DataFrame, last: "tuple[np.ndarray, np.ndarray]", n: int = WORDS, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """token, node, place: the first shingles of each set, as far as the longest prefix goes; place holds the set's size times 2^32 and the shingle's place in the order. A task gives each of the last DONE nodes once."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(last)

    def run(batches):
        tokens, seen = shared.value
        done: set[int] = set()
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                found, nodes, places = [], [], []
                for t in batch.column(0).slice(begin, ROWS):
                    s = shingles(t.as_py(), n)
                    node = node_of(s)
                    if not len(s) or node in done:
                        continue
                    if len(done) >= DONE:
                        done.clear()
                    done.add(node)
                    at = np.minimum(np.searchsorted(tokens, s), max(len(tokens) - 1, 0))
                    weight = np.where(tokens[at] == s, seen[at], 0) if len(tokens) else np.zeros(len(s), np.int64)
                    first = s[np.lexsort((s, weight))][: len(s) - least_shared(len(s), percent) + most]
                    found.append(first)
                    nodes.append(np.full(len(first), node, np.int64))
                    places.append((len(s) << 32) + np.arange(len(first)))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(places))], names=["token", "node", "place"])

    return _texts(docs).where("doc_id is not null").select("text").mapInArrow(freed(run), "token long, node long, place long")


def _sent(rows: DataFrame) -> DataFrame:
    """rows (a written table), to be broadcast where they are few enough; else joins shuffle both sides."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _size(name: str) -> F.Column:
    return F.shiftright(F.col(name), 32)


def _near(x: str, y: str, percent: int) -> F.Column:
    """Sets of these sizes can be similar enough."""
    return (F.least(x, y) * 100) >= (F.greatest(x, y) * percent)


def verified(pairs: DataFrame, texts: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Of pairs (a, b), those whose sets are similar enough. texts: node, text; a node's text may come more than once.

    Each text is shuffled once as an a and once as a b: the pairs of one b go to one task, or to several, each with b's text,
    where they are more than GROUP."""
    many = written(pairs.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > GROUP), "many")
    part = F.coalesce(F.pmod(F.xxhash64("a"), F.ceil(F.col("n") / GROUP)), F.lit(0)).cast("long")
    dealt = written(pairs.join(_sent(many), "b", "left").select("a", "b", part.alias("part")), "dealt")
    left = texts.join(_sent(dealt), F.col("node") == F.col("a")).select("b", "part", "a", "text")
    right = texts.join(_sent(written(dealt.select("b", "part").distinct(), "heads")), F.col("node") == F.col("b")).select("b", "part", F.lit(None).cast("long").alias("a"), "text")

    def run(batches):
        now, head = None, None
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                found: list[tuple[int, int]] = []
                rows = batch.slice(begin, ROWS)
                for b, part, a, text in zip(*(rows.column(k).to_pylist() for k in range(3)), rows.column(3), strict=True):
                    own = shingles(text.as_py(), n)
                    if a is None:
                        now, head = (b, part), own
                    elif now == (b, part):
                        both = len(np.intersect1d(own, head, assume_unique=True))
                        if 100 * both >= percent * (len(own) + len(head) - both):
                            found.append((a, b))
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    # in a partition, b's own text comes before the texts that are compared with it
    rows = left.unionByName(right).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())
    return rows.mapInArrow(freed(run), "a long, b long")


def node_links(docs: DataFrame, surveyed: DataFrame, n: int = WORDS, percent: int = PERCENT, most: int = MOST, cost: int = COST) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between nodes, enough of them for all components, and these components (node, label). surveyed: rows of survey(), computed once."""
    found = surveyed.where("token is null")
    top = frequent(surveyed).toPandas()  # bounded by KEPT_FREQUENT
    tokens = top["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    first = prefixes(docs, (tokens[order], top["seen"].to_numpy(np.int64)[order]), n, percent, most)

    # One shuffle: a token's rows meet in one task, where a node that several tasks have given becomes one row, and shingles
    # of one node only, which meet nothing, go. A token has at most one row for each node, a small part of all rows.
    each = first.repartition("token").dropDuplicates(["token", "node"]).withColumn("met", F.count("*").over(W.partitionBy("token"))).where("met > 1")
    met_rows = written(each.select("token", "node", "met", _size("place").alias("size"), F.col("place").bitwiseAND(0xFFFFFFFF).alias("at")), "postings")

    # l, by the rows that the prefix for l = 1 meets.
    needed = -F.floor(-F.col("size") * percent / 100)
    met = met_rows.groupBy("node", "size").agg(F.sum(F.when(F.col("at") <= F.col("size") - needed, F.col("met") - 1).otherwise(0)).alias("cost"))
    level = F.when(F.col("cost") < cost, 1).otherwise(F.floor(F.log2(F.col("cost") / cost)) + 2)
    levels = written(met.select("node", "cost", F.greatest(F.lit(1), F.least(level, F.lit(most), needed)).cast("long").alias("l")), "levels")
    prefix = met_rows.drop("met").join(_sent(levels), "node").where(F.col("at") < F.col("size") - needed + F.col("l"))

    # Round one: of each list, the node whose prefix meets most (in a group of near copies, what they are copies of).
    head = F.max(F.struct("cost", "node")).over(W.partitionBy("token"))["node"]
    live = written(prefix.select("token", "node", "size", "at", (needed - F.col("l")).cast("long").alias("left"), head.alias("head")), "postings")
    dropped(met_rows, levels)
    stars = live.where("node <> head").groupBy("node", "head").agg(F.count("*").alias("both"))
    best = W.partitionBy("node").orderBy(F.desc("both"), "head")
    stars = stars.withColumn("nth", F.row_number().over(best)).where("nth = 1").select(F.col("node").alias("a"), F.col("head").alias("b"))
    stars = written(stars, "pairs")

    # The texts of all nodes that meet another one.
    chosen = found.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(live.select("node").distinct(), "node", "left_semi")
    chosen = _sent(written(chosen, "chosen"))

    def right(batches):
        for batch in batches:  # rows that share an id may have other texts
            mine = [node_of(s) == k if len(s := shingles(t.as_py(), n)) else False for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            yield batch.filter(pa.array(mine, pa.bool_()))

    texts = written(_texts(docs).join(chosen, "doc_id").select("node", "text").mapInArrow(freed(right), "node long, text string"), "texts")
    links = written(verified(stars, texts, n, percent), "links")
    one = components(links)

    # Round two: shingles whose nodes aren't all of one component.
    labelled = live.select("token", "node", "size", "at", "left").join(one, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = labelled.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("token")
    rest = written(labelled.join(mixed, "token", "left_semi"), "postings")
    # A pair's first common shingle leaves room for its overlap behind it in both sets; in the shorter one (b) that is near the start.
    overlap = lambda sizes: -F.floor(-sizes * percent / (100 + percent))
    side = lambda x: rest.select("token", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "size", "at", "label")))
    shorter = side("b").where(F.col("size_b") - F.col("at_b") >= overlap(2 * F.col("size_b")))
    ordered = (F.col("size_a") > F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("node_a") < F.col("node_b")))
    room = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b")) >= overlap(F.col("size_a") + F.col("size_b"))
    met_once = side("a").join(shorter, "token").where(ordered & (F.col("label_a") != F.col("label_b")) & _near("size_a", "size_b", percent) & room)
    met_once = met_once.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    # Beyond the prefix that ends first, a set has "left" shingles; so the shared ones before must make up for the rest.
    own = rest.groupBy("node").agg(F.collect_list("token").alias("tokens"), F.first("size").alias("size"), F.first("left").alias("left"))
    of = lambda x: own.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("tokens", "size", "left")))
    asked = overlap(F.col("size_a") + F.col("size_b")) - F.greatest("left_a", "left_b")
    cross = met_once.join(of("a"), "a").join(of("b"), "b").where(F.size(F.array_intersect("tokens_a", "tokens_b")) >= asked).select("a", "b")
    more = written(verified(written(cross, "pairs"), texts, n, percent), "links")
    dropped(stars, rest, live, texts)
    every = links.unionByName(more)
    return every, components(every)


def classes(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, node of every row (the links are between nodes: node_links())."""
    surveyed = written(survey(docs, n), "survey")
    found = surveyed.where("token is null").select("doc_id", "n_shingles", "node")
    _, parts = node_links(docs, surveyed, n, percent)
    named = found.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("first")).join(parts, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "first")
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    ids = _same_document(found, written(named.join(least, "label").select("node", "component_id"), "components"))
    rows = found.join(ids, "node", "left")
    return rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), "node")


def _same_document(found: DataFrame, ids: DataFrame) -> DataFrame:
    """ids (node, component_id), with components joined that have rows of one doc_id, where there are such rows."""
    rows = found.where("doc_id is not null and node is not null").select("doc_id", "node")
    several = rows.groupBy("doc_id").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("doc_id")
    if several.limit(1).count() == 0:
        return ids
    joined = rows.join(several, "doc_id", "left_semi").distinct().join(ids, "node")
    links = joined.groupBy("doc_id").agg(F.min("component_id").alias("least")).join(joined, "doc_id").select(F.col("component_id").alias("a"), F.col("least").alias("b"))
    again = components(links).withColumnsRenamed({"node": "component_id"})
    return ids.join(again, "component_id", "left").select("node", F.coalesce("label", "component_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs without the documents of a component other than that with the smallest doc_id. Rows with null ids or empty sets stay; of repeated rows of one doc_id, all stay."""
    its = unused(docs, "gone")
    gone = written(classes(docs, n, percent).where("doc_id <> component_id").select(F.col("doc_id").alias(its)).distinct(), "gone")
    return docs.join(_sent(gone), F.col("doc_id").cast("long") == F.col(its), "left_anti")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op1_ngram_join": op1_ngram_join}
ORACLES = {
    "op1_ngram_join": r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), k AS (
    SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0
), s AS (
    SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS g FROM k
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
    SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 75 * (x.n + y.n - c)
), e AS (
    SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(doc_id, other) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other
)
SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(other) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""
}
