"""URL filters: ordered prefix rules first, then a path-template tree with smoothed purity of labelled urls.

Rules name a host and a path prefix and hold for that host and its subdomains; the longest rule that fits wins. A url that
no rule judges goes by its template. Templates: per host, a path is a list of segments; a segment with a digit, or a very
long one, is a wildcard (its extension stays). Below each node of a host's tree, at any depth, literal segments become one
wildcard if they are many and mostly different, except frequent ones, and so does the branch of a segment whose labelled share of blocked
urls, over all urls below it, doesn't differ significantly (Z standard errors) from that of the node's other branches. A
branch without labels, or without labelled siblings, stays, since nothing says what it is like.

Labels are the verdicts of the rules, or a column of the caller's. A template's purity is its labelled share of blocked
urls, smoothed by WEIGHT urls with the share of the same template on all hosts, and that by WEIGHT urls with the overall
share. At a purity of THRESHOLD or more a url is blocked.

Defined cases: a url that is null or has no "://" has empty host and path; the host ends at the first "/", "?" or "#", the
path at "?" or "#". Only A-Z of hosts are lower-cased. Paths are of any depth.
Without any label, nothing but the rules blocks. Null and repeated page_ids are rows like others. Columns that aren't named
are ignored. Very long urls are worked on whole. Only counts per host and path are shuffled before the verdicts are joined back, so a host
that holds a third of all urls is summed up by each task first; the verdicts are broadcast up to BROADCAST_ROWS paths, and beyond
that come from a table of their own, so that a path with very many urls can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import table, written

# Fixed values of the contract: verdict, rule.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A node's literals are a wildcard if there are so many different ones, as many as such a share of its urls; but one that
#: has a share of 1 / MANY by itself stays.
MANY, SHARE = 20, 0.3
WEIGHT = 4.0
Z = 2.0
BROADCAST_ROWS = 200_000
THRESHOLD = 0.5


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, else null."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def segments_of(path: Column) -> Column:
    """The path's segments with the variable ones as wildcards."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.rlike("[0-9]") | (F.length(s) >= 24), F.concat(F.lit("*"), F.regexp_extract(s, r"\.[A-Za-z]{1,5}$", 0))).otherwise(s))


def _text(segments: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(segments, "/"))


def template_tree(urls: DataFrame) -> DataFrame:
    """urls: host, raw (segments), bad (1, 0 or null). Gives host, raw, template, purity: one row for each host and raw path."""
    counts = written(urls.groupBy("host", "raw").agg(F.count("*").alias("n"), F.count("bad").alias("known"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")), "paths")

    # All branches of all nodes, each with what is below it, and the sums over each node's branches.
    levels = counts.select("host", "raw", "n", "known", "bad", F.posexplode("raw").alias("level", "segment")).withColumn("parent", _text(F.slice("raw", 1, F.col("level"))))
    node = ["host", "parent", "level"]
    each = written(levels.groupBy(*node, "segment").agg(*(F.sum(c).alias(c) for c in ("n", "known", "bad"))), "branches")
    literal = ~F.col("segment").startswith("*")
    nodes = each.groupBy(*node).agg(F.count(F.when(literal, 1)).alias("different"), F.coalesce(F.sum(F.when(literal, F.col("n"))), F.lit(0)).alias("total"), F.sum("known").alias("all_known"), F.sum("bad").alias("all_bad"))
    rare = (F.col("different") >= MANY) & (F.col("different") >= F.col("total") * SHARE) & (F.col("n") * MANY < F.col("total"))
    rest, pooled = F.col("all_known") - F.col("known"), F.col("all_bad") / F.col("all_known")
    gap = F.abs(F.col("bad") / F.col("known") - (F.col("all_bad") - F.col("bad")) / rest)
    alike = F.when((F.col("known") > 0) & (rest > 0), gap <= Z * F.sqrt(pooled * (1 - pooled) * (1 / F.col("known") + 1 / rest))).otherwise(F.lit(False))
    merged = written(each.where(literal).join(nodes, node).where(rare | alike).select(*node, "segment", F.lit(True).alias("merged")), "merged")
    general = levels.select("host", "raw", *node[1:], "segment").join(_sent(merged), [*node, "segment"], "left").withColumn("segment", F.when(F.col("merged"), "*").otherwise(F.col("segment")))
    general = general.groupBy("host", "raw").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "segment"))), lambda x: x.segment).alias("segments"))
    paths = counts.join(general, ["host", "raw"], "left").withColumn("template", _text(F.coalesce("segments", F.array().cast("array<string>"))))
    paths = written(paths.select("host", "raw", "template", "known", "bad"), "templates")

    sums = lambda *keys: paths.groupBy(*keys).agg(F.sum("known").alias("known"), F.sum("bad").alias("bad"))
    total = paths.agg(F.sum("known").alias("known"), F.sum("bad").alias("bad")).first()
    overall = (total["bad"] or 0) / total["known"] if total["known"] else 0.0
    everywhere = sums("template").select("template", ((F.col("bad") + WEIGHT * overall) / (F.col("known") + WEIGHT)).alias("prior"))
    judged = sums("host", "template").join(everywhere, "template").select("host", "template", ((F.col("bad") + WEIGHT * F.col("prior")) / (F.col("known") + WEIGHT)).alias("purity"))
    return written(paths.select("host", "raw", "template").join(judged, ["host", "template"]).select("host", "raw", "template", "purity"), "tree")


def _sent(rows: DataFrame) -> DataFrame:
    """rows (a written table), to be broadcast where they are few enough."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, label_col: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every row. label_col (boolean: to be blocked) replaces the rules' verdicts as labels."""
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), *([F.col(label_col).cast("int").alias("bad")] if label_col else []))
    rule, verdict = fitting(rules, F.col("host"), F.col("path"))
    rows = rows.withColumns({"rule": rule, "ruled": verdict, "raw": segments_of(F.col("path"))})
    if not label_col:
        rows = rows.withColumn("bad", F.when(F.col("ruled").isNotNull(), (F.col("ruled") == "block").cast("int")))
    tree = template_tree(rows.select("host", "raw", "bad"))
    out = rows.join(_sent(tree), ["host", "raw"])
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("purity") >= threshold, "block").otherwise("allow")).alias("verdict"), "template", F.round("purity", 9).alias("purity"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


QUERIES = {"op8_url_filter": op8_url_filter}
ORACLES = {
    "op8_url_filter": rf"""
WITH u AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), h AS (
    SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u
), j AS (
    SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
        list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') OR len(x) >= 24 THEN concat('*', regexp_extract(x, '\.[A-Za-z]{{1,5}}$')) ELSE x END) AS raw
    FROM h
), r AS (
    SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 1 WHEN rule IS NOT NULL THEN 0 END AS bad FROM j
), c AS (
    SELECT host, raw, count(*) AS n, count(bad) AS known, coalesce(sum(bad), 0) AS bad FROM r GROUP BY 1, 2
), l AS (
    SELECT host, raw, n, known, bad, unnest(range(len(raw))) AS level, unnest(raw) AS segment FROM c
), b AS (
    SELECT host, raw[1:level] AS parent, segment, sum(n) AS n, sum(known) AS known, sum(bad) AS bad FROM l GROUP BY 1, 2, 3
), d AS (
    SELECT host, parent, count(*) FILTER (NOT starts_with(segment, '*')) AS different, coalesce(sum(n) FILTER (NOT starts_with(segment, '*')), 0) AS total, sum(known) AS ak, sum(bad) AS ab FROM b GROUP BY 1, 2
), m AS (
    SELECT host, parent, segment FROM b JOIN d USING (host, parent) WHERE NOT starts_with(segment, '*') AND (
        (different >= {MANY} AND different >= total * {SHARE} AND n * {MANY} < total)
        OR (known > 0 AND ak > known AND abs(bad / known - (ab - bad) / (ak - known)) <= {Z} * sqrt((ab / ak) * (1 - ab / ak) * (1 / known + 1 / (ak - known)))))
), g AS (
    SELECT l.host, l.raw, list(CASE WHEN m.segment IS NULL THEN l.segment ELSE '*' END ORDER BY level) AS segments
    FROM l LEFT JOIN m ON m.host = l.host AND m.parent = l.raw[1:level] AND m.segment = l.segment GROUP BY 1, 2
), t AS (
    SELECT c.host, c.raw, known, bad, concat('/', coalesce(array_to_string(segments, '/'), '')) AS template FROM c LEFT JOIN g ON g.host = c.host AND g.raw = c.raw
), o AS (
    SELECT CASE WHEN sum(known) > 0 THEN sum(bad) / sum(known) ELSE 0 END AS overall FROM t
), e AS (
    SELECT template, (sum(bad) + {WEIGHT} * any_value(overall)) / (sum(known) + {WEIGHT}) AS prior FROM t, o GROUP BY 1
), p AS (
    SELECT t.host, t.template, (sum(bad) + {WEIGHT} * any_value(prior)) / (sum(known) + {WEIGHT}) AS purity FROM t JOIN e USING (template) GROUP BY 1, 2
)
SELECT page_id, r.host, path, rule, CASE WHEN r.bad = 1 THEN 'block' WHEN r.bad = 0 THEN 'allow' WHEN purity >= {THRESHOLD} THEN 'block' ELSE 'allow' END AS verdict, t.template, round(CAST(purity AS DOUBLE), 9) AS purity
FROM r JOIN t ON t.host = r.host AND t.raw = r.raw JOIN p ON p.host = t.host AND p.template = t.template
"""
}
