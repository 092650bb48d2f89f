import duckdb
import pytest

from loomgraph.llm import url_filter as U


def parsed(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = rest[:n], rest[n:]
    m = min((rest.index(c) for c in "?#" if c in rest), default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:m]


def ruled(host, path, rules=U.RULES):
    fit = [(len(t), t, v) for v, t in rules if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith("/" + t.split("/", 1)[1])]
    return max(fit)[1:] if fit else (None, None)


URLS = [
    None, "", "no scheme", "http://", "http://NET/x", "https://a.Example.NET/en/1", "http://example.net/en", "http://example.net/en/", "http://xnet/a", "http://x.net", "http://x.net?q", "http://x.net#f", "http://www.example.com/de/1?x#y",
    "http://example.com/en/ab/cd", "ftp://u@h.ORG:80/fr/a/b/c/d/e/f/g/h", "http://É.org/fr/é//x", "a://b://c/d", "http://example.com/de\n/x", "http://org/fr/39.html", "http://other.io/de/12.html", "http://other.io/en/12.html",
]


def test_parse_and_rules(spark):
    rows = [(k, u) for k, u in enumerate(URLS)] + [(None, URLS[4]), (4, URLS[4])]
    df = spark.createDataFrame([(k, u, "x", 1) for k, u in rows], "page_id long, url string, host string, bad int")
    got = U.judge(df).collect()
    want = sorted(((k, *parsed(u), ruled(*parsed(u))[0]) for k, u in rows), key=str)
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in got), key=str) == want
    assert all(r.verdict == (ruled(r.host, r.path)[1] or r.verdict) and r.verdict in ("allow", "block") for r in got)
    by = {(r.host, r.path): r.verdict for r in got}
    assert by["other.io", "/de/12.html"] == "block"
    assert U.judge(df.limit(0)).count() == 0


def test_templates_and_purity(spark):
    urls = [f"http://h/{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}x/p{k}.html" for k in range(100)]
    good = [f"http://h/news/{k}" for k in range(30)]
    bad = [f"http://h/spam/{k}" for k in range(30)]
    rows = [(u, None) for u in urls] + [(u, False if k < 20 else None) for k, u in enumerate(good)] + [(u, True if k < 20 else None) for k, u in enumerate(bad)]
    df = spark.createDataFrame([(k, u, b) for k, (u, b) in enumerate(rows)], "page_id long, url string, b boolean")
    got = {r.path: r for r in U.judge(df, rules=[], label_col="b").collect()}
    assert got["/news/25"].verdict == "allow" and got["/spam/25"].verdict == "block"
    assert got["/akx/p0.html"].template == "/*/*.html"
    none = U.judge(df, rules=[]).collect()
    assert {r.verdict for r in none} == {"allow"}


def test_branches_merge_at_inner_levels(spark, monkeypatch):
    rows = [(f"http://h/shop/{lang}/{k}", lang == "spam") for lang in ("en", "de", "fr", "spam") for k in range(20)] + [(f"http://h/shop/new/{k}", None) for k in range(5)]
    df = spark.createDataFrame([(k, u, b) for k, (u, b) in enumerate(rows)], "page_id long, url string, b boolean")
    for limit in (U.BROADCAST_ROWS, 0):
        monkeypatch.setattr(U, "BROADCAST_ROWS", limit)
        got = {r.path.rsplit("/", 1)[0]: (r.template, r.verdict) for r in U.judge(df, rules=[], label_col="b").collect()}
        assert got["/shop/spam"] == ("/shop/spam/*", "block") and got["/shop/new"] == ("/shop/new/*", "allow")
        assert all(got[f"/shop/{x}"][1] == "allow" for x in ("en", "de", "fr"))
    # a tree whose branches are alike is one template
    df = df.where("b is not null and not b")
    assert {r.template for r in U.judge(df, rules=[], label_col="b").collect()} == {"/shop/*/*"}


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query(spark, sf):
    d = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{d}/pages.parquet'")
    found = U.op8_url_filter(spark, d)
    sql = con.execute(U.ORACLES["op8_url_filter"])
    assert [x[0] for x in sql.description] == found.columns
    got = sorted(map(tuple, found.collect()))
    assert got == sorted(sql.fetchall())
    want = sorted((p, *parsed(u), *ruled(*parsed(u))) for p, u in [tuple(r) for r in spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url").collect()])
    assert [r[:4] for r in got] == [w[:4] for w in want]
    assert all(w[4] is None or w[4] == r[4] for r, w in zip(got, want, strict=True))
