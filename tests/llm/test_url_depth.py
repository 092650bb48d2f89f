from loomgraph.llm import url_filter as U


def test_paths_differ_at_any_depth(spark):
    deep = "/".join("abcdefghijkl")
    rows = [(f"http://h/{deep}/{kind}/{k}", kind == "spam" if k < 20 else None) for kind in ("news", "spam") for k in range(30)]
    df = spark.createDataFrame([(k, u, b) for k, (u, b) in enumerate(rows)], "page_id long, url string, b boolean")
    got = {r.path: r for r in U.judge(df, rules=[], label_col="b").collect()}
    assert len(got) == 60
    for path, r in got.items():
        assert r.verdict == ("block" if "spam" in path else "allow")
        assert r.template == path.rsplit("/", 1)[0] + "/*"
