import base64
import hashlib

import duckdb
import pytest

from loomgraph.llm import warc_store as A
from loomgraph.llm.common import new_path

PAGES = [(3, "http://a/\r\nx", "<p>é</p>"), (1, None, None), (2, "http://b", ""), (9, "http://c", "<p>é</p>"), (3, "http://a/\r\nx", "<p>é</p>"), (None, "u", "only"), (None, None, "<p>é</p>"), (7, "WARC", "x\r\n\r\nWARC/1.1\r\n" * 500)]


def brute(pages, least=0):
    out, seen = [], {}
    for k, (page, url, html) in sorted(enumerate(pages), key=lambda x: (x[1][0] is None, x[1][0] or 0, x[1][1] is None, x[1][1] or "", x[0])):
        raw = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        if raw in seen and len(raw) >= least:
            out.append((page, len(raw), digest, "revisit", seen[raw]))
        else:
            seen[raw] = page
            out.append((page, len(raw), digest, "response", None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    path = new_path(spark, "warc")
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, key string").coalesce(1)
    A.write_archive(df, path, least)
    got = A.read_archive(spark, path).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(PAGES, least)
    assert sorted(r.payload for r in got) == sorted((h or "").encode() for _, _, h in PAGES)
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, _, h in PAGES})
    parsed = list(A.parse(b"".join(r.record for r in got)))
    ids = {n["WARC-Record-ID"]: (n, b) for n, b in parsed}
    assert len(ids) == len(PAGES)
    for (named, block), r in zip(parsed, got, strict=True):
        if r.record_type == "response":
            assert block.endswith(r.payload)
        else:
            assert ids[named["WARC-Refers-To"]][1].endswith(r.payload) and ids[named["WARC-Refers-To"]][0]["WARC-Type"] == "response"


def test_a_changed_payload_is_found(spark):
    path = new_path(spark, "warc")
    A.write_archive(spark.createDataFrame(PAGES, "page_id long, url string, html string"), path)
    spark.read.parquet(f"{path}/payloads").selectExpr("key", "cast(concat(cast(payload as string), 'x') as binary) payload").write.parquet(f"{path}/other/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{path}/other/headers")
    with pytest.raises(Exception, match="doesn't have its digest"):
        A.read_archive(spark, f"{path}/other").collect()


def test_empty_and_query(spark):
    path = new_path(spark, "warc")
    A.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert A.read_archive(spark, path).count() == 0
    d = "/root/testdata/sf0.001"
    pages = [tuple(r) for r in spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, A.op4_warc_store(spark, d).collect()), key=str) == brute(pages)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_against_sql(spark, sf):
    d = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{d}/pages.parquet'")
    found, sql = A.op4_warc_store(spark, d), con.execute(A.ORACLES["op4_warc_store"])
    assert [x[0] for x in sql.description] == found.columns
    assert sorted(map(tuple, found.collect()), key=str) == sorted(sql.fetchall(), key=str)
