import re
import time

from loomgraph.llm import license_scan as L


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    base = []
    for phrase, label in L.BASE:
        p = phrase.split()
        base += [(k, label) for k in range(len(words)) if words[k : k + len(p)] == p]
    s = " " + " ".join(words) + " "
    found = []
    for no, (label, regex, word, priority, confidence, is_base) in enumerate(L.rules()):
        if all(any(f" {w}" in s for w in group.split("|")) for group in word):
            for m in re.finditer(regex, s):
                found.append((s[: m.start()].count(" ") - 1, s[: m.end()].count(" ") - 1, label, priority, confidence, is_base, no))
    stays = []
    for x in found:
        over = [y for y in found if y is not x and y[0] <= x[0] and y[1] >= x[1] and y[3] <= x[3] and ((y[0], -y[1], y[3], y[6]) < (x[0], -x[1], x[3], x[6]))]
        if not over:
            stays.append(x)
    labels = {x[2] for x in stays} | {b[1] for b in base}
    at = [b[0] for b in base]
    return (len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({b[1] for b in base})), ",".join(sorted(labels)), max((x[4] for x in stays), default=0.0))


TEXTS = [
    None, "", "...", "Licensed under CC BY-NC 4.0.\nText", "x CC-BY cc by 4.0, CC  BY", "GNU General Public License v3 or later", "the general public license, version 2", "Copyright (c) 2020 Foo Bar. All Rights Reserved.",
    "MIT License mit Straße", "SPDX-License-Identifier: Apache-2.0", "released under the terms of the Apache License, Version 2.0", "Dedicated to the public domain. CC0 1.0 universal", "all rights reserved all rights reserved", "Kcc by ccby cc byé cc_by CC/BY",
    "İall rights reserved all rightſ reserved", "dual licensed under the GPL v2 or 3-clause BSD license", "permission is hereby granted, free of charge, to any person obtaining a copy",
]


def test_rules_are_hundreds():
    assert len(L.SIGNATURES) > 150 and len(L.rules()) > 500


def check(spark, rows):
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, detections string, words int")
    got = sorted((tuple(r) for r in L.summary(df).collect()), key=str)
    assert got == sorted(((k, *brute(t)) for k, t in rows), key=str)


def test_against_brute_force(spark):
    check(spark, [*enumerate(TEXTS), (None, TEXTS[3]), (3, TEXTS[3]), (99, " ".join(t or "" for t in TEXTS) * 20)])


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = L.op2_license_scan(spark, d)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((k, *brute(t)) for k, t in docs), key=str)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_extra_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "Licensed under CC BY 4.0", 5, 6, 7, 8)], "doc_id long, text string, words int, line int, held int, found int")
    row = L.scan(df).first()
    assert (row.words, row.line, row.held, row.found, row.n_words) == (5, 6, 7, 8, 6) and {d.label for d in row.detections if d.stays} == {"cc-by-4.0"}
    assert L.summary(df.limit(0)).count() == 0


def test_a_megabyte_of_matches(spark):
    n = 100_000
    df = spark.createDataFrame([(1, "CC-BY mit license. " * n)], "doc_id long, text string")
    began = time.time()
    r = L.summary(df).first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word) == (4 * n, n, 0, 4 * n - 4) and r.labels == "cc-by,mit"
    assert time.time() - began < 120
