import random
import re

from loomgraph.llm import license_scan as L

P = re._parser


def sample(parsed, choose):
    """A random string that the expression matches."""
    out = ""
    for op, x in parsed:
        name = str(op)
        if name == "LITERAL":
            out += chr(x)
        elif name == "NOT_LITERAL":
            out += "x"
        elif name == "IN":
            first = choose.choice(x)
            out += chr(first[1]) if str(first[0]) == "LITERAL" else chr(first[1][0])
        elif name == "BRANCH":
            out += sample(choose.choice(x[1]), choose)
        elif name == "SUBPATTERN":
            out += sample(x[3], choose)
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            out += "".join(sample(x[2], choose) for _ in range(choose.randint(x[0], min(x[1], x[0] + 2))))
    return out


def test_every_match_holds_its_keyword():
    choose = random.Random(0)
    for label, regex, words, *_ in L.rules():
        inner = P.parse(regex.removeprefix("(?<= )").removesuffix("(?= )"))
        for _ in range(40):
            s = f" {sample(inner, choose)} "
            assert re.search(regex, s), (label, regex, s)
            assert all(any(f" {w}" in s for w in group.split("|")) for group in words), (label, regex, words, s)


TEXTS = ["Released under the MIT.", "distributed under the EUPL", "this work is subject to the terms of ISC", "available under zlib; governed by the ODbL", "offered under the terms and conditions of the MPL"]


def test_forms_without_the_word_license(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = sorted(map(tuple, L.summary(docs).collect()))
    assert [r[6] for r in got] == ["mit", "eupl", "isc", "odbl,zlib", "mpl"]
    ungated = tuple((*r[:2], ("",), *r[3:]) for r in L.rules())
    monkeypatch.setattr(L, "rules", lambda: ungated)
    assert sorted(map(tuple, L.summary(docs).collect())) == got
