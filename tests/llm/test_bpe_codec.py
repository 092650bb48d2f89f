import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from loomgraph.llm import bpe_codec as B

RANKS = B.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
TIK = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = ["", " ", "a", " a", "a ", "  a  b", "it's we'll\n\n x\t y", "naïve Straße 日本語 🙂🙂  x   y", "a\u0085b \u0085c", "<|endoftext|> x", "a​b  　 c", "x \r\n y\x1c z \x1f", "1234 12a ½ ²", "é ก็ \U0001f468‍\U0001f469", "x" * 3000, "ab.\nCd, e###\nf\tg\n h.\n\ni \nj k\n", "a b's c'd. e.'s f_g_ h_ é.É", "a \n", "Ab.\n. c", " " * 500 + "y"]


def ids(codec, text):
    return np.frombuffer(codec.encode(text), "<u4").tolist()


@pytest.mark.parametrize("text", ODD)
def test_same_ids_as_ranks(text):
    assert ids(B.codec(), text) == TIK.encode_ordinary(text)
    assert B.codec().decode(B.codec().encode(text)) == text.encode()


def test_random_texts_and_slices(monkeypatch):
    monkeypatch.setattr(B, "SLICE", 7)
    rng = np.random.default_rng(0)
    alphabet = list("ab 'sté1.\n\t 日🙂 ") + [" ", "'ll", "tion"]
    for _ in range(400):
        text = "".join(rng.choice(alphabet, rng.integers(0, 60)))
        assert ids(B.codec(), text) == TIK.encode_ordinary(text), text


def test_json_vocabulary_by_chunks_equals_whole():
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    for text in ODD:
        assert ids(B.codec(path), text) == whole.encode(text, add_special_tokens=False).ids, text


def test_offsets_and_split_characters():
    text = "a 日🙂 b"
    raw = B.codec().encode(text)
    begin, end, first, last = B.codec().spans(text, raw)
    pieces = [B.codec().pieces[k] for k in np.frombuffer(raw, "<u4")]
    assert [text.encode()[a:b] for a, b in zip(begin, end)] == pieces
    assert all(text[a:b].encode().find(p) >= 0 for a, b, p in zip(first, last, pieces))
    assert "".join(B.incremental_text(iter(pieces))) == text


def test_frames(spark):
    rows = [(1, "abc d", 1), (2, None, 2), (None, "x", 3), (1, "abc d", 1), (5, "", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted((tuple(r)[:4] for r in B.round_trip(df).collect()), key=str)  # the contract's columns
    want = []
    for k, t, _ in rows:
        i = TIK.encode_ordinary(t or "")
        want.append((k, len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    enc = B.encode(df.drop("ids"))
    assert {(r.doc_id, r.text) for r in B.decode(enc).collect()} == {(1, "abc d"), (2, ""), (None, "x"), (5, "")}
    assert B.round_trip(df.limit(0)).count() == 0


def test_another_pattern_goes_without_chunks():
    pattern = r"[a-z]+ ?|."
    own = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=RANKS, special_tokens={})
    for text in ["ab cd", "a b  c1d", "it is so"]:
        assert ids(B.codec(None, pattern), text) == own.encode_ordinary(text)


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    odd = {-1 - k: t for k, t in enumerate(ODD)}
    rows = spark.createDataFrame([*odd.items(), (-99, None)], "doc_id long, text string")
    got = B.op5_byte_bpe(spark, d).collect() + B.round_trip(rows).collect()
    docs |= odd | {-99: ""}
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        text = docs[r.doc_id]
        found = TIK.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256) == (len(found), hashlib.sha256(np.array(found, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        begins, at = [], 0
        chars = [k for k, c in enumerate(text) for _ in c.encode()]
        for t in found:
            begins.append((at, at := at + len(TIK.decode_single_token_bytes(t))))
        spans = [(chars[a], chars[b - 1] + 1) for a, b in begins]
        want = hashlib.sha256(np.array(begins, "<i8").tobytes() + np.array(spans, "<i8").tobytes()).hexdigest()
        assert r.offsets_sha256 == want and r.n_split == sum(a > 0 and chars[a] == chars[a - 1] for a, _ in begins)
