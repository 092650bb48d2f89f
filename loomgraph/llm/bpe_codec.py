"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A text is cut at single spaces that stand between two characters that aren't white space. The splitting pattern always
starts a new piece there, so each chunk's ids are the same wherever it stands; they are encoded once per worker and kept in
a bounded dictionary. A text's ids are the chunks' ids in a row. Such chunks are only right for the known splitting pattern; with
another pattern or another .json, whole texts go to the library.

Defined cases: a null text counts as empty (no ids, digests of nothing); a null doc_id stays null; repeated rows are
encoded each; columns that aren't named are ignored, whatever their names; an empty table gives no rows. Texts of any
length are worked through in slices of about a million characters.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import freed, table, worker_cache

SLICE = 1 << 20
#: Chunks kept by a worker (about 200 bytes each); beyond that it starts anew.
KEPT_CHUNKS = 1_000_000
#: Texts that are held at once.
ROWS = 256
#: Below this, all versions of Unicode agree on what letters are.
LATIN_END = "\u0250"
#: A word and the marks after it are two pieces (an apostrophe may not be); most chunks are made of known ones.
MARKED = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\[-`{-~]+)")


def byte_table() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def tokenizer_of_ranks(ranks: dict[bytes, int], pattern: str):
    """A tokenizers.Tokenizer that merges by rank: any two neighbours whose concatenation has the lowest rank go first."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    chars = byte_table()
    shown = {token: "".join(chars[b] for b in token) for token in ranks}
    merges = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        merges += [(shown[token[:k]], shown[token[k:]]) for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks]
    made = Tokenizer(models.BPE({shown[t]: r for t, r in ranks.items()}, merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return made


class ChunkCodec:
    """Encodes texts to ids by chunks, and decodes ids by the byte table of the vocabulary."""

    def __init__(self, tokenizer, chunks: bool = True):
        self.tokenizer, self.chunks = tokenizer, chunks
        back = {c: b for b, c in byte_table().items()}
        vocab = tokenizer.get_vocab(with_added_tokens=False)
        self.pieces: list[bytes] = [b""] * (max(vocab.values(), default=-1) + 1)
        for token, k in vocab.items():
            self.pieces[k] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        added = {k: t.content.encode() for k, t in tokenizer.get_added_tokens_decoder().items()}
        self.pieces += [b""] * (max(added, default=-1) + 1 - len(self.pieces))
        for k, token in added.items():
            self.pieces[k] = token
        self.sizes = np.array([len(p) for p in self.pieces], np.int64)
        # Without added tokens in it, a chunk needs only the model, which is faster by itself.
        from tokenizers import Tokenizer

        self.marks = [t.decode() for t in added.values()]
        self.plain = tokenizer
        if self.marks and tokenizer.normalizer is None:
            self.plain = Tokenizer(tokenizer.model)
            self.plain.pre_tokenizer = tokenizer.pre_tokenizer
        self.model = self.plain.model
        self.space, self.shown = byte_table()[0x20], byte_table()
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.loose = re.compile(r"\s\s")
        self.cut = re.compile(r"(?<!\s) (?!\s)")

    def _ids(self, chunk: str) -> bytes:
        word = chunk[1:] if chunk[:1] == " " else chunk
        if word.isalpha() and max(word) < LATIN_END:  # one piece, so it can go to the model as it is
            shown = word if word.isascii() else "".join([self.shown[b] for b in word.encode()])
            return array("I", [t.id for t in self.model.tokenize(shown if word is chunk else self.space + shown)]).tobytes()
        use = self.tokenizer if any(m in chunk for m in self.marks) else self.plain
        return array("I", use.encode(chunk, add_special_tokens=False).ids).tobytes()

    def _head(self, chunk: str) -> bytes:
        found = self.first.get(chunk)
        if found is None:
            found = self.first[chunk] = self._ids(chunk)
        return found

    def _word(self, chunk: str) -> bytes:
        m = MARKED.fullmatch(chunk)
        return self._head(m[1]) + self._head(m[2]) if m else self._head(chunk)

    def _tail(self, chunk: str) -> bytes:
        """The ids of a chunk with its blank."""
        found = self.later.get(chunk)
        if found is None:
            if m := MARKED.fullmatch(chunk):
                found = self._tail(m[1]) + self._head(m[2])
            elif "\n" in chunk and all(p and not p[0].isspace() and not p[-1].isspace() for p in chunk.split("\n")):
                # a line end between two characters that aren't white space is a piece, too
                before, *after = chunk.split("\n")
                found = self._tail(before) + b"".join([self._head("\n") + self._word(p) for p in after])
            else:
                found = self._ids(" " + chunk)
            self.later[chunk] = found
        return found

    def _slices(self, text: str) -> Iterator[tuple[str, bool]]:
        """Slices that end where a chunk ends; the space in between is left out, and belongs to the slice after it."""
        at, begun = 0, False
        while len(text) - at > SLICE and (m := self.cut.search(text, at + SLICE)):
            yield text[at : m.start()], begun
            at, begun = m.end(), True
        yield text[at:], begun

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not self.chunks:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        out = []
        for part, begun in self._slices(text):
            chunks = self.cut.split(part) if self.loose.search(part) else part.split(" ")
            if len(self.later) + len(self.first) > KEPT_CHUNKS:
                self.later.clear()
                self.first.clear()
            if not begun:
                out.append(self._head(chunks.pop(0)))
            known = self.later
            try:
                out.append(b"".join([known[c] for c in chunks]))
            except KeyError:
                out.append(b"".join([self._tail(c) for c in chunks]))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[k] for k in np.frombuffer(ids, "<u4").tolist()])

    def spans(self, text: str, ids: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each token's first and last byte (exclusive), and the characters these bytes touch (first, last exclusive)."""
        raw = np.frombuffer(text.encode(), np.uint8)
        sizes = self.sizes[np.frombuffer(ids, "<u4")]
        end = np.cumsum(sizes)
        begin = end - sizes
        starts = (raw & 0xC0) != 0x80
        char = np.cumsum(starts) - 1
        touched = lambda at: char[np.clip(at, 0, max(len(raw) - 1, 0))] if len(raw) else at * 0
        return begin, end, touched(begin), touched(end - 1) + (1 if len(raw) else 0)


def codec(path: str | None = None, pattern: str | None = None) -> ChunkCodec:
    """The worker's codec of a vocabulary file: .tiktoken ranks (split by pattern) or a tokenizers .json.

    Of a .json, its own special tokens are matched in a text as they stand, as the library does by itself."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    kept = worker_cache().setdefault("codecs", {})
    if (path, pattern) not in kept:
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            kept[path, pattern] = ChunkCodec(Tokenizer.from_file(path), os.path.basename(path) == "byte_bpe_50k.json")
        else:
            pattern_used = pattern or public_tokenizers.PATTERN
            kept[path, pattern] = ChunkCodec(tokenizer_of_ranks(read_ranks(path), pattern_used), pattern_used == public_tokenizers.PATTERN)
    return kept[path, pattern]


def incremental_text(parts: Iterator[bytes]) -> Iterator[str]:
    """Text of decoded bytes that come in parts; a character that is split between parts appears with the later one."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    for part in parts:
        yield decoder.decode(part)
    yield decoder.decode(b"", True)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """id_col, ids, byte_start, byte_end, char_start, char_end (arrays): the tokens of each text with their offsets."""

    def run(batches):
        enc = codec(path, pattern)
        for batch in batches:
            rows = [[], [], [], [], []]
            for text in batch.column(1).to_pylist():
                ids = enc.encode(text or "")
                for to, found in zip(rows, (np.frombuffer(ids, "<u4").astype("i4"), *enc.spans(text or "", ids)), strict=True):
                    to.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(r, pa.list_(pa.int32() if k == 0 else pa.int64())) for k, r in enumerate(rows))], names=["id", "ids", "byte_start", "byte_end", "char_start", "char_end"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids array<int>, byte_start array<bigint>, byte_end array<bigint>, char_start array<bigint>, char_end array<bigint>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """id_col, bytes, text: ids turned back by the byte table; null ids count as none. Bytes that are no UTF-8 (a character that was split) become U+FFFD in text only."""

    def run(batches):
        enc = codec(path, pattern)
        for batch in batches:
            raw = [b"".join(enc.pieces[k] for k in ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array([r.decode("utf-8", "replace") for r in raw], pa.string())], names=["id", "bytes", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, bytes binary, text string").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_split, offsets_sha256 of every text: encoded, then decoded, some texts at a time, with digests only as the result.

    n_split counts the tokens that begin inside a character; offsets_sha256 is of all tokens' first and last (exclusive) byte,
    then all their first and last character, as little-endian 64-bit integers."""

    def run(batches):
        enc = codec(path, pattern)
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            out: list[tuple] = []
            for text in batch.column(1):
                text = text.as_py() or ""
                ids = enc.encode(text)
                spans = enc.spans(text, ids)
                begins_inside = int(((np.frombuffer(text.encode(), np.uint8)[spans[0]] & 0xC0) == 0x80).sum()) if ids else 0
                offsets = hashlib.sha256(b"".join([np.stack(x, axis=1).astype("<i8").tobytes() for x in (spans[:2], spans[2:])]))
                out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(enc.decode(ids)).hexdigest(), begins_inside, offsets.hexdigest()))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_split", "offsets_sha256"])

    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(freed(run, "codecs"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long, offsets_sha256 string")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


QUERIES = {"op5_byte_bpe": op5_byte_bpe}
ORACLES: dict[str, str] = {}
