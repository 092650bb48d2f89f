"""Media columns as progressive JPEG: scans accumulate in coefficient arrays; numpy turns these into RGB tensors.

A payload of bytes is kept losslessly in the quantised coefficients, the unit that JPEG itself doesn't change. Blocks of 64
bytes are the blocks of three components (luma with twice the chroma's width and height); each byte is one coefficient, a blank
being 0 and the bytes next to it the small ones, so that coefficients have zeros, many sizes and both signs. Quantisers are 1.

Scans of a file: the DC coefficients without their last bit, by differences; per component the AC coefficients without their
last bit, luma in two spectral bands; then the last bits by successive approximation, with the coefficients that are new.
Symbols are runs of zeros and sizes, ends of bands and runs of such, in Huffman codes of variable length.

The reader takes any such scans in any order. Where a scan's symbols stand is found by looking up all bit positions at once and
walking from symbol to symbol; all else is done by arrays, over all files at once that have the same kinds of scans. It reads 8-bit files of one to three components with sampling
factors 1 and 2, of whole coded blocks (restart intervals and arithmetic coding aren't read).

A payload of more than FRAME bytes becomes several files in a row, which are read one after the other, so that memory stays
bounded by the text itself and what one frame needs.

Defined cases: a null text is an empty payload, and a payload is padded with zero bytes to a positive multiple of 64. Rows are
independent; null and repeated doc_ids stay; columns that aren't named are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import freed, new_path, table, worker_cache

FACTORS = ((2, 2), (1, 1), (1, 1))
#: Spectral bands of each component's first AC scans.
BANDS = (((1, 20), (21, 63)), ((1, 63),), ((1, 63),))
#: Longest run of blocks that one end-of-band symbol covers.
LONGEST_RUN = 32767
#: Payload bytes of one file: whole units of 384 bytes.
FRAME = 384 << 10
#: Payload or file bytes that are worked on at once, but for one text's, and rows.
TOGETHER = 1 << 18
ROWS = 128
BLANK = 0x20


def zigzag() -> np.ndarray:
    """Place in the 8 x 8 block of each coefficient in coded order."""
    kept = worker_cache()
    if "zigzag" not in kept:
        cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[1] if (x[0] + x[1]) % 2 == 0 else x[0]))
        kept["zigzag"] = np.array([8 * r + c for r, c in cells])
    return kept["zigzag"]


def mcu_order(wide: int, high: int, factors: tuple[tuple[int, int], ...]) -> list[np.ndarray]:
    """For each component, the block numbers (row by row) as an interleaved scan meets them: one row for each MCU."""
    kept = worker_cache().setdefault("orders", {})
    if (wide, high, factors) not in kept:
        if len(kept) > 256:
            kept.clear()
        out = []
        for h, v in factors:
            block = np.arange(wide * h * high * v).reshape(high, v, wide, h)
            out.append(block.transpose(0, 2, 1, 3).reshape(wide * high, v * h))
        kept[wide, high, factors] = out
    return kept[wide, high, factors]


def _places(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as counted, one after the other."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


# ---------------------------------------------------------------- Huffman tables


class Table:
    """A Huffman table: codes of the symbols, and what every 16 bits begin with."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.counts, self.symbols = counts, symbols
        self.code, self.size = np.zeros(256, np.int64), np.zeros(256, np.int64)
        self.length, self.symbol = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
        code = at = 0
        for length, n in enumerate(counts, 1):
            for s in symbols[at : at + n]:
                self.code[s], self.size[s] = code, length
                first = code << (16 - length)
                self.length[first : first + (1 << (16 - length))] = length
                self.symbol[first : first + (1 << (16 - length))] = s
                code += 1
            at, code = at + n, code << 1
        run, s = self.symbol >> 4, self.symbol & 15
        never = np.where(self.length == 0, 255, 0).astype(np.uint8)  # no code: out of any scan
        self.dc_step = np.maximum(self.length + s, never)
        self.more = np.where(s > 0, s, np.where(run < 15, run, 0)).astype(np.uint8)
        self.ac_step = np.maximum(self.length + self.more, never)

    @staticmethod
    def of(counts: bytes, symbols: bytes) -> "Table":
        kept = worker_cache().setdefault("tables", {})
        if len(kept) > 64:
            kept.clear()
        if (counts, symbols) not in kept:
            kept[counts, symbols] = Table(counts, symbols)
        return kept[counts, symbols]


def huffman(weights: dict[int, float]) -> Table:
    """The best codes for these weights. The code of ones only belongs to none."""
    floor = sum(weights.values()) / (1 << 13)
    heap = [(max(w, floor), k, (s,)) for k, (s, w) in enumerate(weights.items())] + [(0.0, -1, (-1,))]
    heapq.heapify(heap)
    depth, k = dict.fromkeys([*weights, -1], 0), len(heap)
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        for s in x + y:
            depth[s] += 1
        heapq.heappush(heap, (a + b, k := k + 1, x + y))
    depth[-1] = max(depth.values())
    order = sorted(depth, key=lambda s: (depth[s], s < 0, s))
    own = [s for s in order if s >= 0]
    return Table.of(bytes(sum(depth[s] == n for s in own) for n in range(1, 17)), bytes(own))


def _written_tables() -> tuple[Table, Table, Table]:
    """DC differences, first AC scans, last bits of AC; weights are assumed ones."""
    kept = worker_cache()
    if "written_tables" not in kept:
        ends = {r << 4: 1 / (1 + r) ** 2 for r in range(15)} | {0xF0: 0.01}
        sizes = {r << 4 | s: 4 / (1 + r) ** 3 / (1 + abs(s - 5)) ** 2 for r in range(16) for s in range(1, 8)}
        kept["written_tables"] = (huffman({s: 1 / (1 + abs(s - 5)) for s in range(9)}), huffman(sizes | ends), huffman({r << 4 | 1: 0.2 / (1 + r) for r in range(16)} | ends))
    return kept["written_tables"]


# ---------------------------------------------------------------- writing


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, number: int, t: Table) -> bytes:
    return _segment(0xC4, bytes([kind << 4 | number]) + t.counts + t.symbols)


def _bits(value: np.ndarray, size: np.ndarray, file: np.ndarray, n: int) -> list[bytes]:
    """For each of n files (numbered from 0, in order), its numbers of up to 31 bits one after the other, filled up with ones, with a zero byte after each 0xFF."""
    edge = np.searchsorted(file, np.arange(n + 1))
    end = np.concatenate([[0], np.cumsum(size)])
    total = end[edge[1:]] - end[edge[:-1]]
    at = np.concatenate([[0], np.cumsum((total + 7) >> 3)])  # each file's first byte
    begin = end[:-1] + np.repeat(8 * at[:-1] - end[edge[:-1]], np.diff(edge))
    out = np.zeros(int(at[-1] >> 2) + 3, np.uint64)
    if len(begin):
        word = begin >> 5
        both = value.astype(np.uint64) << (64 - (begin & 31) - size).astype(np.uint64)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[first]] = np.add.reduceat(both >> np.uint64(32), first)  # bits don't meet, so sums are unions
        out[word[first] + 1] += np.add.reduceat(both & np.uint64(0xFFFFFFFF), first)
    raw = np.frombuffer(out.astype(">u4").tobytes(), np.uint8).copy()
    some = total > 0
    raw[at[1:][some] - 1] |= ((1 << (-total[some] % 8)) - 1).astype(np.uint8)
    raw, at = raw.tobytes(), at.tolist()
    return [raw[a:b].replace(b"\xff", b"\xff\x00") for a, b in zip(at, at[1:])]


def bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1]


def _coded(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A number's bits of its size: negative ones less one."""
    return np.where(value > 0, value, value + (1 << size) - 1)


def _ends(need: np.ndarray, whole: np.ndarray, file: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each run of ends of bands. need: blocks that end early; whole: those without any symbol."""
    starts = need.copy()
    starts[1:] &= ~(whole[1:] & need[:-1]) | (file[1:] != file[:-1])
    group = np.cumsum(starts)[need] - 1
    at = np.flatnonzero(need)
    place = np.arange(len(at)) - np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))[group] if len(at) else at
    first = np.flatnonzero(place % LONGEST_RUN == 0)
    return at[first], np.diff(np.concatenate([first, [len(at)]]))


def _events(table: Table, symbol: np.ndarray, more: np.ndarray, more_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return table.code[symbol] << more_size | more, table.size[symbol] + more_size


def _merged(key: list[np.ndarray], value: list[np.ndarray], size: list[np.ndarray], w: int, file: np.ndarray) -> list[bytes]:
    """The bits of each file, by keys: twice the place of a coefficient, and one more for what comes second there."""
    keys = np.concatenate(key)
    order = np.argsort(keys, kind="stable")
    return _bits(np.concatenate(value)[order], np.concatenate(size)[order], file[(keys[order] >> 1) // w], int(file[-1]) + 1)


def _end_events(table: Table, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    r = bit_length(run) - 1
    return _events(table, r << 4, run - (1 << r), r)


def first_pass(band: np.ndarray, table: Table, file: np.ndarray) -> list[bytes]:
    """Codes of a band (blocks x coefficients) of which nothing is known yet; file numbers each block's file."""
    w = band.shape[1]
    flat = band.reshape(-1).astype(np.int64)
    at = np.flatnonzero(flat)
    known = flat[at]
    before = np.concatenate([[-1], at[:-1]])
    run = at - np.maximum(before, at // w * w - 1) - 1
    size = bit_length(np.abs(known))
    value, bits = _events(table, (run & 15) << 4 | size, _coded(known, size), size)
    first, length = _ends(band[:, -1] == 0, ~band.any(axis=1), file)
    ends, end_bits = _end_events(table, length)
    skips = run >> 4
    skip, skip_bits = _events(table, np.full(skips.sum(), 0xF0), 0, np.zeros(skips.sum(), np.int64))
    # what stands before a coefficient comes first; ends of bands stand in the place of their block's last coefficient
    return _merged([2 * at + 1, 2 * np.repeat(at, skips), 2 * ((first + 1) * w - 1) + 1], [value, skip, ends], [bits, skip_bits, end_bits], w, file)


def last_bits(band: np.ndarray, table: Table, file: np.ndarray) -> list[bytes]:
    """Codes of a band's last bits: a bit for each coefficient above 1, symbols for new ones."""
    n, w = band.shape
    flat = band.reshape(-1).astype(np.int64)
    size = np.abs(flat)
    old, new, zero = np.flatnonzero(size > 1), np.flatnonzero(size == 1), np.flatnonzero(size == 0)
    begin = np.maximum(np.concatenate([[-1], new[:-1]]) + 1, new // w * w)  # where a symbol's span starts
    rank = np.searchsorted(zero, begin)
    run = np.searchsorted(zero, new) - rank
    skips = run >> 4
    behind = lambda k: zero[np.clip(k, 0, len(zero) - 1)] + 1 if len(zero) else k
    which = np.repeat(np.arange(len(new)), skips)
    nth = _places(np.zeros(len(new), np.int64), skips)
    skip_at = np.where(nth > 0, behind(rank[which] + 16 * nth - 1), begin[which])
    value, bits = _events(table, (run & 15) << 4 | 1, (flat[new] > 0).astype(np.int64), np.ones(len(new), np.int64))
    skip, skip_bits = _events(table, np.full(len(which), 0xF0), 0, np.zeros(len(which), np.int64))
    fresh = np.zeros(n, bool)
    fresh[new // w] = True
    far = np.arange(n) * w  # behind each block's last new coefficient
    np.maximum.at(far, new // w, new + 1)
    first, length = _ends(far < (np.arange(n) + 1) * w, ~fresh, file)
    ends, end_bits = _end_events(table, length)
    return _merged(
        [2 * np.where(skips > 0, behind(rank + 16 * skips - 1), begin), 2 * skip_at, 2 * far[first], 2 * old + 1],
        [value, skip, ends, size[old] & 1],
        [bits, skip_bits, end_bits, np.ones(len(old), np.int64)],
        w,
        file,
    )


def to_coefficients(raw: np.ndarray) -> np.ndarray:
    v = (raw - np.uint8(BLANK)).astype(np.int16)
    return v >> 1 ^ -(v & 1)


def to_bytes(c: np.ndarray) -> np.ndarray:
    return (np.where(c < 0, -2 * c - 1, 2 * c) + BLANK).astype(np.uint8)


def encode(payloads: list[bytes]) -> list[bytes]:
    """The file of each payload of at most FRAME bytes; lengths must be positive multiples of 64."""
    if not payloads:
        return []
    if any(not p or len(p) % 64 or len(p) > FRAME for p in payloads):
        raise ValueError("a payload has a positive multiple of 64 bytes, and has a limit")
    shapes = []
    for p in payloads:
        mcus = -(-len(p) // 384)
        wide = math.isqrt(mcus - 1) + 1
        shapes.append((wide, -(-mcus // wide)))
    mcus = np.array([w * h for w, h in shapes])
    raw = np.frombuffer(b"".join(p.ljust(384 * m, bytes([BLANK])) for p, m in zip(payloads, mcus.tolist())), np.uint8)
    blocks, base = to_coefficients(raw).reshape(-1, 64), np.cumsum(6 * mcus) - 6 * mcus
    sizes = [h * v for h, v in FACTORS]
    number = np.arange(len(payloads))
    files = [np.repeat(number, mcus * n) for n in sizes]
    planes = [blocks[_places(base + mcus * sum(sizes[:k]), mcus * n)] for k, n in enumerate(sizes)]
    dc_table, ac_table, bit_table = _written_tables()

    # DC coefficients as the interleaved scan meets them, and where each one's component had the one before
    rows = []
    for (w, h), at in zip(shapes, base.tolist()):
        own = mcu_order(w, h, FACTORS)
        rows.append(np.concatenate([at + w * h * sum(sizes[:k]) + o for k, o in enumerate(own)], axis=1).reshape(-1))
    dc = blocks[np.concatenate(rows), 0].astype(np.int64)
    each = np.array([1 if k else 6 - n + 1 for n in sizes for k in range(n)])
    upper, place = dc >> 1, np.arange(len(dc))
    before = place - np.tile(each, int(mcus.sum()))
    start = np.repeat(base, 6 * mcus)
    d = upper - np.where(before >= start, upper[np.maximum(before, 0)], 0)
    size = bit_length(np.abs(d))
    owner = np.repeat(number, 6 * mcus)
    all_parts = [(k + 1, 0) for k in range(3)]
    scans = [(all_parts, 0, 0, 0, 1, _bits(*_events(dc_table, size, _coded(d, size) * (size > 0), size), owner, len(payloads)))]
    for k, bands in enumerate(BANDS):
        part = np.sign(planes[k]) * (np.abs(planes[k]) >> 1)
        scans += [([(k + 1, 0)], a, b, 0, 1, first_pass(part[:, a : b + 1], ac_table, files[k])) for a, b in bands]
    scans.append((all_parts, 0, 0, 1, 0, _bits(dc & 1, np.ones(len(dc), np.int64), owner, len(payloads))))
    scans += [([(k + 1, 1)], 1, 63, 1, 0, last_bits(p[:, 1:], bit_table, files[k])) for k, p in enumerate(planes)]

    start = b"\xff\xd8" + _segment(0xE0, b"JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00") + _segment(0xDB, bytes([0]) + bytes([1] * 64))
    start += _table(0, 0, dc_table) + _table(1, 0, ac_table) + _table(1, 1, bit_table)
    kinds = b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(FACTORS))
    heads = [_segment(0xDA, bytes([len(x[0])]) + b"".join(bytes(p) for p in x[0]) + bytes([x[1], x[2], x[3] << 4 | x[4]])) for x in scans]
    out = []
    for k, ((w, h), p) in enumerate(zip(shapes, payloads)):
        frame = _segment(0xFE, b"bytes=%d" % len(p)) + _segment(0xC2, struct.pack(">BHHB", 8, 16 * h, 16 * w, 3) + kinds)
        out.append(start + frame + b"".join([x for head, scan in zip(heads, scans) for x in (head, scan[5][k])]) + b"\xff\xd9")
    return out


def frames(payloads: list[bytes]) -> list[bytes]:
    """The files of each payload, one after the other. Small payloads are worked on together."""
    out: list[list[bytes]] = [[] for _ in payloads]
    waiting: list[tuple[int, bytes]] = []

    def done() -> None:
        for (k, _), made in zip(waiting, encode([p for _, p in waiting])):
            out[k].append(made)
        waiting.clear()

    size = 0
    for k, p in enumerate(payloads):
        for at in range(0, len(p), FRAME):
            waiting.append((k, p[at : at + FRAME]))
            size += len(waiting[-1][1])
            if size >= TOGETHER:
                done()
                size = 0
    done()
    return [b"".join(x) for x in out]


# ---------------------------------------------------------------- reading


@dataclass
class Component:
    number: int
    h: int
    v: int
    quantiser: int
    blocks: np.ndarray = field(default=None)
    across: int = 0


class Scans:
    """The bits of the same scan of several files, with room between them."""

    def __init__(self, data: list[bytes]):
        sizes = np.array([len(d) for d in data], np.int64)
        self.start = 8 * (np.cumsum(sizes + 8) - sizes - 8)
        self.end = self.start + 8 * sizes
        b = np.frombuffer((b"\xff" * 8).join([*data, b""]) + b"\xff" * 8, np.uint8).astype(np.uint32)
        self.words = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]

    def number(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """n bits (up to 24) from each place."""
        word = self.words[np.minimum(at >> 3, len(self.words) - 1)].astype(np.int64)
        return word >> (32 - (at & 7) - n) & ((1 << n) - 1)

    def one(self, at: int, n: int) -> int:
        return int(self.words[at >> 3]) >> (32 - (at & 7) - n) & ((1 << n) - 1)

    def walk(self, tables: list[Table], step: str, limits: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place and first 16 bits of the symbols of each file from its scan's start on, and their numbers by file. tables take turns."""
        heads = (self.words[:, None] >> np.arange(16, 8, -1, dtype=np.uint32)).astype(np.uint16).reshape(-1)
        same = all(t is tables[0] for t in tables)
        steps = [getattr(t, step)[heads].tobytes() for t in (tables[:1] if same else tables)]
        found: list[int] = []
        add, own, counts = found.append, steps[0], []
        for k, (at, end) in enumerate(zip(self.start.tolist(), self.end.tolist())):
            n = len(found)
            if limits is None:
                while at < end:
                    add(at)
                    at += own[at]
            elif same:
                for _ in range(limits[k]):
                    add(at)
                    at += own[at]
            else:
                for turn in range(limits[k]):
                    add(at)
                    at += steps[turn % len(steps)][at]
            if limits is not None and at > end:
                raise ValueError("a scan ends too early")
            counts.append(len(found) - n)
        place = np.array(found, np.int64)
        return place, heads[place], np.array(counts)


def _signed(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Numbers of their sizes' bits."""
    return np.where((size > 0) & (bits < 1 << np.maximum(size - 1, 0)), bits - (1 << size) + 1, bits)


class Reader:
    """The file that starts at a place, in parts; read() accumulates its scans. end is where it ends."""

    def __init__(self, data: bytes, at: int = 0):
        self.quantisers: dict[int, np.ndarray] = {}
        tables: dict[tuple[int, int], Table] = {}
        self.parts: list[Component] = []
        self.comment = b""
        #: components and their tables, first and last coefficient, whether bits are added, shift
        self.scans: list[tuple[tuple[tuple[int, Table | None], ...], int, int, bool, int]] = []
        self.data: list[bytes] = []
        at += 2
        while data[at + 1] != 0xD9:
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quantisers[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.int32)
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    tables[body[0] >> 4, body[0] & 15] = Table.of(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xC2:
                _, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
                self.parts = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            elif 0xC0 <= marker <= 0xCF or marker == 0xDD:
                raise ValueError(f"marker {marker:#x} isn't read")
            elif marker == 0xDA:
                end = data.index(b"\xff", at)
                while data[end + 1] == 0:
                    end = data.index(b"\xff", end + 2)
                n = body[0]
                first, last, approx = body[1 + 2 * n : 4 + 2 * n]
                numbers = [p.number for p in self.parts]
                own = lambda t, first=first: (0, t >> 4) if first == 0 else (1, t & 15)
                self.scans.append((tuple((numbers.index(body[1 + 2 * k]), tables.get(own(body[2 + 2 * k]))) for k in range(n)), first, last, approx > 15, approx & 15))
                self.data.append(data[at:end].replace(b"\xff\x00", b"\xff"))
                at = end
        self.end = at + 2
        self.h, self.v = max(p.h for p in self.parts), max(p.v for p in self.parts)
        self.wide, self.high = self.width // (8 * self.h), self.height // (8 * self.v)
        if self.width % (8 * self.h) or self.height % (8 * self.v):
            raise ValueError("the size isn't one of whole blocks")
        for p in self.parts:
            p.across = self.wide * p.h

    def kind(self) -> tuple:
        """Files of one kind are read together."""
        return tuple((p.h, p.v) for p in self.parts), tuple(self.scans)

    def payload(self) -> bytes:
        """The bytes that encode() has stored."""
        size = int(self.comment.removeprefix(b"bytes="))
        return to_bytes(np.concatenate([p.blocks for p in self.parts])).tobytes()[:size]

    def rgb(self) -> np.ndarray:
        """The picture as a tensor: height, width, 3; chroma is repeated up to full size."""
        kept = worker_cache()
        if "waves" not in kept:
            waves = np.cos((2 * np.arange(8)[:, None] + 1) * np.arange(8) * np.pi / 16) * np.where(np.arange(8) == 0, math.sqrt(0.5), 1) / 2
            kept["waves"] = np.kron(waves, waves).T[zigzag()].copy()  # of each coefficient in coded order, over the 64 pixels
        planes = []
        for p in self.parts:
            pixels = np.clip(np.rint((p.blocks * self.quantisers[p.quantiser]).astype(np.float64) @ kept["waves"]) + 128, 0, 255).astype(np.int32)
            planes.append((pixels.reshape(-1, p.across, 8, 8).transpose(0, 2, 1, 3).reshape(-1, 8 * p.across), self.v // p.v, self.h // p.h))
        full = lambda x, v, h: x.repeat(v, axis=0).repeat(h, axis=1) if v > 1 or h > 1 else x
        y = full(*planes[0])
        out = np.empty((*y.shape, 3), np.uint8)
        if len(planes) == 1:
            out[:] = y[:, :, None]
            return out
        (cb, *b_size), (cr, *r_size) = planes[1:3]
        cb, cr = cb - 128, cr - 128
        # The colour equations of JFIF, in units of 2^-16.
        share = lambda x, c: (x * c + (1 << 15)) >> 16
        red, blue, green = share(cr, 91881), share(cb, 116130), full(share(cb, -22554), *b_size) + full(share(cr, -46802), *r_size)
        for k, more in enumerate((full(red, *r_size), green, full(blue, *b_size))):
            out[:, :, k] = np.clip(y + more, 0, 255)
        return out


def read(files: list[Reader]) -> None:
    """Accumulates all scans in the coefficient arrays of the files' components."""
    kinds: dict[tuple, list[Reader]] = {}
    for f in files:
        kinds.setdefault(f.kind(), []).append(f)
    for (factors, scans), own in kinds.items():
        counts = [np.array([f.wide * h * f.high * v for f in own]) for h, v in factors]
        planes = [np.zeros((int(n.sum()), 64), np.int16) for n in counts]
        for k, (parts, first, last, added, low) in enumerate(scans):
            bits = Scans([f.data[k] for f in own])
            if first == 0:
                orders = []
                for c, _ in parts:
                    base = np.cumsum(counts[c]) - counts[c]
                    orders.append([b + (mcu_order(f.wide, f.high, tuple(factors[c] for c, _ in parts))[[c for c, _ in parts].index(c)] if len(parts) > 1 else np.arange(n)[:, None]) for f, b, n in zip(own, base.tolist(), counts[c].tolist())])
                (_dc_bits if added else _dc)([planes[c] for c, _ in parts], [t for _, t in parts], orders, low, bits)
            else:
                (_ac_bits if added else _ac)(planes[parts[0][0]], parts[0][1], first, last, low, bits, counts[parts[0][0]])
        for c, (plane, n) in enumerate(zip(planes, counts)):
            for f, part in zip(own, np.split(plane, np.cumsum(n)[:-1])):
                f.parts[c].blocks = part


def _dc_bits(planes: list[np.ndarray], tables: list[Table], orders: list[list[np.ndarray]], low: int, scans: Scans) -> None:
    widths = [o[0].shape[1] for o in orders]
    rows = np.array([len(o) for o in orders[0]])
    found = scans.number(_places(scans.start, rows * sum(widths)), np.int64(1)).astype(np.int16).reshape(-1, sum(widths))
    at = 0
    for plane, o, w in zip(planes, orders, widths, strict=True):
        plane[np.concatenate(o), 0] |= found[:, at : at + w] << low
        at += w


def _dc(planes: list[np.ndarray], tables: list[Table], orders: list[list[np.ndarray]], low: int, scans: Scans) -> None:
    widths = [o[0].shape[1] for o in orders]
    turns = [t for t, w in zip(tables, widths, strict=True) for _ in range(w)]
    rows = np.array([len(o) for o in orders[0]])
    place, head, _ = scans.walk(turns, "dc_step", (rows * len(turns)).tolist())
    head = head.reshape(-1, len(turns))
    length, size = (np.stack([getattr(t, name)[head[:, k]] for k, t in enumerate(turns)], axis=1).reshape(-1).astype(np.int64) for name in ("length", "symbol"))
    step = _signed(scans.number(place + length, size), size).reshape(-1, len(turns))
    at, first = 0, np.cumsum(rows) - rows
    for plane, o, w in zip(planes, orders, widths, strict=True):
        own = step[:, at : at + w]
        total = np.cumsum(own.reshape(-1)).reshape(own.shape)
        before = np.concatenate([[0], total[:, -1]])[first]  # what the files before have added
        plane[np.concatenate(o), 0] = (total - np.repeat(before, rows)[:, None]) << low
        at += w


def _ac(plane: np.ndarray, table: Table, first: int, last: int, low: int, scans: Scans, counts: np.ndarray) -> None:
    w = last - first + 1
    place, head, n = scans.walk([table], "ac_step")
    length, symbol, more = table.length[head].astype(np.int64), table.symbol[head].astype(np.int64), table.more[head].astype(np.int64)
    run, size = symbol >> 4, symbol & 15
    bits = scans.number(place + length, more)
    is_end = (size == 0) & (run < 15)
    gone = np.concatenate([[0], np.cumsum(np.where(size > 0, run + 1, np.where(is_end, 0, 16)))])  # coefficients that symbols cover
    # A part goes from the start of a file, or from an end of band, to the next one; it starts where a block does.
    begin = np.zeros(len(symbol) + 1, bool)
    begin[np.cumsum(n) - n] = True
    begin[1:] |= is_end
    opens = np.flatnonzero(begin[:-1])
    closes = np.concatenate([opens[1:], [len(symbol)]]) - 1
    blocks = np.where(is_end[closes], (gone[closes] - gone[opens]) // w + (1 << run[closes]) + bits[closes], 0)
    before = np.cumsum(blocks) - blocks
    number = np.cumsum(begin[:-1]) - 1  # each symbol's part
    file = np.repeat(np.arange(len(n)), n)
    base = np.cumsum(counts) - counts
    start = (base[file[opens]] + before - before[number[np.minimum(np.cumsum(n) - n, len(number) - 1)]][file[opens]]) * w
    at = start[number] + gone[1:] - gone[opens][number] - 1
    use = (size > 0) & (at < (base + counts)[file] * w) & (length > 0)
    at, run, size, bits = at[use], run[use], size[use], bits[use]
    if ((at - run) // w != at // w).any():
        raise ValueError("a run of zeros is longer than its block")
    plane[at // w, first + at % w] = _signed(bits, size) * (1 << low)


def _ac_bits(plane: np.ndarray, table: Table, first: int, last: int, low: int, scans: Scans, counts: np.ndarray) -> None:
    w = last - first + 1
    flat = plane[:, first : last + 1].reshape(-1)
    is_old = flat != 0
    old, zero = np.flatnonzero(is_old), np.flatnonzero(~is_old)
    before = np.concatenate([[0], np.cumsum(is_old)])  # old ones before each place
    new_at, new_sign, span_from, span_bits = [], [], [], []
    end = np.cumsum(counts) * w
    for here, total, at, stop_at in zip((end - counts * w).tolist(), end.tolist(), scans.start.tolist(), scans.end.tolist()):
        while here < total:
            head = scans.one(at, 16)
            length, symbol = int(table.length[head]), int(table.symbol[head])
            if not length or at >= stop_at:
                raise ValueError("no such code")
            at += length
            run, size = symbol >> 4, symbol & 15
            if size == 0 and run < 15:
                blocks = (1 << run) + scans.one(at, run)
                at += run
                to = stop = min((here // w + blocks) * w, total)
            else:
                if size:
                    new_sign.append(scans.one(at, 1))
                    at += 1
                rank = here - int(before[here]) + run  # of the zero that the symbol goes to
                stop = int(zero[rank]) if rank < len(zero) else total
                if stop // w != here // w:
                    raise ValueError("a run of zeros is longer than its block")
                if size:
                    new_at.append(stop)
                to = stop + 1
            span_from.append(int(before[here]))
            span_bits.append(at)
            at += int(before[stop] - before[here])
            here = to
    count = np.diff(np.array([*span_from, len(old)]))
    bits = scans.number(_places(np.array(span_bits, np.int64), count), np.int64(1))
    flat[old] += (np.sign(flat[old]) * (bits << low)).astype(np.int16)
    if new_at:
        flat[new_at] = np.where(np.array(new_sign) > 0, 1 << low, -(1 << low))
    plane[:, first : last + 1] = flat.reshape(-1, w)


def opened(media: list[bytes]) -> Iterator[tuple[int, Reader]]:
    """The files that stand one after the other in each of media, with its number, read. Small ones are worked on together."""
    waiting: list[tuple[int, Reader]] = []
    size = 0
    for k, m in enumerate(media):
        at = 0
        while at < len(m):
            waiting.append((k, Reader(m, at)))
            size += waiting[-1][1].end - at
            at = waiting[-1][1].end
            if size >= TOGETHER:
                read([f for _, f in waiting])
                yield from waiting
                waiting, size = [], 0
    read([f for _, f in waiting])
    yield from waiting


# ---------------------------------------------------------------- tables


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 64 if raw else 64)


class Feature:
    """Number of frames and pixels, and the mean and variance of each channel in hundredths, from whole sums."""

    def __init__(self):
        self.frames, self.counts = 0, np.zeros((3, 256), np.int64)

    def add(self, rgb: np.ndarray) -> None:
        self.frames += 1
        for k in range(3):
            self.counts[k] += np.bincount(rgb[:, :, k].reshape(-1), minlength=256)

    def text(self) -> str:
        n, level = int(self.counts[0].sum()), np.arange(256)
        total, squares = self.counts @ level, self.counts @ (level * level)
        mean = [int(t) * 100 // n for t in total]
        spread = [(int(q) * n - int(t) * int(t)) * 100 // (n * n) for q, t in zip(squares, total, strict=True)]
        return f"{self.frames}x{n};" + ",".join(map(str, mean)) + ";" + ",".join(map(str, spread))


def _by_rows(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes (of the text) and media, the files that hold the text's bytes."""

    def run(batches):
        for batch in _by_rows(batches):
            raw = [(t.as_py() or "").encode() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(frames([padded(r) for r in raw]), pa.binary())], names=["id", "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(freed(run), f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def stored(files: DataFrame) -> DataFrame:
    """files, written to the shared folder and read back."""
    spark, path = files.sparkSession, new_path(files.sparkSession, "media")
    files.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(files.schema).parquet(path)


def tensors(files: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """id_col, frame (from 0), payload, height, width, rgb (height * width * 3 bytes) of each file in media_col; null media give no rows."""

    def run(batches):
        names, kinds = ["frame", "payload", "height", "width", "rgb"], [pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]
        for batch in _by_rows(batches):
            last, frame = -1, 0
            for row, f in opened([m or b"" for m in batch.column(1).to_pylist()]):
                last, frame = row, frame + 1 if row == last else 0
                rgb = f.rgb()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), *(pa.array([x], t) for x, t in zip((frame, f.payload(), *rgb.shape[:2], rgb.tobytes()), kinds, strict=True))], names=["id", *names])

    kind = files.schema[id_col].dataType.simpleString()
    return files.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(freed(run), f"id {kind}, frame int, payload binary, height int, width int, rgb binary").withColumnRenamed("id", id_col)


def features(files: DataFrame) -> DataFrame:
    """Digests of the payloads and files of doc_id, n_bytes, media, and the tensors' features; a tensor stays no longer than its frame is read."""

    def run(batches):
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in _by_rows(batches):
            files = batch.column(2).to_pylist()
            size, sha, tail, feature = [0] * len(files), [hashlib.sha256() for _ in files], [0] * len(files), [Feature() for _ in files]
            for k, f in opened(files):
                part = f.payload()
                size[k], tail[k] = size[k] + len(part), zlib.crc32(part[-64:])
                sha[k].update(part)
                feature[k].add(f.rgb())
            rows = [(n, s.hexdigest(), t, len(m), hashlib.sha256(m).hexdigest(), f.text()) for n, s, t, m, f in zip(size, sha, tail, files, feature, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=names)

    return files.select("doc_id", "n_bytes", "media").mapInArrow(
        freed(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def summary(docs: DataFrame) -> DataFrame:
    """Each text as files in the shared folder, read back from there."""
    return features(stored(media(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))))


def op9_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(table(spark, sf_dir, "documents"))


QUERIES = {"op9_progressive_jpeg": op9_progressive_jpeg}
ORACLES: dict[str, str] = {}
