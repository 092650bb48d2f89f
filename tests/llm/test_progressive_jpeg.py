import hashlib
import zlib

import numpy as np
import pytest

from loomgraph.llm import progressive_jpeg as J


def read(media):
    files = [J.Reader(media)]
    J.read(files)
    return files[0]


def plain(media):
    """Coefficients by component, bit by bit and symbol by symbol, as the standard tells it."""
    tables, out, at = {}, {}, 2
    while media[at + 1] != 0xD9:
        marker, n = media[at + 1], int.from_bytes(media[at + 2 : at + 4], "big")
        body, at = media[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xC4:
            code, k, symbols = 0, 17, {}
            for length in range(1, 17):
                for _ in range(body[length]):
                    symbols[f"{code:0{length}b}"] = body[k]
                    code, k = code + 1, k + 1
                code <<= 1
            tables[body[0]] = symbols
        if marker == 0xC2:
            high, wide = int.from_bytes(body[1:3], "big") // 16, int.from_bytes(body[3:5], "big") // 16
            for c, hv in ((1, 2), (2, 1), (3, 1)):
                out[c] = [[0] * 64 for _ in range(high * wide * hv * hv)]
        if marker != 0xDA:
            continue
        end = at
        while media[end] != 0xFF or media[end + 1] == 0:
            end += 1
        bits, at = iter("".join(f"{x:08b}" for x in media[at:end].replace(b"\xff\x00", b"\xff"))), end
        take = lambda n: int("0" + "".join(next(bits) for _ in range(n)), 2)  # noqa: E731, B023

        def signed(n):
            v = take(n)  # noqa: B023
            return v if n == 0 or v >> (n - 1) else v - (1 << n) + 1

        def symbol(table):
            code = ""
            while code not in tables[table]:  # noqa: B023
                code += next(bits)  # noqa: B023
            return tables[table][code]  # noqa: B023

        c, t, (first, last, hl) = body[1], body[2], body[-3:]
        up, low = hl >> 4, hl & 15
        if first == 0:
            before = dict.fromkeys(out, 0)
            for m in range(high * wide):
                y, x = divmod(m, wide)
                for c, block in [(1, (2 * y + j) * 2 * wide + 2 * x + i) for j in (0, 1) for i in (0, 1)] + [(2, m), (3, m)]:
                    if up:
                        out[c][block][0] |= take(1) << low
                    else:
                        before[c] += signed(symbol(0))
                        out[c][block][0] = before[c] << low
            continue
        run = 0
        for block in out[c]:
            k = first
            while k <= last and not run:
                r, s = divmod(symbol(0x10 | t), 16)
                if s == 0 and r < 15:
                    run = (1 << r) + take(r)
                    break
                value = signed(s) if s else 0
                while k <= last:
                    if up and block[k]:
                        block[k] += (take(1) << low) * (1 if block[k] > 0 else -1)
                    elif r == 0:
                        block[k], k = value * (1 << low), k + 1
                        break
                    else:
                        r -= 1
                    k += 1
            if run:
                for j in range(k, last + 1):
                    if up and block[j]:
                        block[j] += (take(1) << low) * (1 if block[j] > 0 else -1)
                run -= 1
    return out


def payloads():
    rng = np.random.default_rng(1)
    near = np.frombuffer(b"                    !\"#ab", np.uint8)
    found = [rng.integers(0, 256, 64 * n, np.uint8).tobytes() for n in (1, 5, 6, 7, 40)]
    found += [rng.choice(near, 64 * n).astype(np.uint8).tobytes() for n in (1, 12, 90)]
    return found + [b" " * 64, b" " * 384 * 9 + b"x" * 64 + b" " * 3200, b"!" * 64 + b" " * 640, bytes(range(256)), b"\xff" * 640, bytes(64)]


def test_round_trip_and_plain_reading():
    found = payloads()
    together = J.encode(found)
    assert together == [J.encode([p])[0] for p in found]  # whoever is beside it
    files = [J.Reader(m) for m in together]
    J.read(files)
    for f, m, p in zip(files, together, found):
        assert f.payload() == p and f.rgb().shape == (f.height, f.width, 3)
        assert [c.blocks.tolist() for c in f.parts] == list(plain(m).values())
        assert (np.concatenate([c.blocks for c in f.parts])[: len(p) // 64].reshape(-1)[np.frombuffer(p, np.uint8) == J.BLANK] == 0).all()


def test_long_runs_of_empty_blocks():
    n = J.LONGEST_RUN
    need = np.ones(3 * n + 5, bool)
    need[2 * n] = False
    first, length = J._ends(need, need, np.zeros(len(need), np.int64))
    assert first.tolist() == [0, n, 2 * n + 1, 3 * n + 1] and length.tolist() == [n, n, n, 4]


def test_several_files_and_limits(monkeypatch):
    monkeypatch.setattr(J, "FRAME", 384 * 4)
    monkeypatch.setattr(J, "TOGETHER", 3000)
    found = payloads()
    media = J.frames(found)
    out = [b""] * len(found)
    for k, f in J.opened(media):
        out[k] += f.payload()
    assert out == found
    with pytest.raises(ValueError):
        J.encode([b"x"])


def scans(blocks, with_refinement):
    """A file of one component whose AC coefficients have zeros and many sizes, written symbol by symbol."""
    n = len(blocks)
    symbols = sorted({(r << 4) | s for r in range(16) for s in range(9)})
    table = lambda own: J.Table.of(bytes([0] * 7 + [len(own)] + [0] * 8), bytes(own))
    dc, ac = list(range(12)), symbols[:254]
    code = lambda t, s: f"{t.index(s):08b}"
    scan = lambda first, last, high, low, out: J._segment(0xDA, bytes([1, 1, 0, first, last, high << 4 | low])) + np.packbits(np.array([int(x) for x in out + "1" * (-len(out) % 8)], np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")
    number = lambda v, s: f"{v if v > 0 else v + (1 << s) - 1:0{s}b}" if s else ""
    head = b"\xff\xd8" + J._segment(0xDB, bytes([0]) + bytes([1] * 64)) + J._segment(0xC2, b"\x08\x00\x08" + (8 * n).to_bytes(2, "big") + b"\x01\x01\x11\x00") + J._table(0, 0, table(dc)) + J._table(1, 0, table(ac))
    low = 1 if with_refinement else 0
    out, before = "", 0
    for b in blocks:
        d = int(b[0]) - before
        before = int(b[0])
        out += code(dc, abs(d).bit_length()) + number(d, abs(d).bit_length())
    found = head + scan(0, 0, 0, 0, out)
    out = ""
    for b in blocks:
        run = 0
        shifted = [int(np.sign(v)) * (abs(int(v)) >> low) for v in b]
        last = max((k for k in range(1, 64) if shifted[k]), default=0)
        for k in range(1, last + 1):
            if not shifted[k]:
                run += 1
                continue
            while run > 15:
                out, run = out + code(ac, 0xF0), run - 16
            s = abs(shifted[k]).bit_length()
            out, run = out + code(ac, run << 4 | s) + number(shifted[k], s), 0
        if last < 63:
            out += code(ac, 0)
    found += scan(1, 63, 0, low, out)
    if with_refinement:
        out = ""
        for b in blocks:
            old = [abs(int(v)) >> 1 for v in b]
            run, waiting = 0, ""
            new = [k for k in range(1, 64) if not old[k] and b[k]]
            last = max(new, default=0)
            for k in range(1, last + 1):
                if old[k]:
                    waiting += str(abs(int(b[k])) & 1)
                elif b[k]:
                    out += code(ac, run << 4 | 1) + ("1" if b[k] > 0 else "0") + waiting
                    run, waiting = 0, ""
                elif run == 15:
                    out += code(ac, 0xF0) + waiting
                    run, waiting = 0, ""
                else:
                    run += 1
            if last < 63:
                out += code(ac, 0) + "".join(str(abs(int(b[k])) & 1) for k in range(last + 1, 64) if old[k])
        found += scan(1, 63, 1, 0, out)
    return found + b"\xff\xd9"


@pytest.mark.parametrize("with_refinement", [False, True])
def test_files_of_variable_width(with_refinement):
    rng = np.random.default_rng(7)
    blocks = (rng.integers(-60, 61, (20, 64)) * (rng.random((20, 64)) < 0.3)).astype(np.int16)
    blocks[3, 1:] = 0
    blocks[4, 1:63] = 0
    blocks[:, 5] = rng.integers(-1, 2, 20)
    other = blocks[::-1][:7].copy()
    files = [J.Reader(scans(b, with_refinement)) for b in (blocks, other)]
    J.read(files)
    assert (files[0].parts[0].blocks == blocks).all() and (files[1].parts[0].blocks == other).all()


def test_inverse_transform_by_definition():
    rng = np.random.default_rng(8)
    blocks = np.zeros((2, 64), np.int16)
    blocks[:, [0, 1, 2, 5, 9]] = rng.integers(-200, 200, (2, 5))
    found = read(scans(blocks, False)).rgb()
    natural = np.zeros((2, 64))
    natural[:, J.zigzag()] = blocks
    for k, f in enumerate(natural.reshape(2, 8, 8)):
        for y in range(8):
            for x in range(8):
                v = sum((0.5**0.5 if not a else 1) * (0.5**0.5 if not b else 1) / 4 * f[a, b] * np.cos((2 * y + 1) * a * np.pi / 16) * np.cos((2 * x + 1) * b * np.pi / 16) for a in range(8) for b in range(8))
                assert abs(float(found[y, 8 * k + x, 0]) - min(255, max(0, v + 128))) <= 0.51


def test_frames(spark):
    rows = [(1, "abc"), (2, None), (None, ""), (4, "é" * 5000), (1, "abc")]
    df = spark.createDataFrame([(a, b, b"x") for a, b in rows], "doc_id long, text string, media binary")
    got = sorted((r.asDict() for r in J.summary(df).collect()), key=str)
    for r, (d, t) in zip(got, sorted(rows, key=lambda x: str({"doc_id": x[0], "n_bytes": len((x[1] or "").encode())})), strict=True):
        raw = J.padded((t or "").encode())
        assert (r["doc_id"], r["n_bytes"], r["payload_bytes"]) == (d, len((t or "").encode()), len(raw))
        assert r["payload_sha256"] == hashlib.sha256(raw).hexdigest() and r["tail_crc32"] == zlib.crc32(raw[-64:])
    files = J.media(df)
    back = {(r.doc_id, r.frame, bytes(r.payload), len(r.rgb) == r.height * r.width * 3) for r in J.tensors(files).collect()}
    assert back == {(d, 0, J.padded((t or "").encode()), True) for d, t in rows}
    assert J.summary(df.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = J.op9_progressive_jpeg(spark, d).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        raw = J.padded(docs[r.doc_id])
        media = b"".join(J.encode([raw[at : at + J.FRAME]])[0] for at in range(0, len(raw), J.FRAME))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(docs[r.doc_id]), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        f = read(media)
        rgb = f.rgb().reshape(-1, 3).astype(object)
        n, total, squares = len(rgb), rgb.sum(axis=0), (rgb * rgb).sum(axis=0)
        assert r.feature == f"1x{n};" + ",".join(str(t * 100 // n) for t in total) + ";" + ",".join(str((q * n - t * t) * 100 // (n * n)) for q, t in zip(squares, total))
