"""Word sequences as arrays of 64-bit hashes, and hashes of their n-grams."""

from __future__ import annotations

import numpy as np

from loomgraph.llm.common import worker_cache

BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
ONE = np.uint64(1)
#: Bytes that are hashed at once (more only where a word is longer).
SLICE = 1 << 21
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(text: str | None) -> list[bytes]:
    """The maximal runs of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return."""
    return (text or "").encode().split()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the first base and of its inverse, kept by the worker."""
    kept = worker_cache()
    if len(kept.get("powers", ((),))[0]) < n:
        n = max(n, 1 << 14)
        base, inverse = BASES[0], np.uint64(pow(int(BASES[0]), -1, 1 << 64))
        kept["powers"] = tuple(np.cumprod(np.concatenate([[ONE], np.full(n - 1, x)]), dtype=np.uint64) for x in (base, inverse))
    return kept["powers"]


def _letters() -> np.ndarray:
    kept = worker_cache()
    if "letters" not in kept:
        kept["letters"] = mixed(np.arange(1, 257, dtype=np.uint64) * BASES[1])
    return kept["letters"]


def hashed(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over random values of its bytes, all words of a slice at once."""
    out, at = [], 0
    while at < len(raw):
        end = len(raw)
        if end - at > SLICE:
            found = [k for k in (raw.find(bytes([c]), at + SLICE) for c in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)) if k >= 0]
            end = min(found, default=end)
        b = np.frombuffer(raw, np.uint8, end - at, at)
        inside = np.zeros(len(b) + 2, np.int8)
        inside[1:-1] = ~SPACE[b]
        edge = np.diff(inside)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = powers(len(b) + 1)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_letters()[b] * up[: len(b)], out=sums[1:], dtype=np.uint64)
        out.append(mixed((sums[last] - sums[first]) * down[first]))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that scatters them."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.full(len(h) - n + 1, np.uint64(n))
    for k in range(n):
        out = mixed(out * BASES[0] + h[k : len(h) - n + 1 + k])
    return out


class Spans:
    """Hashes of any span of a word sequence, by prefix sums over powers of an odd base."""

    def __init__(self, h: np.ndarray):
        self.sums, self.powers = [], []
        for base in BASES:
            inverse = np.uint64(pow(int(base), -1, 1 << 64))
            up = np.cumprod(np.concatenate([[ONE], np.full(len(h), base)]), dtype=np.uint64)
            down = np.cumprod(np.concatenate([[ONE], np.full(len(h), inverse)]), dtype=np.uint64)
            self.sums.append(np.concatenate([[np.uint64(0)], np.cumsum(mixed(h ^ base) * down[:-1], dtype=np.uint64)]))
            self.powers.append(up)

    def of(self, start: np.ndarray, size: np.ndarray | int, which: int) -> np.ndarray:
        total = (self.sums[which][start + size] - self.sums[which][start]) * self.powers[which][start]
        return mixed(total + np.asarray(size).astype(np.uint64) * BASES[which])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive values, by doubling."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[: len(x) - done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x
