"""Vectorised text work on Arrow string columns: numpy on the UTF-8 bytes, no Python string per word.

Rows are cut into slices of at most ``SLICE_BYTES`` (a longer text is a slice of its own), so memory
depends on the slice and the longest text, not on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
SPACE, WORD, MARK = 0, 1, 2

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)  # a random value per byte
_BASE = 0x9E3779B97F4A7C13 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_STEP = np.uint64(0xD1342543DE82EF95)
_powers: dict[int, np.ndarray] = {}

#: ASCII white space separates words.
SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Bytes as parts of a token: white space, letters and digits (and all of UTF-8 above ASCII), marks.
KINDS = np.full(256, MARK, dtype=np.uint8)
KINDS[SPACES] = SPACE
KINDS[128:] = WORD
for _a, _b in (("0", "9"), ("A", "Z"), ("a", "z")):
    KINDS[ord(_a):ord(_b) + 1] = WORD


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of consecutive row ranges; nulls are empty."""
    arr = pc.fill_null(texts.cast(pa.large_string()), "")
    if len(arr) == 0:
        return
    _, off, data = arr.buffers()
    offs = np.frombuffer(off, dtype=np.int64)[arr.offset:arr.offset + len(arr) + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < len(arr):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, j, buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        i = j


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return np.where((buf >= 65) & (buf <= 90), buf + 32, buf)


def _edges(inside: np.ndarray, same: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs: ``same[i]`` says that byte i goes on with the run of byte i - 1."""
    joined = same.copy()
    joined[offs[:-1][offs[:-1] < len(joined)]] = False
    starts = np.flatnonzero(inside & ~joined)
    after = np.ones(len(joined), dtype=bool)
    after[:-1] = ~joined[1:]
    return starts, np.flatnonzero(inside & after) + 1


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every white-space separated word."""
    inside = ~SPACES[buf]
    same = np.zeros(len(buf), dtype=bool)
    same[1:] = inside[1:] & inside[:-1]
    starts, ends = _edges(inside, same, offs)
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of letters and digits and of every single mark."""
    kind = KINDS[buf]
    same = np.zeros(len(buf), dtype=bool)
    same[1:] = (kind[1:] == WORD) & (kind[:-1] == WORD)
    starts, ends = _edges(kind != SPACE, same, offs)
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, n)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * SLICE_BYTES:  # powers for a huge text are not kept
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, from prefix sums of a polynomial over the bytes."""
    if len(starts) == 0:
        return np.zeros(0, dtype=np.uint64)
    sums = np.empty(len(buf) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[buf] * _power(_BASE, len(buf)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power(_INVERSE, len(buf))[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _STEP)


def windows(word_hash: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every k-word window; a row with fewer words has one window of all of them."""
    count = np.bincount(row, minlength=n_rows)
    n = len(word_hash)
    h, r = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    if n >= k:
        acc = word_hash[:n - k + 1].copy()
        for i in range(1, k):
            acc *= _STEP
            acc += word_hash[i:n - k + 1 + i]
        ok = row[:n - k + 1] == row[k - 1:]
        h, r = mix(acc[ok] + np.uint64(k)), row[:n - k + 1][ok]
    first = np.concatenate([[0], np.cumsum(count)[:-1]]) if n_rows else np.zeros(0, dtype=np.int64)
    for m in range(1, k):
        short = np.flatnonzero(count == m)
        if len(short):
            acc = word_hash[first[short]].copy()
            for i in range(1, m):
                acc *= _STEP
                acc += word_hash[first[short] + i]
            h, r = np.concatenate([h, mix(acc + np.uint64(m))]), np.concatenate([r, short])
    order = np.argsort(r, kind="stable")
    return h[order], r[order]


def code_points(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the rows and their offsets."""
    raw = buf.tobytes()
    try:
        cp = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        heads = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
        return cp, heads[offs]
    except UnicodeDecodeError:
        rows = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offs[:-1], offs[1:])]
        cp = np.frombuffer("".join(rows).encode("utf-32-le"), dtype=np.uint32)
        return cp, np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
