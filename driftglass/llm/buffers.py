"""Array views of Arrow text columns, and hashes computed over whole columns at once.

Texts are handled as UTF-8 bytes in pieces of at most about PIECE bytes, so that a task's memory does not depend on how
many rows an Arrow batch holds. Polynomial hashes come from prefix sums, so any substring's hash is one subtraction and one
product: `span_hash`, modulo 2**64, is quick and serves for features and for choosing places; where equal hashes decide
that texts are equal, `sound_hash` takes two polynomials modulo the prime 2**31 - 1, as ones modulo a power of two have
structured collisions. Words and lines are digested by a cryptographic hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 19
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_rng = np.random.default_rng(7919)
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; base is odd."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, PIECE + 4096)
        inverse = pow(base, -1, 2**64)
        out = []
        for b in (base, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        have = _powers[base] = (out[0], out[1])
    return have


def prefix_sums(values: np.ndarray, base: int) -> np.ndarray:
    """s of len(values) + 1, for span_hash."""
    forward, _ = powers(base, len(values) + 1)
    s = np.empty(len(values) + 1, np.uint64)
    s[0] = 0
    np.cumsum(values * forward[: len(values)], dtype=np.uint64, out=s[1:])
    return s


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of the bytes from start to end, whatever stands around them."""
    _, backward = powers(base, len(sums))
    return mix((sums[end] - sums[start]) * backward[start] + (end - start).astype(np.uint64))


PRIME = np.uint64(2**31 - 1)
LANES = [(1_103_515_245, _rng.integers(1, 2**31 - 1, 256, dtype=np.uint64)), (1_812_433_253, _rng.integers(1, 2**31 - 1, 256, dtype=np.uint64))]
_lane_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def fold(x: np.ndarray) -> np.ndarray:
    """Congruent modulo PRIME; below 2**33 for any x, and at most 2**31 if x is."""
    return (x & PRIME) + (x >> np.uint64(31))


def lane_powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo PRIME for i < n."""
    have = _lane_powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, PIECE // 2)
        out = []
        for b in (base, pow(base, -1, int(PRIME))):
            p, known = np.ones(size, np.uint64), 1
            while known < size:  # doubles what is known
                step, more = np.uint64(pow(b, known, int(PRIME))), min(known, size - known)
                p[known : known + more] = p[:more] * step % PRIME
                known += more
            out.append(p)
        have = _lane_powers[base] = (out[0], out[1])
    return have


def sound_sums(data: np.ndarray) -> list[np.ndarray]:
    """For sound_hash: prefix sums of both polynomials. They stay below 2**64 up to 2**31 bytes."""
    out = []
    for base, values in LANES:
        s = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(fold(fold(values[data] * lane_powers(base, len(data) + 1)[0][: len(data)])), out=s[1:])
        out.append(s)
    return out


def sound_hash(sums: list[np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """62 bits of the bytes from start to end, mixed."""
    h = []
    for (base, _), s in zip(LANES, sums):
        x = (s[end] - s[start]) % PRIME
        h.append(x * lane_powers(base, len(s))[1][start] % PRIME)
    return mix((h[0] << np.uint64(31)) + h[1])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column as bytes and row offsets (rows + 1); a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def row_pieces(offsets: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most about `most` bytes; a longer row comes alone."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


class WordHashes(dict):
    """64 bits of a cryptographic digest for each word asked for; forgets all when it has grown to `most` words."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def word_hashes(data: np.ndarray, offsets: np.ndarray, known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of rows, A-Z lower-cased, and the bounds of the rows (rows + 1).

    Words are maximal runs of bytes other than white space: what bytes.split() gives."""
    found = [np.concatenate([np.zeros(0, np.uint64), *text_hashes(data[a:b], known)]) for a, b in zip(offsets, offsets[1:])]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    return np.concatenate([np.zeros(0, np.uint64), *found]), np.append(0, np.cumsum(sizes))


def text_hashes(text: np.ndarray, known: WordHashes) -> Iterator[np.ndarray]:
    """The hashes of a text's words, of PIECE bytes at a time; a word that a piece's end cuts is left to the next."""
    left = b""
    for a in range(0, len(text), PIECE):
        piece = left + text[a : a + PIECE].tobytes().lower()
        words = piece.split()
        left = words.pop() if a + PIECE < len(text) and not piece[-1:].isspace() else b""
        yield np.fromiter((known[w] for w in words), np.uint64, len(words))
