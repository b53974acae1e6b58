"""Random numbers as functions of a key: the same for any order of rows, any partitioning and any engine with MD5."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 4294967296.0


def bits(*key) -> Column:
    """32 bits of a key, as a long. Parts are columns or plain values."""
    parts = [k if isinstance(k, Column) else F.lit(k) for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("long")


def uniform(*key) -> Column:
    """In [0, 1)."""
    return bits(*key) / F.lit(STEPS)


def inner(*key) -> Column:
    """In (0, 1), for logarithms."""
    return (bits(*key) + 0.5) / F.lit(STEPS)


def normal(*key) -> Column:
    """Standard normal, by the polar angle and radius of two uniforms."""
    return F.sqrt(-2 * F.ln(inner(*key, 0))) * F.cos(2 * math.pi * uniform(*key, 1))


def student(df, *key) -> Column:
    """Student's t of unit variance; df over 2, not necessarily whole."""
    df = df if isinstance(df, Column) else F.lit(float(df))
    raw = F.sqrt(df * (F.pow(inner(*key, 0), -2 / df) - 1)) * F.cos(2 * math.pi * uniform(*key, 1))
    return raw / F.sqrt(df / (df - 2))


def index(n: Column, *key) -> Column:
    """In 0 to n - 1."""
    return F.floor(uniform(*key) * n).cast("long")


# MD5 of many strings at once, for tasks that draw or deal by the million: hashlib takes a string and a call for each.
SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
PLACES = (lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: 7 * i % 16)
ROOT, ONES, AT_ONCE = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476), 0xFFFFFFFF, 1 << 14


def mixed(turn: int, b: np.ndarray, c: np.ndarray, d: np.ndarray, out: np.ndarray) -> None:
    if turn == 2:
        np.bitwise_xor(np.bitwise_xor(b, c, out=out), d, out=out)
    elif turn == 3:
        np.bitwise_xor(np.bitwise_or(np.invert(d, out=out), b, out=out), c, out=out)
    else:
        x, y, z = (c, d, b) if turn == 0 else (b, c, d)
        np.bitwise_xor(np.bitwise_and(np.bitwise_xor(x, y, out=out), z, out=out), y, out=out)


def md5(prefix: bytes, tails: np.ndarray) -> list[np.ndarray]:
    """The four words (least byte first) of the MD5 of prefix + tail for each row of tails (bytes, all of one length).

    Words of a message that hold no byte of a tail are plain numbers, and the steps before the first that does are done once."""
    first, length = len(prefix), len(prefix) + tails.shape[1]
    whole = prefix + bytes(tails.shape[1]) + b"\x80"
    whole += bytes(-(len(whole) + 8) % 64) + (8 * length).to_bytes(8, "little")
    words: list = np.frombuffer(whole, "<u4").tolist()
    low, high = first // 4, -(-length // 4)
    held = np.empty((len(tails), 4 * (high - low)), np.uint8)
    held[:] = np.frombuffer(whole, np.uint8)[4 * low : 4 * high]
    held[:, first - 4 * low : length - 4 * low] = tails
    words[low:high] = np.ascontiguousarray(held.view("<u4").T)
    state = [np.full(1, w, np.uint32) for w in ROOT]
    for block in range(0, len(words), 16):
        a, b, c, d = (x.copy() for x in state)
        f, up = np.empty_like(a), np.empty_like(a)
        for i in range(64):
            turn, word = i // 16, words[block + PLACES[i // 16](i)]
            plain = isinstance(word, int)
            if not plain and len(a) < len(tails):
                a, b, c, d = (np.repeat(x, len(tails)) for x in (a, b, c, d))
                f, up = np.empty_like(a), np.empty_like(a)
            mixed(turn, b, c, d, f)
            np.add(f, a, out=f)
            if not plain:
                np.add(f, word, out=f)
            np.add(f, np.uint32((SINES[i] + (word if plain else 0)) & ONES), out=f)
            by = TURNS[turn][i % 4]
            np.left_shift(f, np.uint32(by), out=up)
            np.right_shift(f, np.uint32(32 - by), out=f)
            np.bitwise_or(f, up, out=f)
            np.add(f, b, out=a)
            a, b, c, d = d, a, b, c
        state = [x + y for x, y in zip(state, (a, b, c, d))]
    return [np.broadcast_to(x, len(tails)).astype(np.uint32) for x in state]


def digits(first: int, last: int, most: int = AT_ONCE) -> Iterator[tuple[int, np.ndarray]]:
    """The numbers from first to last - 1 as rows of their digits, in pieces of one length and of `most` numbers: (first of the piece, rows)."""
    while first < last:
        size = len(str(first))
        end = min(last, 10**size, first + most)
        places = 10 ** np.arange(size - 1, -1, -1)
        yield first, (np.arange(first, end)[:, None] // places % 10 + 48).astype(np.uint8)
        first = end


def hashes(prefix: str, first: int, last: int, middle: str, tails: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The words (numbers read from the left) of the MD5 of prefix, number, middle and tail: for pieces of the numbers from first to last - 1 (first of the
    piece, words by number and tail)."""
    between = np.frombuffer(middle.encode(), np.uint8)
    for at, numbers in digits(first, last, max(1, AT_ONCE // max(1, len(tails)))):
        if len(numbers) == 1:
            found = md5(prefix.encode() + numbers.tobytes() + between.tobytes(), tails)
        else:
            parts = [numbers[:, None], between[None, None], tails[None]]
            shape = (len(numbers), len(tails))
            rows = np.concatenate([np.broadcast_to(p, (*shape, p.shape[-1])) for p in parts], axis=2)
            found = md5(prefix.encode(), rows.reshape(-1, rows.shape[-1]))
        yield at, [np.ascontiguousarray(w.byteswap()).reshape(len(numbers), -1) for w in found]


def indexes(n: int, prefix: str, first: int, last: int, middle: str, low: int, high: int) -> np.ndarray:
    """What `index` gives for n and the keys prefix, number, middle, slot: a row for each number from first to last - 1, a column
    for each slot from low to high - 1."""
    out = np.empty((last - first, high - low), np.int64)
    for slot, tails in digits(low, high):
        for at, words in hashes(prefix, first, last, middle, tails):
            found = np.floor(words[0] / STEPS * n)
            out[at - first : at - first + len(found), slot - low : slot - low + len(tails)] = found
    return out
