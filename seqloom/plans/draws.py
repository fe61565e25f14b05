"""The draws of ``plans.nulls`` on arrays, for many permutations of one small group: md5 of all its keys at once."""

from __future__ import annotations

import hashlib
import math

import numpy as np

_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
#: Keys that are hashed together: what the rounds touch stays in the cache.
STEP = 1 << 14


def _digits(numbers: np.ndarray, width: int) -> np.ndarray:
    return (numbers[:, None] // 10 ** np.arange(width - 1, -1, -1) % 10 + 48).astype(np.uint8)


def _halves(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The md5 of messages of one block (16 words each), as two big-endian halves that order like the hex digest."""
    start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(words[0].shape, x, np.uint32) for x in start)
    for i in range(64):
        turn, k = i // 16, (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16
        f = d ^ (b & (c ^ d)) if turn == 0 else c ^ (d & (b ^ c)) if turn == 1 else b ^ c ^ d if turn == 2 else c ^ (b | ~d)
        f += a
        f += words[k]
        f += _SINES[i]
        s = np.uint32(_TURNS[turn][i % 4])
        a, d, c, b = d, c, b, b + ((f << s) | (f >> (np.uint32(32) - s)))
    out = [(x + y).byteswap().astype(np.uint64) for x, y in zip((a, b, c, d), start)]
    return out[0] << np.uint64(32) | out[1], out[2] << np.uint64(32) | out[3]


def _keys(seed: int, perms: np.ndarray, group: str, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of nulls.draw_key(seed, perm, group, item), perms by items."""
    high, low = np.empty((len(perms), len(items)), np.uint64), np.empty((len(perms), len(items)), np.uint64)
    middle = f"|{group}|".encode()
    width = lambda x: np.char.str_len(x.astype(str))
    of_perm, of_item = width(perms), width(items)
    head = f"{seed}|".encode()
    for p in map(int, np.unique(of_perm)):
        for q in map(int, np.unique(of_item)):
            rows, cols = np.flatnonzero(of_perm == p), np.flatnonzero(of_item == q)
            n = len(head) + p + len(middle) + q
            if n > 55:
                for r in rows:
                    found = [hashlib.md5(head + str(perms[r]).encode() + middle + str(items[c]).encode()).digest() for c in cols]
                    high[r, cols] = [int.from_bytes(x[:8], "big") for x in found]
                    low[r, cols] = [int.from_bytes(x[8:], "big") for x in found]
                continue
            each = max(1, STEP // len(cols))
            for at in range(0, len(rows), each):
                some = rows[at : at + each]
                text = np.zeros((len(some), len(cols), 64), np.uint8)
                text[:, :, : len(head)] = np.frombuffer(head, np.uint8)
                text[:, :, len(head) : len(head) + p] = _digits(perms[some], p)[:, None, :]
                text[:, :, len(head) + p : n - q] = np.frombuffer(middle, np.uint8)
                text[:, :, n - q : n] = _digits(items[cols], q)[None]
                text[:, :, n] = 0x80
                text[:, :, 56:58] = np.frombuffer((n * 8).to_bytes(2, "little"), np.uint8)
                words = text.view("<u4")
                one, two = _halves([np.ascontiguousarray(words[:, :, k]) for k in range(16)])
                high[np.ix_(some, cols)], low[np.ix_(some, cols)] = one, two
    return high, low


def order(seed: int, perms: np.ndarray, group: str, items: np.ndarray) -> np.ndarray:
    """For each permutation the places of ``items`` (in ascending order) in the order of their draw."""
    high, low = _keys(seed, perms, group, items)
    out = np.argsort(high, axis=1, kind="stable")
    ranked = np.take_along_axis(high, out, 1)
    for r in np.flatnonzero((ranked[:, 1:] == ranked[:, :-1]).any(axis=1)):
        out[r] = np.lexsort((low[r], high[r]))
    return out


def turns(seed: int, perms: np.ndarray, group: str, n: int) -> np.ndarray:
    """For each permutation the places that ``n`` values come from when they are turned by its offset."""
    offset = [1 + int(hashlib.md5(f"{seed}|{p}|{group}".encode()).hexdigest()[:8], 16) % (n - 1) if n > 1 else 0 for p in perms]
    return (np.arange(n)[None] - np.array(offset)[:, None]) % n
