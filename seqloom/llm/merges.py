"""Byte-level BPE of many short words at once, in arrays: what the tokenizers library does word by word, for words that need no more.

Every step merges, in each piece that still has a pair to merge, its pair of the lowest rank, the leftmost of these.
"""

from __future__ import annotations

import json
import unicodedata
from itertools import compress

import numpy as np

#: Characters of the longest word that is encoded here, and words in one step.
LONGEST, BLOCK = 64, 8192
_MIX = np.uint64(0x9E3779B97F4A7C15)
_NONE, _LOW = (1 << 31) - 1, (1 << 32) - 1
_ODD, _LETTER, _NUMBER, _OTHER, _SPACE, _CUT = range(6)


def _kinds() -> np.ndarray:
    """The class of each character below U+10000 in the splitting expression; odd: the apostrophe, controls, what Unicode 3.2 had otherwise."""
    of = {"L": _LETTER, "N": _NUMBER, "P": _OTHER, "S": _OTHER, "M": _OTHER}
    now, then = unicodedata.category, unicodedata.ucd_3_2_0.category
    out = np.array([of.get(now(c)[0], _ODD) if now(c)[0] == then(c)[0] else _ODD for c in map(chr, range(1 << 16))] + [_ODD], np.uint8)
    out[[9, 10, 13]], out[ord("'")] = _SPACE, _ODD
    return out


def _letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(k if k in own else next(rest)) for k in range(256)]


class Merges:
    """Ranks of the pairs in an open hash table. ``read`` gives None for a tokenizer that does more than split, map bytes and merge."""

    def __init__(self, vocab: dict[str, int], pairs: list):
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in pairs]
        pairs = list({p: (p, k) for k, p in enumerate(pairs)}.values())  # the later rank counts where a pair comes twice
        rank = np.array([k for _, k in pairs], np.int64)
        self.made = np.zeros(rank.max(initial=0) + 1, np.int64)
        self.made[rank] = [vocab[a + b] for (a, b), _ in pairs]
        self.byte = np.array([vocab[c] for c in _letters()], np.int64)
        self.blank = max(vocab.values()) + 1
        bits = max(8, (4 * len(pairs)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.rank = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int64)
        key = np.array([vocab[a] << 32 | vocab[b] for (a, b), _ in pairs], np.int64)
        at = self._slot(key)
        while len(key):
            free = np.flatnonzero(self.keys[at] < 0)
            slots, first = np.unique(at[free], return_index=True)
            self.keys[slots], self.rank[slots] = key[free[first]], rank[free[first]]
            left = self.keys[at] != key
            key, rank, at = key[left], rank[left], (at[left] + 1) & self.last
        both = np.arange(1 << 16)
        self.first = self.ranks(self.byte[both >> 8], self.byte[both & 255])
        self.kinds = _kinds()

    @classmethod
    def read(cls, path: str) -> Merges | None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        plain = plain and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        plain = plain and not spec.get("normalizer") and all(t.get("special") for t in spec.get("added_tokens") or ())
        return cls(model["vocab"], model["merges"]) if plain and all(c in model["vocab"] for c in _letters()) else None

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * _MIX >> self.shift).view(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, ``_NONE`` where they don't merge."""
        key = a << 32 | b
        at = self._slot(key)
        found = self.keys[at]
        out = np.where(found == key, self.rank[at], _NONE)
        more = np.flatnonzero((found != key) & (found >= 0))
        while len(more):
            at[more] = step = (at[more] + 1) & self.last
            found, own = self.keys[step], key[more]
            out[more] = np.where(found == own, self.rank[step], _NONE)
            more = more[(found != own) & (found >= 0)]
        return out

    def _merged(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An id at each byte of the pieces that begin at ``starts``, and whether the byte begins a token. Other ids mean nothing."""
        n = len(raw)  # also the place after the last byte, which stands for no token
        ends = np.append(starts[1:], n) - 1
        ids, after, before = np.append(self.byte[raw], self.blank), np.arange(1, n + 2), np.arange(-1, n)
        after[ends] = after[n] = before[starts] = n
        begins = np.ones(n, bool)
        rank = np.full(n + 1, _NONE)
        rank[: n - 1] = self.first[raw[:-1].astype(np.int64) << 8 | raw[1:]]
        rank[ends] = _NONE
        spot = np.arange(n + 1)  # where in ``key`` a byte's pair is
        key = rank << 32 | spot
        while len(starts):
            low = np.minimum.reduceat(key[:-1], starts)
            live = low >> 32 < _NONE
            if 4 * np.count_nonzero(live) < 3 * len(live):
                sizes = np.diff(np.append(starts, len(key) - 1))
                key = key[np.append(np.repeat(live, sizes), True)]
                spot[key & _LOW] = np.arange(len(key))
                sizes = sizes[live]
                starts = np.cumsum(sizes) - sizes
            low = low[live]
            at = low & _LOW
            gone, left = after[at], before[at]
            right = after[gone]
            ids[at] = new = self.made[low >> 32]
            after[at], before[right], begins[gone] = right, at, False
            key[spot[gone]] = _NONE << 32 | gone
            key[spot[at]] = self.ranks(new, ids[right]) << 32 | at
            key[spot[left]] = self.ranks(ids[left], new) << 32 | left
        return ids[:n], begins

    def encode(self, words: list[str]) -> tuple[list[str], list[bytes]]:
        """Those of the words, none with a space, that can be encoded here, each after a space, and their ids as 32-bit bytes."""
        text = " " + " ".join(words)
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kinds = self.kinds[np.minimum(chars, 1 << 16)]
        kinds[chars == 32] = _CUT
        heads = np.flatnonzero(kinds == _CUT)
        then, past = np.append(kinds[1:], _CUT), np.append(_CUT, kinds[:-1])
        bad = (kinds == _ODD) | (kinds == _CUT) & (then == _CUT) | (kinds == _SPACE) & ((then >= _SPACE) | (past >= _SPACE))
        good = ~np.logical_or.reduceat(bad, heads)
        if not good.all():
            words = list(compress(words, good.tolist()))
            if not words:
                return [], []
            kept = np.repeat(good, np.diff(np.append(heads, len(chars))))
            chars, kinds, past = chars[kept], kinds[kept], past[kept]
            heads = np.flatnonzero(kinds == _CUT)
        size = 1 + (chars >= 0x80) + (chars >= 0x800)
        place = np.cumsum(size) - size
        raw = np.frombuffer((" " + " ".join(words)).encode(), np.uint8)
        ids, begins = self._merged(raw, place[(kinds == _CUT) | (kinds != past) & (past != _CUT)])
        count = np.append(0, np.cumsum(begins))
        cuts = (4 * count[np.append(place[heads], len(raw))]).tolist()
        packed = ids[begins].astype("<u4").tobytes()
        return words, list(map(packed.__getitem__, map(slice, cuts, cuts[1:])))
