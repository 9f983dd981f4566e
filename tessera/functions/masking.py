"""The mask of text.masked for many texts at once: MD5 of short keys, all words of a batch side by side."""

from __future__ import annotations

import hashlib
from math import floor, sin

import numpy as np

_STEP = np.array([floor(abs(sin(i + 1)) * 2**32) for i in range(64)], np.uint64).astype(np.uint32)
_TURN = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
#: Words at a time: their states stay in the processor's cache.
_SLICE = 8192


def _heads(blocks: np.ndarray) -> np.ndarray:
    """The first 32 bits of the MD5 of each message, which fills one block: the columns of `blocks` (16 rows of uint32)."""
    a, b, c, d = (np.full(blocks.shape[1], x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        kind = i // 16
        # a free choice between two words of the state, by bits
        if kind == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif kind == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif kind == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += _STEP[i]
        f += blocks[(i, 5 * i + 1, 3 * i + 5, 7 * i)[kind] % 16]
        turn = _TURN[kind][i % 4]
        np.right_shift(f, np.uint32(32 - turn), out=g)
        f <<= np.uint32(turn)
        f |= g
        f += b
        a, b, c, d, f = d, f, b, c, a
    return (a + np.uint32(0x67452301)).byteswap()


def uniforms(keys: list[bytes], counts: np.ndarray) -> np.ndarray:
    """For each key its numbers 0 to count - 1, in turn: text.hash_uniform of `key|number`."""
    out = np.empty(int(counts.sum()), np.float64)
    head = np.zeros((len(keys), 64), np.uint8)
    size = np.array([len(k) + 1 for k in keys], np.int64)
    width = len(str(max(0, int(counts.max(initial=0)) - 1)))
    short = size + width <= 55
    for k, key in enumerate(keys):
        if short[k]:
            head[k, : len(key) + 1] = np.frombuffer(key + b"|", np.uint8)
    starts = np.cumsum(counts) - counts
    row = np.repeat(np.arange(len(keys)), counts)
    number = np.arange(len(row)) - starts[row]
    for k in np.flatnonzero(~short):
        out[starts[k] : starts[k] + counts[k]] = [int.from_bytes(hashlib.md5(keys[k] + b"|%d" % n).digest()[:4], "big") / 2**32 for n in range(counts[k])]
    words = np.flatnonzero(short[row])
    for lo in range(0, len(words), _SLICE):
        own = words[lo : lo + _SLICE]
        r, n = row[own], number[own]
        block, at = head[r], size[r]
        digits = np.ones(len(own), np.int64)
        for power in range(1, width):
            digits += n >= 10**power
        every = np.arange(len(own))
        for place in range(width):
            has = place < digits
            block[every[has], at[has] + place] = 48 + n[has] // 10 ** (digits[has] - 1 - place) % 10
        end = at + digits
        block[every, end] = 0x80
        block[every, 56], block[every, 57] = end * 8 & 255, end * 8 >> 8
        out[own] = _heads(np.ascontiguousarray(block.view("<u4").T)) / 4294967296.0
    return out


def masked_words(texts: list[list[bytes]], keys: list[bytes], share: float) -> list[bytes]:
    """Each text's words with a space between, some of them as _: those whose number by key and place is below `share`."""
    counts = np.array([len(w) for w in texts], np.int64)
    gone = np.flatnonzero(uniforms(keys, counts) < share)
    ends = np.cumsum(counts)
    cut = np.searchsorted(gone, ends)
    out, lo = [], 0
    for words, start, hi in zip(texts, (ends - counts).tolist(), cut.tolist(), strict=True):
        words = words.copy()
        for at in (gone[lo:hi] - start).tolist():
            words[at] = b"_"
        out.append(b" ".join(words))
        lo = hi
    return out
