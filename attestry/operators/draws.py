"""Random words for resamples: MD5 digests of `seed:resample:range:counter`, many at a time.

A digest of so short a text is one block of MD5, whose steps are the same for every
text, so that numpy takes each step for thousands of counters at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

#: Digests worked out at once; their words stay in a core's cache.
LANES = 16_384
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_ADDED = [int(abs(math.sin(i + 1)) * (1 << 32)) for i in range(64)]


def md5_blocks(words: list[np.ndarray | int], n: int) -> list[np.ndarray]:
    """The four words of the MD5 digests of n padded blocks of 16 words; a word that all blocks share is an int."""
    a, b, c, d = (np.full(n, x, dtype=np.uint32) for x in _START)
    f = np.empty(n, dtype=np.uint32)
    for i in range(64):
        kind = i // 16
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
        a += f
        word = words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[kind] % 16]
        if isinstance(word, np.ndarray):
            a += word
            word = 0
        a += np.uint32((_ADDED[i] + word) & 0xFFFFFFFF)
        turn = _TURNS[kind][i % 4]
        np.left_shift(a, np.uint32(turn), out=f)
        a >>= np.uint32(32 - turn)
        a |= f
        a += b
        a, b, c, d = d, a, b, c
    return [x + np.uint32(s) for x, s in zip((a, b, c, d), _START, strict=True)]


def _counters(start: int, n: int) -> np.ndarray:
    """(16, n): the words of blocks whose text is `start` bytes left blank and then a counter from 0."""
    blocks = b"".join((b"\0" * start + b"%d\x80" % w).ljust(56, b"\0") + (8 * (start + len(str(w)))).to_bytes(8, "little") for w in range(n))
    return np.ascontiguousarray(np.frombuffer(blocks, dtype="<u4").reshape(n, 16).T)


def digest_words(seed: int, resamples: np.ndarray, at: int, counts: np.ndarray) -> Iterator[tuple[slice, list[np.ndarray]]]:
    """For runs of the resamples, four arrays (resample, counter): words 0 to 3 of the digests, big-endian, of as many counters as the run's largest count needs.

    `resamples` ascend; a resample's words are those of the counters' digests in turn, and it needs counts[i] of them.
    """
    after, counters, i = None, None, 0
    digits = np.char.str_len(resamples.astype(str))
    while i < len(resamples):
        start = len(b"%d:%d:%d:" % (seed, resamples[i], at))
        if after != start:  # all resamples of as many digits
            alike = i + int((digits[i:] == digits[i]).sum())
            after, counters = start, _counters(start, max(1, -(-int(counts[i:alike].max()) // 4)))
        some = slice(i, min(alike, i + max(1, LANES // max(1, counters.shape[1]))))
        n = -(-int(counts[some].max()) // 4)
        prefixes = np.frombuffer(b"".join((b"%d:%d:%d:" % (seed, b, at)).ljust(64, b"\0") for b in resamples[some].tolist()), dtype="<u4").reshape(-1, 16)
        words = []
        for k in range(16):
            p, w = prefixes[:, k], counters[k, :n]
            alone = (p == p[0]).all() and not w.any()
            words.append(int(p[0]) if alone else (p[:, None] | w[None, :]).ravel())
        yield some, [x.byteswap().reshape(len(prefixes), n) for x in md5_blocks(words, len(prefixes) * n)]
        i = some.stop
