"""Vectorised hashing of words and byte windows over many texts at once (numpy, inside tasks).

Bytes b[s:e] are hashed in blocks of BLOCK bytes from s on. A block's value is a polynomial in an odd base modulo
2**64 over random numbers for the bytes; one prefix sum over a chunk gives that of any block. Each block's value is
mixed into the state before the next comes, and the length takes part: a polynomial over the whole string would be
linear, and strings built for it (such as a Thue-Morse word and its complement, from 1024 characters on) would
collide in any odd base.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_MASK = (1 << 64) - 1
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def splitmix(seed: int, n: int) -> np.ndarray:
    x = (np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15)) + U(seed & _MASK)
    return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n (at least)."""
    have = _tables.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up = np.full(size, base & _MASK, U)
        down = np.full(size, pow(base, -1, 1 << 64), U)
        up[0] = down[0] = 1
        have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        if size <= 1 << 21:
            _tables[base] = have
    return have


#: Each seed has its own base and its own numbers for the bytes.
_BASES = {11: 0x9E3779B97F4A7C15, 23: 0xC2B2AE3D27D4EB4F}
_BYTES = {seed: splitmix(seed, 256) for seed in _BASES}
_LENGTH, _CHAIN = U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)
BLOCK = 32


class Prefix:
    """Substring hashes over one buffer."""

    def __init__(self, buf: np.ndarray, seed: int = 11):
        n = len(buf)
        up, self.down = powers(n + 1, _BASES[seed])
        self.sums = np.zeros(n + 1, U)
        np.cumsum(_BYTES[seed][buf] * up[:n], out=self.sums[1:])

    def _block(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of buf[start:end] for each pair; the length takes part."""
        size = ends - starts
        out = mix(self._block(starts, np.minimum(ends, starts + BLOCK)) ^ (size.astype(U) * _LENGTH))
        more = np.flatnonzero(size > BLOCK)
        at, stop = starts[more] + BLOCK, ends[more]
        while len(more):
            out[more] = mix(out[more] * _CHAIN + self._block(at, np.minimum(stop, at + BLOCK)))
            at = at + BLOCK
            on = at < stop
            if not on.all():
                more, at, stop = more[on], at[on], stop[on]
        return out

    def windows(self, width: int, block: int = BLOCK) -> np.ndarray:
        """Hash of buf[i:i+width] for every i that has one (not for lengths that differ).

        block = width is quicker, for uses in which a collision costs work only.
        """
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, U)
        out = None
        for at in range(0, width, block):
            step = min(block, width - at)
            part = (self.sums[at + step : at + step + n] - self.sums[at : at + n]) * self.down[at : at + n]
            out = mix(part if out is None else out * _CHAIN + part)
        return out


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of every text: byte starts, byte ends, text number of each word."""
    n = len(buf)
    inside = ~_SPACE[buf]
    first, last = inside.copy(), np.zeros(n + 1, bool)
    first[1:] &= ~inside[:-1]
    last[1:] = inside
    last[1:n] &= ~inside[1:]
    # a word ends where its text ends, and the next text's first byte starts another
    some = starts[starts < ends]
    first[some] |= inside[some]
    stop = ends[starts < ends]
    last[stop] |= inside[stop - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last)
    return s, e, np.searchsorted(ends, s, side="right")


def runs_within(group: np.ndarray, width: int) -> np.ndarray:
    """Positions i for which group[i:i+width] is one group (group is sorted)."""
    n = len(group) - width + 1
    return np.flatnonzero(group[:n] == group[width - 1 :]) if n > 0 else np.zeros(0, np.int64)
