"""Vectorised hashing of the spans of a batch of texts (numpy, one Arrow batch at a time)."""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
_U = np.uint64
# Polynomial hashes count modulo a prime, where no words of two letters (such as Thue-Morse words
# and their complements, which collide modulo 2**64) cancel out for every base.
PRIME = (1 << 61) - 1
_P, _LOW = _U(PRIME), _U(0xFFFFFFFF)
BASES = tuple(int(b) for b in _RNG.integers(1 << 40, PRIME, 2, dtype=np.uint64))

# one small value per byte; the second table takes A-Z as a-z
BYTE = np.arange(1, 257, dtype=np.uint64)
BYTE_LOWER = BYTE.copy()
BYTE_LOWER[65:91] = BYTE[97:123]
LOWER = (BYTE_LOWER - _U(1)).astype(np.uint8)
RANDOM = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
RANDOM_LOWER = RANDOM.copy()
RANDOM_LOWER[65:91] = RANDOM[97:123]
_ODD = 0x9E3779B97F4A7C15
ORDER = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | _U(1)  # weights of the members of a sequence
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_POWERS: dict = {}
_PART = 1 << 15  # positions summed at once: they stay in the processor's cache
_EMPTY = 1 << 9  # empty bins filled at once


def _mod(x):
    x = (x & _P) + (x >> _U(61))
    return np.minimum(x, x - _P)  # below the prime the difference wraps to a large number


def _times(a, b):
    """a * b modulo the prime (both below it), by halves of 32 bits."""
    ah, al, bh, bl = a >> _U(32), a & _LOW, b >> _U(32), b & _LOW
    middle, low = ah * bl + al * bh, al * bl
    # 2**64 is 8 and 2**61 is 1 here
    return _mod(((ah * bh) << _U(3)) + (middle >> _U(29)) + ((middle & _U((1 << 29) - 1)) << _U(32)) +
                (low & _P) + (low >> _U(61)))


def powers(n: int, base: int):
    """base**0 .. base**n modulo the prime."""
    have = _POWERS.get(base)
    if have is None or len(have) <= n:
        have = np.ones(1, np.uint64)
        while len(have) < max(n + 1, 1 << 16):
            have = np.concatenate([have, _times(have, _U(pow(base, len(have), PRIME)))])
        _POWERS[base] = have
    return have[:n + 1]


def mix(x):
    """Finalizer of splitmix64: every input bit moves every output bit."""
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        y = x >> _U(shift)
        y ^= x
        y *= _U(times)
        x = y
    return x ^ (x >> _U(31))


class Prefix:
    """Prefix polynomial hashes of a byte array: equal spans have equal hashes, wherever they stand.

    Without a ``table`` the data are 64-bit values of their own.  ``base`` picks one of two independent hashes.
    """

    def __init__(self, data, table=BYTE, base: int = 0):
        n, base = len(data), BASES[base]
        self.sums = np.zeros(n + 1, np.uint64)
        weights, carry = powers(n, base), _U(0)
        for start in range(0, n, _PART):
            part = slice(start, min(start + _PART, n))
            weight = weights[part]
            if table is None:
                terms = _times(_mod(data[part]), weight)
                low, high = terms & _LOW, terms >> _U(32)
            else:
                value = table[data[part]]
                low, high = value * (weight & _LOW), value * (weight >> _U(32))
            low, high = _mod(np.cumsum(low)), _mod(np.cumsum(high))
            # 2**32 * high: bits beyond the 61st start anew
            high = ((high << _U(32)) & _P) + (high >> _U(29))
            self.sums[start + 1:part.stop + 1] = sums = _mod(low + high + carry)
            carry = sums[-1]
        self.back = powers(n, pow(base, -1, PRIME))

    def spans(self, starts, ends):
        out = np.empty(len(starts), np.uint64)
        for at in range(0, len(starts), _PART):
            s, e = starts[at:at + _PART], ends[at:at + _PART]
            out[at:at + _PART] = _times(_mod(self.sums[e] + (_P - self.sums[s])), self.back[s])
        return out


class Rolling:
    """As Prefix, but modulo 2**64: cheap, and right for spans of up to some 100 bytes, or where others verify."""

    def __init__(self, data, table=RANDOM):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(np.take(table, data) * _wrapped(n, _ODD)[:n], out=self.sums[1:])
        self.back = _wrapped(n, pow(_ODD, -1, 1 << 64))

    def spans(self, starts, ends):
        return (self.sums[ends] - self.sums[starts]) * self.back[starts]


def _wrapped(n: int, base: int):
    """base**0 .. base**n modulo 2**64."""
    have = _POWERS.get((base, 64))
    if have is None or len(have) <= n:
        full = np.full(max(n + 1, 1 << 16), base, np.uint64)
        full[0] = 1
        have = _POWERS[base, 64] = np.cumprod(full, dtype=np.uint64)
    return have[:n + 1]


def texts(column):
    """Bytes and offsets of an Arrow string or binary array without nulls."""
    import pyarrow as pa

    column = column.cast(pa.large_binary()) if pa.types.is_string(column.type) else column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def words(data, offsets):
    """Starts and ends of the words (runs of anything but ASCII white space) and the words before each text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | cut[1:n]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | cut[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def windows(values, bounds, size: int):
    """Hashes of every ``size`` consecutive values inside each group; a shorter group is one window.

    ``bounds`` are the group bounds in ``values``; returns the hashes and their bounds.
    """
    counts = np.diff(bounds)
    per = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate([[0], np.cumsum(per)])
    if not out_bounds[-1]:
        return np.zeros(0, np.uint64), out_bounds
    group = np.repeat(np.arange(len(counts)), per)
    at = np.arange(out_bounds[-1]) - out_bounds[group] + bounds[group]
    length = np.minimum(counts, size)[group]
    total = length.astype(np.uint64) * ORDER[-1]
    padded = np.concatenate([values, np.zeros(size, np.uint64)])
    short = np.flatnonzero(length < size)
    for k in range(size):
        part = padded[at + k] * ORDER[k]
        part[short] *= (length[short] > k).astype(np.uint64)
        total += part
    return mix(total), out_bounds


class MinHasher:
    """Minima of ``count`` hash functions over groups of 64-bit values, as 32-bit numbers."""

    def __init__(self, count: int, seed: int, part: slice = slice(None)):
        """``part`` picks some of the functions."""
        rng = np.random.Generator(np.random.PCG64(seed))
        self.xor = rng.integers(0, 1 << 32, count, dtype=np.uint32)[part]
        self.times = rng.integers(0, 1 << 32, count, dtype=np.uint32)[part] | np.uint32(1)

    def minima(self, values, bounds):
        """One row per function, one column per group (groups must not be empty)."""
        x = (values >> _U(32)).astype(np.uint32)
        out = np.empty((len(self.xor), len(bounds) - 1), np.uint32)
        y = np.empty_like(x)
        for k, (r, a) in enumerate(zip(self.xor, self.times)):
            np.bitwise_xor(x, r, out=y)
            np.multiply(y, a, out=y)
            np.minimum.reduceat(y, bounds[:-1], out=out[k])
        return out


class BinnedMinHasher:
    """As MinHasher, with ``rows`` functions that give ``bands`` minima each instead of one.

    A function deals a group's values to ``bands`` bins and gives the least of each bin; a bin without a value takes the
    group's least under a function of its own.  So each minimum of two groups agrees with a probability of their Jaccard
    similarity, as in MinHasher.  A band takes one bin of every function, hence independent minima; minima of one
    function are drawn without replacement, so bands are negatively associated, and a pair misses all of them no more
    often than independent ones.
    """

    def __init__(self, bands: int, rows: int, seed: int):
        if bands & (bands - 1):
            raise ValueError("bands must be a power of two")
        self.bands, self.rows, self.bits = bands, rows, bands.bit_length() - 1
        self.dealt, self.own = MinHasher(rows, seed), MinHasher(bands * rows, seed + 1)

    def minima(self, values, bounds):
        """One row per minimum (those of a band side by side), one column per group (groups must not be empty)."""
        x = (values >> _U(32)).astype(np.uint32)
        groups, counts = len(bounds) - 1, np.diff(bounds)
        out = np.empty((self.bands, self.rows, groups), np.uint32)
        base = np.repeat(np.arange(groups, dtype=np.int64) << self.bits, counts)
        for row, (r, a) in enumerate(zip(self.dealt.xor, self.dealt.times)):
            y = (x ^ r) * a
            least = np.full(groups << self.bits, 0xFFFFFFFF, np.uint32)
            np.minimum.at(least, base + (y >> np.uint32(32 - self.bits)), y)  # the bin is in the highest bits
            at = np.flatnonzero(least == 0xFFFFFFFF)
            for start in range(0, len(at), _EMPTY):
                group, bin = at[start:start + _EMPTY] >> self.bits, at[start:start + _EMPTY] & (self.bands - 1)
                n, function = counts[group], bin * self.rows + row
                ends = np.cumsum(n)
                member = np.arange(ends[-1]) + np.repeat(bounds[group] - (ends - n), n)
                y = (x[member] ^ np.repeat(self.own.xor[function], n)) * np.repeat(self.own.times[function], n)
                least[at[start:start + _EMPTY]] = np.minimum.reduceat(y, ends - n)
            out[:, row] = least.reshape(groups, -1).T
        return out.reshape(self.bands * self.rows, groups)


def mix32(x):
    """Finalizer of murmur3 on 32-bit numbers: every input bit moves every output bit.

    Low bits of a minimum as it is depend on low bits of its member alone, in every function.
    """
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def band_keys(minima, rows: int, first: int = 0):
    """64-bit bucket keys, one row per band of ``rows`` minima; the first band has the number ``first``."""
    bands = len(minima) // rows
    out = (np.arange(first + 1, first + bands + 1, dtype=np.uint64) * ORDER[-2])[:, None]
    for k in range(rows):
        out = out + (minima[k:bands * rows:rows].astype(np.uint64) + _U(1)) * ORDER[k]
    return mix(out)
