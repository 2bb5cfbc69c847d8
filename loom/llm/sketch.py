"""Vectorised shingle hashing and HyperMinHash registers (numpy, whole batches of texts at once)."""

from __future__ import annotations

import numpy as np

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20_260)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15)
ODD = _rng.integers(1, 2**63, 16, dtype=np.uint64) * U(2) + U(1)
#: Bytes hashed at a time; bounds the temporary arrays whatever the batch holds.
BLOCK = 1 << 18


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = np.full(n, BASE), np.full(n, U(pow(int(BASE), -1, 2**64)))
    base[0] = inverse[0] = 1
    return np.cumprod(base, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)


class WordHasher:
    """Hashes of the words of lower-cased (A-Z only) UTF-8 buffers, by differences of one running polynomial sum."""

    def __init__(self) -> None:
        self.power, self.inverse = _powers(BLOCK + 1)

    def __call__(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, start) of every word of a buffer; words longer than a block are hashed in pieces."""
        gap = SPACE[data]
        edge = np.diff(np.concatenate(([True], gap, [True])).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        out, i = np.empty(len(start), np.uint64), 0
        while i < len(start):
            base = start[i]
            j = int(np.searchsorted(end, base + BLOCK, "right"))
            if j == i:  # one word longer than a block
                h = U(0)
                for k in range(base, end[i], BLOCK):
                    part = BYTE[LOWER[data[k : min(k + BLOCK, end[i])]]]
                    h = h * ODD[3] + (part * self.power[: len(part)]).sum(dtype=np.uint64)
                out[i], i = h, i + 1
                continue
            part = BYTE[LOWER[data[base : end[j - 1]]]]
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part * self.power[: len(part)], dtype=np.uint64)))
            a, b = start[i:j] - base, end[i:j] - base
            out[i:j] = (total[b] - total[a]) * self.inverse[a]
            i = j
        return mix(out ^ (end - start).astype(np.uint64) * ODD[2]), start


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of a word sequence's shingles in order; a shorter sequence is one shingle, an empty one none."""
    n = len(words)
    if n == 0:
        return words
    if n < size:
        h = U(n)
        with np.errstate(over="ignore"):
            for k in range(n):
                h = h * ODD[5] + words[k] * ODD[6 + k % 8]
        return mix(np.array([h]))
    h = words[: n - size + 1] * ODD[0]
    for k in range(1, size):
        h = h * ODD[4] + words[k : n - size + 1 + k] * ODD[k % 4]
    return mix(h)


def sets(texts: list[bytes | None], size: int, hasher: WordHasher):
    """The sorted distinct shingle hashes of each text, one after the other."""
    i = 0
    while i < len(texts):
        j, held = i, 0
        while j < len(texts) and (j == i or held + len(texts[j] or b"") < BLOCK):
            held += len(texts[j] or b"") + 1
            j += 1
        block = [x or b"" for x in texts[i:j]]
        data = np.frombuffer(b" ".join(block), np.uint8)
        words, start = hasher(data)
        bounds = np.searchsorted(start, np.cumsum([0, *(len(x) + 1 for x in block)]))
        for k in range(j - i):
            yield np.unique(shingle_hashes(words[bounds[k] : bounds[k + 1]], size))
        i = j


class HyperMinHash:
    """Registers of leading-zero counts and mantissa bits over ``bands * rows`` buckets.

    A shingle's hash picks a bucket; the bucket keeps the smallest remainder, stored as the count of
    its leading zeros (6 bits) and the ``mantissa`` bits that follow the first one.  Buckets that no
    shingle reaches borrow the register of the first filled bucket in an order fixed per bucket, so
    that short sets agree in a bucket with a probability of their Jaccard similarity, too.
    """

    def __init__(self, bands: int, rows: int, mantissa: int = 10, seed: int = 7) -> None:
        self.bands, self.rows, self.m, self.mantissa = bands, rows, bands * rows, mantissa
        rng = np.random.default_rng(seed)
        self.probe = np.argsort(rng.random((self.m, self.m)), axis=1).astype(np.int32)

    def registers(self, hashes: np.ndarray) -> np.ndarray:
        """uint16 registers of a set of at least one shingle hash."""
        bucket = ((hashes >> U(40)) % U(self.m)).astype(np.int64)
        least = np.full(self.m, ~U(0))
        np.minimum.at(least, bucket, mix(hashes * ODD[9]))
        filled = np.zeros(self.m, bool)
        filled[bucket] = True
        if not filled.all():
            empty = np.flatnonzero(~filled)
            least[empty] = least[self.probe[empty, np.argmax(filled[self.probe[empty]], axis=1)]]
        return self.compress(least)

    def compress(self, values: np.ndarray) -> np.ndarray:
        """Leading zeros in the high bits, then the mantissa."""
        top = values >> U(11)  # 53 bits, exact as a float
        exponent = np.frexp(top.astype(np.float64))[1].astype(np.int64)  # 0 for 0
        zeros = np.minimum(53 - exponent, 62).astype(np.uint64)
        shifted = values << np.minimum(zeros + U(1), U(63))
        return ((zeros << U(self.mantissa)) | (shifted >> U(64 - self.mantissa))).astype(np.uint16)

    def estimate(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Jaccard estimates of rows of registers, corrected for registers that collide by chance.

        Unequal minima share a register with probability of about 2 ** -mantissa / 3 (equal
        exponents with probability 1/3, then equal mantissas).  That is the chance for two sets of
        like size and many shingles a bucket; it falls as their sizes differ, and with less than one
        shingle a bucket exponents are more often equal.  At a mantissa of 10 bits the constant is
        off by less than 0.001 either way, far within the 5 standard deviations left for the estimate.
        """
        chance = 2.0**-self.mantissa / 3
        return np.maximum(0.0, ((a == b).mean(axis=1) - chance) / (1 - chance))
