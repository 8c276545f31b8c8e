"""NumPy kernels over many texts at once: code points, words, word hashes, shingles.

All of them work on a chunk of whole texts laid end to end, so that the cost of
a call is spread over many short texts while one long text is a chunk by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

#: Code points in a chunk; a longer text makes a chunk of its own.
CHUNK = 1 << 18
MULT = np.uint64(0x9E3779B97F4A7C15)
#: Code points of 21 bits that are hashed in one step, and the span from which the library's hash takes over.
LANE, LONG = 3, 96
_KEPT = np.array([0, (1 << 21) - 1, (1 << 42) - 1, (1 << 63) - 1], np.uint64)
_STEPS = ((np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)), (np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3)))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Row ranges of about CHUNK code points each."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points, and where each text begins (one more entry at the end)."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return codes, offsets


def fold(codes: np.ndarray) -> np.ndarray:
    """A-Z to a-z, nothing else."""
    return codes + np.uint32(32) * ((codes >= 65) & (codes <= 90))


def word_spans(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word; and no word crosses texts."""
    if not len(codes):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = (codes != 32) & ((codes < 9) | (codes > 13))
    edge = np.zeros(len(codes) + 1, bool)
    edge[offsets] = True
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False):
    """A 64-bit hash of each span, or two independent ones; equal strings hash alike wherever they stand.

    Each step multiplies and shifts, so no algebra of the string is left in it
    (a polynomial modulo 2**64 gives some short strings one value at any base).
    """
    size = ends - starts
    order = np.argsort(LONG + 1 - np.minimum(size, LONG + 1).astype(np.int16), kind="stable")  # longest first
    at, size = starts[order], size[order]
    out = []
    if len(at):
        wide = np.zeros(len(codes) + LANE - 1, np.uint64)
        wide[: len(codes)] = codes
        lanes = wide[:-2] | wide[1:-1] << np.uint64(21) | wide[2:] << np.uint64(42)
        many = int(np.searchsorted(-size, -LONG, "left"))  # longer ones
        live = [many + int(np.searchsorted(-size[many:], -j, "left")) for j in range(0, LONG, LANE)]
        digests = [hashlib.blake2b(codes[s : s + n].tobytes(), digest_size=16).digest() for s, n in zip(at[:many].tolist(), size[:many].tolist(), strict=True)]
        digests = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    for k, (first, other) in enumerate(_STEPS[: 2 if second else 1]):
        h = mix(size.astype(np.uint64) * first + other)
        if len(at):
            for j, n in zip(range(0, LONG, LANE), live, strict=True):
                if n == many:
                    break
                x = lanes[at[many:n] + j] & _KEPT[np.minimum(size[many:n] - j, LANE)]
                y = (h[many:n] ^ x * first) * other
                h[many:n] = y ^ (y >> np.uint64(32))
            h[:many] = digests[:, k]
        back = np.empty_like(h)
        back[order] = mix(h)
        out.append(back)
    return (out[0], out[1]) if second else out[0]


def shingles(hashes: np.ndarray, text_of: np.ndarray, n_texts: int, k: int = 5) -> list[np.ndarray]:
    """Per text its distinct k-word shingles, sorted; fewer words: the whole sequence as one; none: empty."""
    odd = [np.uint64(0xD6E8FEB86659FD93 + 2 * 7919 * j * j + 2 * j) for j in range(k)]
    bounds = np.searchsorted(text_of, np.arange(n_texts + 1))
    if len(hashes) >= k:
        total = np.zeros(len(hashes) - k + 1, np.uint64)
        for j in range(k):
            total += hashes[j : len(hashes) - k + 1 + j] * odd[j]
        every = mix(total)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(every[a : b - k + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64) * np.uint64(0xA0761D6478BD642F)
            for j in range(b - a):
                whole += hashes[a + j : a + j + 1] * odd[j]
            out.append(mix(whole))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: list[str], k: int = 5) -> Iterator[np.ndarray]:
    """The shingle set of each text, folded to lower case."""
    for lo, hi in chunks(texts):
        codes, offsets = code_points(texts[lo:hi])
        codes = fold(codes)
        starts, ends, text_of = word_spans(codes, offsets)
        yield from shingles(span_hashes(codes, starts, ends), text_of, hi - lo, k)
