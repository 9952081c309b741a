"""Words of byte arrays: where they stand, exact numbers for them, and hashes of words and of ranges.

Numbers compare real words and decide; hashes only propose what to compare, or name a content by 128 bits of BLAKE2.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: The base is odd, so it has an inverse modulo 2**64, and a range's hash follows from two prefix sums.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: What each byte counts as.
BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**64 - 1, 256, dtype=np.uint64)
#: The separators of words, [\x20\x09-\x0D].
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[9, 10, 11, 12, 13, 32]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
#: Bytes of a word that two 64-bit numbers hold beside their count, and the keys of the rounds that mix these.
SHORT = 15
ROUNDS = np.array([0x8CB92BA72F3D8DD7, 0xD1B54A32D192ED03, 0xAEF17502108EF2D9, 0xF1357AEA2E62A9C5], np.uint64)

_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and INVERSE ** i for i < n."""
    if len(_powers["up"]) < n:
        for name, base in (("up", BASE), ("down", INVERSE)):
            steps = np.full(max(n, 1 << 19), base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums of symbols[i] * BASE ** i, from 0."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * powers(len(symbols))[0], out=out[1:])
    return out


def ranges(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each range [start, end) of what `sums` was made of, alike wherever it stands.

    Different ranges can be made to have equal hashes (the sums are linear): good to propose, not to decide.
    """
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, text, start, end) of the words of texts data[offsets[i]:offsets[i + 1]]; start and end count in bytes."""
    base = offsets[0]
    text = data[base : offsets[-1]]
    if not len(text):
        none = np.zeros(0, np.int64)
        return text, none, none, none
    if lower:
        text = ASCII_LOWER[text]
    solid = ~IS_BLANK[text]
    edge = np.zeros(len(text) + 1, bool)
    edge[offsets[:-1] - base] = True
    edge[-1] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    of = np.searchsorted(offsets - base, start, side="right") - 1
    return text, of, start, end


def spaced(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, place): the words, a space after each, and where each begins; words i to j are bytes[place[i]:place[j] - 1]."""
    place = np.concatenate([[0], np.cumsum(end - start + 1)])
    out = np.full(place[-1], 32, np.uint8)
    if len(start):
        solid = text[~IS_BLANK[text]]
        out[np.arange(len(solid)) + np.repeat(np.arange(len(start)), end - start)] = solid
    return out, place


def numbered(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(number, values): the same number for equal words, by comparing their bytes, and the words by number."""
    ends = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    solid = np.ascontiguousarray(text[~IS_BLANK[text]])
    found = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(solid)]).dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary


def digests(values: pa.Array) -> np.ndarray:
    """Two 64-bit columns that name each value.

    Up to SHORT bytes, the bytes and their number themselves, mixed by a bijection, so that different values have
    different names; longer values by 128 bits of BLAKE2.
    """
    n = len(values)
    out = np.zeros((n, SHORT + 1), np.uint8)
    if not n:
        return out.view(np.uint64)
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, np.int32)[values.offset : values.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    size = np.diff(offsets)
    short = size <= SHORT
    out[:, SHORT] = np.where(short, size, 0)
    inside = np.repeat(short, size)
    place = np.repeat(np.arange(n) * (SHORT + 1) - offsets[:-1] + offsets[0], size) + np.arange(len(data))
    out.reshape(-1)[place[inside]] = data[inside]
    lanes = out.view(np.uint64)
    for k in np.flatnonzero(~short).tolist():
        lanes[k] = np.frombuffer(blake2b(data[offsets[k] - offsets[0] : offsets[k + 1] - offsets[0]], digest_size=16).digest(), np.uint64)
    left, right = lanes[:, 0].copy(), lanes[:, 1].copy()
    for key in ROUNDS:
        left, right = right, left ^ mix(right + key)
    return np.stack([left, right], axis=1)


def joined(x: np.ndarray, bound_x: int, y: np.ndarray, bound_y: int) -> tuple[np.ndarray, int]:
    """(number, bound) of the pairs (x, y), in their order; equal numbers are equal pairs.  Values are from 0 to bound."""
    if bound_x * bound_y >= 1 << 62:
        _, x = np.unique(x, return_inverse=True)
        bound_x = len(x) + 1
    if bound_x * bound_y >= 1 << 62:
        _, y = np.unique(y, return_inverse=True)
        bound_y = len(y) + 1
    return x * bound_y + y, bound_x * bound_y


def shingles(of: np.ndarray, word: np.ndarray, texts: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, at) of each text's distinct shingles of `size` words, in order of text and shingle.

    shingle is a number that tells shingles apart by their words' numbers; at is where one of them begins.  A text of
    fewer words has one shingle, all of it, which no text of more words has.
    """
    n = np.bincount(of, minlength=texts)
    first = np.cumsum(n) - n
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    text = np.repeat(np.arange(texts), count)
    at = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    last = np.repeat(first + n, count)
    # a place past the text's end counts as 0
    padded = np.append(word + 1, np.zeros(size, np.int64))
    bound = int(word.max()) + 2 if len(word) else 1
    number, top = padded[at], bound
    for k in range(1, size):
        number, top = joined(number, top, np.where(at + k < last, padded[at + k], 0), bound)
    if texts * top >= 1 << 62:
        _, number = np.unique(number, return_inverse=True)
        top = len(number) + 1
    key, index = np.unique(text * top + number, return_index=True)
    return key // top, key % top, at[index]
