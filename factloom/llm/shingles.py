"""Word shingles of whole texts as sorted sets of 64-bit fingerprints.

Words are runs of bytes other than blank and 0x09-0x0D, with A-Z lower-cased. A shingle's words are keyed BLAKE2b
digests, taken once for each distinct word of a slice, so a word of equal digest can't be solved for; they are
chained by a nonlinear mix. Two different shingles share a fingerprint with a chance of about 2^-64.

`word_fingerprints` is a quicker hash for features, where nothing is decided by equality.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
LONG_WORD = 64


def mix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def random_words(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit values, the same on every executor."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(n, dtype=np.uint64) + np.uint64(seed * 1_000_003 + 1)) * np.uint64(0x9E3779B97F4A7C15))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_HEAD = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** (0 .. n - 1) modulo 2^64."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        p = np.full(max(n, SEGMENT + 1), base, dtype=np.uint64)
        p[0] = 1
        held = _powers[base] = np.multiply.accumulate(p)
    return held[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls and the n + 1 offsets of its values in them."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    body = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_fingerprints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text index, fingerprint) of every word, in order: a nonlinear mix chained over its eight-byte chunks."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    solid = np.zeros(len(data) + 2, dtype=bool)
    np.logical_not(_SPACE[data], out=solid[1:-1])
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[offsets] = True
    starts = np.flatnonzero(solid[1:-1] & (begins[:-1] | ~solid[:-2]))
    sizes = np.flatnonzero(solid[1:-1] & (begins[1:] | ~solid[2:])) + 1 - starts
    low = np.zeros(len(data) + 8, dtype=np.uint8)
    low[:-8] = _LOWER[data]
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=low, strides=(1,))  # the eight bytes from each place
    out = mix64(sizes.astype(np.uint64) + random_words(1, 11))
    at = np.arange(len(starts))
    for done in range(0, LONG_WORD, 8):
        at = at[sizes[at] > done]
        if not len(at):
            break
        out[at] = mix64(out[at] ^ (eight[starts[at] + done] & _HEAD[np.minimum(sizes[at] - done, 8)]))
    for i in np.flatnonzero(sizes > LONG_WORD):
        word = low[starts[i] : starts[i] + sizes[i]]
        out[i] = int.from_bytes(hashlib.blake2b(word.data, digest_size=8, key=b"word").digest(), "little")
    return np.searchsorted(offsets, starts, "right") - 1, out


_WORD = hashlib.blake2b(digest_size=8, key=b"word")


def _digest(word: bytes) -> bytes:
    h = _WORD.copy()
    h.update(word)
    return h.digest()


def word_digests(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bounds of each text's words, digests of all words in order) of a string column without nulls."""
    words, bounds = [], [0]
    for body in column.cast(pa.large_binary()):
        words += body.as_py().lower().split()
        bounds.append(len(words))
    kinds = dict.fromkeys(words)
    digests = np.frombuffer(b"".join(map(_digest, kinds)), dtype="<u8")
    number = dict(zip(kinds, range(len(kinds)), strict=True))
    return np.array(bounds), digests[np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))]


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct fingerprints of its k-word shingles; a text of fewer words has its
    whole sequence as one; one without words has none."""
    bounds, words = word_digests(column)
    salt = random_words(k, 17) | np.uint64(1)
    with np.errstate(over="ignore"):
        long = max(0, len(words) - k + 1)
        grams = np.zeros(long, dtype=np.uint64)
        for j in range(k):
            grams = mix64(grams + words[j : j + long] * salt[j])
        for i in range(len(column)):
            lo, hi = bounds[i], bounds[i + 1]
            if hi - lo >= k:
                yield np.unique(grams[lo : hi - k + 1])
            elif hi > lo:
                short = np.full(1, hi - lo, dtype=np.uint64)
                for j in range(hi - lo):
                    short = mix64(short + words[lo + j : lo + j + 1] * salt[j])
                yield short
            else:
                yield np.zeros(0, dtype=np.uint64)


def small_batches(batches, rows: int = 512, size: int = 1 << 20):
    """Slices of record batches so that the text in hand stays within about `size` bytes (one text at least)."""
    for b in batches:
        if not len(b):
            continue
        lengths = np.diff(utf8(b.column(1))[1])
        i = 0
        while i < len(b):
            total = np.cumsum(lengths[i : i + rows])
            n = max(1, int(np.searchsorted(total, size, "right")))
            yield b.slice(i, n)
            i += n
