"""Words and word shingles of whole Arrow batches, found with numpy on the UTF-8 bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_M1, _M2, _STEP = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0xD6E8FEB86659FD93)
#: Start values of independent hashes.
_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Keeps the first n bytes of a little-endian word of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
#: Words of more bytes are hashed one by one.
_LONG = 64


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * _M1
    h ^= h >> np.uint64(29)
    h *= _M2
    h ^= h >> np.uint64(32)
    return h


def blocks(texts: pa.Array | pa.ChunkedArray, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows with ``limit`` bytes together, or one longer row. Null counts as empty."""
    for chunk in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        chunk = pc.fill_null(chunk.cast(pa.large_binary()), b"")
        _, offs_buf, data = chunk.buffers()
        n = len(chunk)
        if not n:
            continue
        offs = np.frombuffer(offs_buf, dtype=np.int64)[chunk.offset : chunk.offset + n + 1]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
            yield i, j, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            i = j


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the bytes of spans: eight bytes at a time, each step mixed in full, so that no pattern within a word cancels out; long spans by BLAKE2."""
    padded = np.empty(len(buf) + 8, dtype=np.uint8)
    padded[: len(buf)] = buf
    padded[len(buf) :] = 0
    eight = np.ndarray((len(buf) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    size = ends - starts
    h = mix(size.astype(np.uint64) * _STEP + _SEEDS[seed])
    left = np.flatnonzero(size <= _LONG)
    done = 0
    while len(left):
        left = left[size[left] > done]
        lane = eight[starts[left] + done] & _FIRST[np.minimum(size[left] - done, 8)]
        h[left] = mix((h[left] ^ lane) * _STEP + _SEEDS[seed])
        done += 8
    key = int(_SEEDS[seed]).to_bytes(8, "little")
    for i in np.flatnonzero(size > _LONG):
        h[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]].data, digest_size=8, key=key).digest(), "little")
    return h


def word_hashes(buf: np.ndarray, offs: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of other than white space, A-Z lower-cased) and, for each row, where its words begin; one entry more at the end."""
    n = len(buf)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(offs), np.int64)
    inside = ~SPACE[buf]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    before = np.empty(n, dtype=bool)
    before[0] = True
    before[1:] = ~inside[:-1]
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1] = True
    after[:-1] = ~inside[1:]
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    return span_hashes(LOWER[buf], starts, ends, seed), np.searchsorted(starts, offs).astype(np.int64)


def shingle_sets(texts: pa.Array | pa.ChunkedArray, k: int, seed: int = 0) -> Iterator[np.ndarray]:
    """For each row the sorted distinct 64-bit hashes of its k-word shingles; of the whole sequence if it has fewer words; none without words. Different seeds give independent hashes."""
    for i, j, buf, offs in blocks(texts):
        words, at = word_hashes(buf, offs, seed)
        m = max(0, len(words) - k + 1)
        grams = np.zeros(m, dtype=np.uint64)
        for t in range(k):
            grams = (grams ^ (grams >> np.uint64(29))) * _STEP + words[t : t + m]
        grams = mix(grams)
        for r in range(j - i):
            a, b = at[r], at[r + 1]
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                h = np.zeros(1, dtype=np.uint64)
                for w in words[a:b]:
                    h = (h ^ (h >> np.uint64(29))) * _STEP + w
                yield mix(h + np.uint64(b - a))
            else:
                yield np.empty(0, dtype=np.uint64)
