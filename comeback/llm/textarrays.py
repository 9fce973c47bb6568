"""Texts as numpy arrays: words, 64-bit hashes of words and of runs of words or bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Spans hashed together, few enough for the cache, and bytes of text in a small batch.
PIECE = 1 << 14
BATCH = 1 << 22
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
SEEDS = (U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93))
LONG_SPAN = 1024
_FACTOR = U64(0xA0761D6478BD642F)
#: The lowest n bytes of eight.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly (splitmix finaliser)."""
    out = x >> U64(30)
    out ^= x
    out *= U64(0xBF58476D1CE4E5B9)
    out ^= out >> U64(27)
    out *= U64(0x94D049BB133111EB)
    out ^= out >> U64(31)
    return out


def small_batches(batches: Iterable[pa.RecordBatch], place: int, limit: int = BATCH) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of the text column at ``place``; a longer text
    has a batch of its own. Arrays over a batch's bytes then stay small whatever Spark's batch size."""
    for batch in batches:
        if batch.num_rows < 2:
            yield batch
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(place)), 0)).astype(np.int64)
        group = np.cumsum(sizes) // limit
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1), len(sizes)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield batch.slice(a, b - a)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and where each begins (one more offset than texts); null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, raw = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of the first word of each text (and of the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    blank = space[data]
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = blank[:-1]
    before[offsets[offsets < n]] = True
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = blank[1:]
    after[offsets[offsets > 0] - 1] = True
    starts = np.flatnonzero(~blank & before)
    ends = np.flatnonzero(~blank & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: tuple[np.uint64, ...] = SEEDS) -> list[np.ndarray]:
    """For each seed a 64-bit hash of each span of bytes.

    Eight bytes at a time are mixed into the hash of those before, which unlike a polynomial leaves no
    texts that collide by algebra; spans beyond ``LONG_SPAN`` bytes are hashed by BLAKE2b. Spans
    should be about in the order of their starts; they are hashed in pieces.
    """
    sizes = (ends - starts).astype(np.int64)
    if len(sizes) > PIECE:
        parts = []
        for low in range(0, len(sizes), PIECE):
            a, b = starts[low : low + PIECE], ends[low : low + PIECE]
            begin = int(a.min())
            parts.append(span_digests(data[begin : int(b.max())], a - begin, b - begin, seeds))
        return [np.concatenate(p) for p in zip(*parts, strict=True)]
    out = [mix(sizes.astype(U64) + seed) for seed in seeds]
    if not len(sizes):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, strides=(1,))
    long = np.flatnonzero(sizes > LONG_SPAN)
    open_ = np.flatnonzero((sizes > 0) & (sizes <= LONG_SPAN))
    done = 0
    while len(open_):
        rest = sizes[open_] - done
        part = eights[starts[open_] + done] & _MASKS[np.minimum(rest, 8)]
        for hashes in out:
            hashes[open_] = mix((hashes[open_] ^ part) * _FACTOR)
        done += 8
        open_ = open_[rest > 8]
    for n in long.tolist():
        span = data[starts[n] : ends[n]].tobytes()
        for seed, hashes in zip(seeds, out, strict=True):
            digest = hashlib.blake2b(span, digest_size=8, key=int(seed).to_bytes(8, "little")).digest()
            hashes[n] = int.from_bytes(digest, "little")
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes."""
    return span_digests(data, starts, ends, SEEDS[:1])[0]


def run_hashes(symbols: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` symbols (one for each start), by doubling."""
    if len(symbols) < size:
        return np.zeros(0, U64)
    base = U64(0xA0761D6478BD642F)
    out, length = None, 0
    power, run, width = base, symbols, 1
    left = size
    while left:
        if left & 1:
            if out is None:
                out, length = run, width
            else:
                n = len(symbols) - length - width + 1
                out = out[:n] * power
                out += run[length : length + n]
                length += width
        left >>= 1
        if left:
            n = len(symbols) - 2 * width + 1
            run, right = run[:n] * power, run[width : width + n]
            run += right
            power = U64(int(power) ** 2 % (1 << 64))
            width *= 2
    return mix(out)


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbouring values."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out
