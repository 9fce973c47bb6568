"""Removes bytes that stand in a byte string of an earlier document.

Each shard sorts the rotations of its strips, takes the Burrows-Wheeler transform, and expands
intervals backwards, breadth first: the intervals found at level n are those of strings of n
bytes, and each new interval border has a common prefix of exactly n. It stops at the window size,
so borders that are still unmarked lie between suffixes with that many bytes in common.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from comeback.llm.passages import Chunk, Windows, without_repeats

#: Ends each strip; no byte of UTF-8.
END = 0xFF


def sorted_rotations(text: np.ndarray, depth: int) -> np.ndarray:
    """Start of each rotation, ordered by at least its first ``depth`` bytes: eight bytes at once, then by doubling."""
    n = len(text)
    around = np.concatenate([text, text[np.arange(7) % n]])
    key = np.ndarray((n,), np.dtype(">u8"), around, strides=(1,)).astype(np.uint64)
    width = 8
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        if width >= depth or rank[order[-1]] == n - 1:
            return order
        key = rank * (int(rank[order[-1]]) + 1)
        at = width % n
        key[: n - at] += rank[at:]
        key[n - at :] += rank[:at]
        width *= 2


def borders(text: np.ndarray, order: np.ndarray, size: int) -> np.ndarray:
    """Which places in the order begin suffixes that differ from the one before within ``size``."""
    n = len(text)
    last = text[order - 1].astype(np.int64)  # the transform; rotation 0 is preceded by the last byte
    by_byte = np.argsort(last, kind="stable")
    keys = last[by_byte] * (n + 1) + by_byte
    back = np.empty(n, np.int64)  # where the rotation one byte longer stands
    back[by_byte] = np.arange(n)
    following = np.full(n, n)  # next place with the same byte
    same = last[by_byte[1:]] == last[by_byte[:-1]]
    following[by_byte[:-1][same]] = by_byte[1:][same]
    marked = np.zeros(n + 1, bool)
    marked[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(size):
        if not len(low):
            break
        lengths = high - low
        at = np.arange(lengths.sum()) + np.repeat(low - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
        bound = np.repeat(high, lengths)
        final = following[at] >= bound  # the last of its byte in the interval
        place, start = at[final], np.repeat(low, lengths)[final]
        border = back[place] + 1
        new = ~marked[border]
        place, start, border = place[new], start[new], border[new]
        marked[border] = True
        low = np.searchsorted(keys, last[place] * (n + 1) + start)
        high = border
        order_ = np.argsort(low)
        low, high = low[order_], high[order_]
    return marked[:n]


def by_intervals(size: int):
    """Resolves strips of bytes by interval expansion."""

    def resolve(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
        sizes = np.diff(offsets)
        at = offsets[:-1] + np.arange(len(sizes))
        text = np.full(len(data) + len(sizes), END, np.uint8)
        inside = np.ones(len(text), bool)
        inside[at + sizes] = False
        text[inside] = data
        order = sorted_rotations(text, size + 1)
        begins = borders(text, order, size)
        strip = np.repeat(np.arange(len(sizes)), sizes + 1)[order]
        window = order + size <= at[strip] + sizes[strip]
        group = (np.cumsum(begins) - 1)[window]
        place, strip = order[window], strip[window]
        least = np.full(int(group[-1]) + 1 if len(group) else 0, np.iinfo(np.int64).max)
        np.minimum.at(least, group, ids[strip])
        hit = least[group] < ids[strip]
        place, strip = place[hit], strip[hit]
        by_place = np.argsort(place)
        place, strip = place[by_place], strip[by_place]
        cuts = np.searchsorted(strip, np.arange(len(sizes) + 1))
        return [place[a:b] - s for a, b, s in zip(cuts[:-1], cuts[1:], at, strict=True)]

    return resolve


SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
KEPT_SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def _reporter(texts: bool):
    def report(chunk: Chunk, gone: np.ndarray) -> pa.Table:
        begin, end = chunk.first[:-1], chunk.first[1:]
        before = np.concatenate([[0], np.cumsum(gone)])
        first = gone.copy()
        first[1:] &= ~gone[:-1]
        first[begin[begin < len(gone)]] |= gone[begin[begin < len(gone)]]
        spans = np.concatenate([[0], np.cumsum(first)])
        removed = before[end] - before[begin]
        raw = chunk.data[~gone].tobytes()
        kept = [raw[a:b] for a, b in zip((begin - before[begin]).tolist(), (end - before[end]).tolist(), strict=True)]
        columns = {"doc_id": chunk.ids.cast(pa.int64()), "n_bytes": end - begin, "n_removed": removed, "n_spans": spans[end] - spans[begin]}
        if texts:
            return pa.table(columns | {"kept": pa.array(kept, pa.binary())})
        return pa.table(columns | {"kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())})

    return report


def remove_repeated_bytes(
    docs: DataFrame, size: int = 50, texts: bool = False, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: its bytes, how many were removed in how many runs, and the rest.

    A byte goes if some string of ``size`` bytes over it also starts in a document with a smaller
    id; no string crosses from one document to another. Null and empty texts have no bytes. A null
    id is larger than all others; rows with the same id (or without one) don't remove each other's
    bytes. Other columns are not looked at. ``texts`` gives the bytes left in place of their SHA-256.
    """
    rule = Windows(by_word=False, size=size, gram=max(1, min(12, size // 2)))
    schema = KEPT_SCHEMA if texts else SCHEMA
    return without_repeats(docs, rule, by_intervals(size), _reporter(texts), schema, id_column, text_column)


