"""Which windows of a document also start in a document with a smaller id, over a whole corpus.

A window is a fixed number of symbols (words or bytes). Each window has a least run hash (its
minimizer); neighbouring windows with the same one form a strip. Equal windows have equal
minimizers, so sending each strip to the shard of its minimizer brings equal windows together,
and each shard can be settled alone:

1. documents are dealt to chunks of bounded size; a chunk sends each distinct strip once, with
   the smallest id that holds it, packed and compressed per shard;
2. a shard answers which windows of a strip stand in a smaller document. Strips that are equal
   as a whole need no search. What is left, strips with the same minimizer but different text, goes
   to the ``resolve`` function of the operator;
3. the chunk, dealt the same way again, marks the answers in its documents.

A strip that a third of all documents share arrives once per chunk, not once per document.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comeback.llm.textarrays import U64, buffers, mix, run_hashes, span_digests, span_hashes, window_minimum, words

#: Stands for a null id: larger than all others, and equal to itself.
NO_ID = np.iinfo(np.int64).max
#: Symbols whose windows are looked at together.
SLICE = 1 << 17
#: Slots that window hashes are counted in, as a power of two: four for each byte of a block.
SLOT_BITS = 23
#: Bytes of strips that a shard searches together.
BLOCK = 1 << 21
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))

#: (bytes of strips, byte offsets, ids) -> for each strip the starts of windows found in a strip with a smaller id
Resolve = Callable[[np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]


@dataclass(frozen=True)
class Windows:
    """``size``: symbols of a window; ``gram``: symbols of the runs that are hashed for its minimizer."""

    by_word: bool
    size: int
    gram: int
    chunk_bytes: int = 6 << 20
    shard_bytes: int = 24 << 20


@dataclass
class Chunk:
    """Texts of a chunk in a fixed order. ``data``: bytes (words joined by one space, if by word);
    ``starts``, ``ends``: bytes of each symbol; ``first``: number of each text's first symbol."""

    ids: pa.Array
    keys: np.ndarray
    data: np.ndarray
    starts: np.ndarray | None
    ends: np.ndarray | None
    first: np.ndarray

    def span(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the symbols [a, b)."""
        return (a, b) if self.starts is None else (self.starts[a], self.ends[b - 1])


def load(table: pa.Table, by_word: bool) -> Chunk:
    table = table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("h", "ascending")]))
    ids = table.column("doc_id").combine_chunks()
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    keys = np.asarray(ids.cast(pa.int64()).fill_null(NO_ID))
    text = table.column("text").cast(pa.large_string()).combine_chunks()
    text = pa.concat_arrays(text.chunks) if isinstance(text, pa.ChunkedArray) else text
    data, offsets = buffers(text)
    if not by_word:
        return Chunk(ids, keys, data, None, None, offsets)
    starts, ends, first = words(data, offsets)
    # Canonical bytes: each word and one space after it.
    keep = np.zeros(len(data) + 1, np.int32)
    np.add.at(keep, starts, 1)
    np.add.at(keep, ends, -1)
    inside = np.cumsum(keep[:-1]) > 0
    sizes = ends - starts
    at = np.concatenate([[0], np.cumsum(sizes + 1)])
    joined = np.full(int(at[-1]), 0x20, np.uint8)
    fill = np.ones(len(joined), bool)
    fill[at[1:] - 1] = False
    joined[fill] = data[inside]
    return Chunk(ids, keys, joined, at[:-1], at[1:] - 1, first)


@dataclass
class Strips:
    """Strips of a chunk (symbol of the first window, number of windows, text) and the distinct ones
    in the order they are sent: strips ``order[low:high]``, their smallest id, shard, and place of the
    minimizer. ``which`` is the distinct strip of each of ``order``."""

    begin: np.ndarray
    count: np.ndarray
    text: np.ndarray
    order: np.ndarray
    which: np.ndarray
    low: np.ndarray
    high: np.ndarray
    least: np.ndarray
    shard: np.ndarray
    place: np.ndarray


def texts_of(first: np.ndarray, low: int, high: int) -> np.ndarray:
    """The text that each of the symbols [low, high) stands in."""
    cuts = np.clip(first, low, high)
    return np.repeat(np.arange(len(first) - 1), np.diff(cuts))


def strips(chunk: Chunk, rule: Windows, shards: int) -> Strips:
    size, gram = rule.size, rule.gram
    width = size - gram + 1
    symbols = span_hashes(chunk.data, chunk.starts, chunk.ends) if rule.by_word else None
    total = int(chunk.first[-1])
    begins, counts, places, values = [], [], [], []
    for low in range(0, max(0, total - size + 1), SLICE):
        high = min(total, low + SLICE + size - 1)
        part = symbols[low:high] if rule.by_word else _BYTE[chunk.data[low:high]]
        grams = run_hashes(part, gram)
        least = window_minimum(grams, width)
        text = texts_of(chunk.first, low, low + len(least))
        good = np.arange(low + size, low + size + len(least)) <= chunk.first[text + 1]
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | ~good[:-1]
        begin = np.flatnonzero(new & good)
        if not len(begin):
            continue
        stop = np.flatnonzero(np.append(new, True))
        end = stop[np.searchsorted(stop, begin, side="right")]
        # windows that reach beyond their text end a strip
        bad = np.append(np.flatnonzero(~good), len(least))
        end = np.minimum(end, bad[np.searchsorted(bad, begin)])
        value = least[begin]
        # A value below that of the window before has just come in at the end.
        place = np.full(len(begin), width - 1, np.int64)
        open_ = np.flatnonzero((begin == 0) | (least[begin - 1] <= value))
        for step in range(width):
            hit = grams[begin[open_] + step] == value[open_]
            place[open_[hit]] = step
            open_ = open_[~hit]
            if not len(open_):
                break
        begins.append(begin + low)
        counts.append(end - begin)
        places.append(place)
        values.append(value)
    empty = np.zeros(0, np.int64)
    begin, count, place = (np.concatenate(x) if x else empty for x in (begins, counts, places))
    value = np.concatenate(values) if values else np.zeros(0, U64)
    text = np.searchsorted(chunk.first, begin, side="right") - 1
    shard = (mix(value) % U64(shards)).astype(np.int64)
    if not len(begin):
        return Strips(begin, count, text, *[empty] * 7)
    a, b = chunk.span(begin, begin + count + size - 1)
    h, g = span_digests(chunk.data, a, b)
    order = np.argsort(h, kind="stable")
    h, g = h[order], g[order]
    edges = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])]))
    ends = np.append(edges[1:], len(order))
    least_id = np.minimum.reduceat(chunk.keys[text[order]], edges)
    one = order[edges]
    # Sent in the order of the texts, which compresses best.
    sent = np.lexsort((one, shard[one]))
    number = np.empty(len(sent), np.int64)
    number[sent] = np.arange(len(sent))
    which = np.repeat(number, ends - edges)
    one = one[sent]
    return Strips(begin, count, text, order, which, edges[sent], ends[sent], least_id[sent], shard[one], place[one])


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the spans one after another, and their offsets."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    index = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
    return data[index], offsets


CODEC = pa.Codec("zstd", compression_level=5)
SENT = "shard int, chunk int, n bigint, raw bigint, packed binary"


def send(table: pa.Table, rule: Windows, shards: int) -> pa.Table:
    number = table.column("chunk")[0].as_py()
    chunk = load(table, rule.by_word)
    found = strips(chunk, rule, shards)
    out: dict[str, list] = {k: [] for k in ("shard", "chunk", "n", "raw", "packed")}
    firsts = found.order[found.low]
    cuts = [*np.flatnonzero(np.diff(found.shard, prepend=-1)), len(firsts)]
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        pick = firsts[low:high]
        a, b = chunk.span(found.begin[pick], found.begin[pick] + found.count[pick] + rule.size - 1)
        data, offsets = gathered(chunk.data, a, b)
        raw = b"".join(
            (
                np.diff(offsets).astype(np.uint32).tobytes(),
                found.least[low:high].tobytes(),
                found.place[low:high].astype(np.uint16).tobytes(),
                data.tobytes(),
            )
        )
        out["shard"].append(int(found.shard[low]))
        out["chunk"].append(number)
        out["n"].append(len(pick))
        out["raw"].append(len(raw))
        out["packed"].append(CODEC.compress(raw, asbytes=True))
    kinds = {"shard": pa.int32(), "chunk": pa.int32(), "n": pa.int64(), "raw": pa.int64(), "packed": pa.binary()}
    return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})


ANSWERS = "chunk int, shard int, entry binary, low binary, high binary"


def settle(table: pa.Table, rule: Windows, resolve: Resolve) -> pa.Table:
    """Answers of a shard: per chunk, which windows [low, high) of which sent strips are repeated."""
    shard = table.column("shard")[0].as_py()
    chunks, counts = table.column("chunk").to_pylist(), table.column("n").to_pylist()
    sizes, ids, places, data = [], [], [], []
    for n, raw, packed in zip(counts, table.column("raw").to_pylist(), table.column("packed"), strict=True):
        plain = pa.decompress(packed.as_buffer(), raw, "zstd")
        sizes.append(np.frombuffer(plain, np.uint32, n))
        ids.append(np.frombuffer(plain, np.int64, n, 4 * n))
        places.append(np.frombuffer(plain, np.uint16, n, 12 * n))
        data.append(np.frombuffer(plain, np.uint8, offset=14 * n))
    size = np.concatenate(sizes).astype(np.int64)
    key, place = np.concatenate(ids), np.concatenate(places).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(size)])
    whole = np.concatenate(data)
    del sizes, ids, places, data
    strings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(whole)])
    coded = strings.dictionary_encode()
    code, plain = np.asarray(coded.indices), coded.dictionary
    del strings, coded
    least = np.full(len(plain), NO_ID)
    np.minimum.at(least, code, key)
    # Strips that share a minimizer with another text from another document need a search.
    one = np.zeros(len(plain), np.int64)
    one[code[::-1]] = np.arange(len(code))[::-1]
    mark, beside, apart = _minimizers(whole, offsets, place, one, rule)
    order = np.argsort(mark)
    edges = np.flatnonzero(np.concatenate([[True], mark[order][1:] != mark[order][:-1]]))
    group = np.zeros(len(plain), np.int64)
    group[order] = np.cumsum(np.isin(np.arange(len(plain)), edges, assume_unique=True)) - 1
    low_id = np.minimum.reduceat(least[order], edges)
    search = np.flatnonzero(low_id[group] < least)
    needed = np.zeros(len(edges), bool)
    needed[group[search]] = True
    loose = np.zeros(len(edges), bool)
    loose[group[apart]] = True
    near = loose[group]
    for keys in beside:
        near |= _shared(keys, least)
    member = np.flatnonzero(needed[group] & near)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    # Groups of a minimizer are independent: they are looked at in blocks of bounded size.
    member = member[np.argsort(group[member], kind="stable")]
    sizes_ = np.cumsum(offsets[one[member] + 1] - offsets[one[member]])
    last = np.flatnonzero(np.append(group[member][1:] != group[member][:-1], True)) + 1 if len(member) else member
    waiting: list[np.ndarray] = []

    def search() -> None:
        these = np.concatenate(waiting)
        waiting.clear()
        text, at = gathered(whole, offsets[one[these]], offsets[one[these] + 1])
        starts = resolve(text, at, least[these])
        owner = np.repeat(these, [len(x) for x in starts])
        if len(owner):
            starts = np.concatenate(starts).astype(np.int64)
            cut = np.flatnonzero((np.diff(owner) != 0) | (np.diff(starts) != 1))
            first, last = np.concatenate([[0], cut + 1]), np.append(cut, len(starts) - 1)
            found.append((owner[first], starts[first], starts[last] + 1))

    low = held = 0
    for place, high in enumerate(last):
        following = sizes_[last[place + 1] - 1] - (sizes_[low - 1] if low else 0) if place + 1 < len(last) else BLOCK + 1
        if following <= BLOCK:
            continue
        these = member[low:high]
        low = high
        text, at = gathered(whole, offsets[one[these]], offsets[one[these] + 1])
        kept = _with_repeats(text, at, least[these], rule)
        if len(kept):
            waiting.append(these[kept])
            held += int((at[kept + 1] - at[kept]).sum())
            if held > BLOCK:
                search()
                held = 0
    if waiting:
        search()
    # Runs of windows [low, high) of strip n are those from upto[n] on.
    strip, lows, highs = (np.concatenate(x) for x in zip(*found, strict=True)) if found else np.zeros((3, 0), np.int64)
    by_strip = np.argsort(strip, kind="stable")
    lows, highs = lows[by_strip], highs[by_strip]
    runs = np.bincount(strip, minlength=len(plain))
    upto = np.cumsum(runs) - runs
    out: dict[str, list] = {k: [] for k in ("chunk", "shard", "entry", "low", "high")}
    begin = 0
    for number, n in zip(chunks, counts, strict=True):
        mine, own = code[begin : begin + n], key[begin : begin + n]
        begin += n
        later = np.flatnonzero(own > least[mine])
        part = np.flatnonzero((own == least[mine]) & (runs[mine] > 0))
        times = runs[mine[part]]
        at = np.arange(times.sum()) + np.repeat(upto[mine[part]] - (np.cumsum(times) - times), times)
        entry = [later, np.repeat(part, times)]
        low, high = [np.zeros(len(later), np.int64), lows[at]], [np.full(len(later), 2**32 - 1), highs[at]]
        entry, low, high = (np.concatenate(x).astype(np.uint32) for x in (entry, low, high))
        if len(entry):
            for k, v in zip(out, (number, shard, *(x.tobytes() for x in (entry, low, high))), strict=True):
                out[k].append(v)
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=True)})


def _symbols(data: np.ndarray, offsets: np.ndarray, rule: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Symbol hashes of texts, and the number of the first symbol of each."""
    if not rule.by_word:
        return _BYTE[data], offsets
    starts, ends, first = words(data, offsets)
    return span_hashes(data, starts, ends), first


def _minimizers(
    data: np.ndarray, offsets: np.ndarray, place: np.ndarray, one: np.ndarray, rule: Windows
) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Of the strips ``one``: the hash of the minimizer; hashes of the minimizer with half of the rest of a
    window after it, and before it; and whether some window doesn't hold that place.

    Equal windows hold their minimizer at the same place, so two strips with a window in common agree
    in one half at least. A hash that is none, as the strip ends before, is of no other strip.
    """
    if rule.by_word:
        starts, ends, first = words(data, offsets)
        low, high = first[one], first[one + 1]
    else:
        low, high = offsets[one], offsets[one + 1]
    at, half = low + place[one], (rule.size - rule.gram + 1) // 2

    def hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = np.maximum(a, low), np.minimum(b, high)
        s, e = (starts[a], ends[b - 1]) if rule.by_word else (a, b)
        order = np.argsort(s)
        out = np.empty(len(s), U64)
        out[order] = span_hashes(data, s[order], e[order])
        return out

    own = np.arange(len(one), dtype=U64)
    after = np.where(at + rule.gram + half <= high, hashes(at, at + rule.gram + half), own)
    before = np.where(at - half >= low, hashes(at - half, at + rule.gram), own)
    return hashes(at, at + rule.gram), [after, before], at + rule.size < high


def _shared(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which keys stand with different ids."""
    order = np.argsort(keys)
    edges = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
    differ = np.minimum.reduceat(ids[order], edges) != np.maximum.reduceat(ids[order], edges)
    out = np.empty(len(keys), bool)
    out[order] = np.repeat(differ, np.diff(np.append(edges, len(keys))))
    return out


def _with_repeats(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, rule: Windows) -> np.ndarray:
    """Texts that share a window hash with one of another id; others can be left out of the search."""
    symbols, first = _symbols(data, offsets, rule)
    hashes = run_hashes(symbols, rule.size)
    text = texts_of(first, 0, len(hashes))
    good = np.arange(rule.size, rule.size + len(hashes)) <= first[text + 1]
    hashes, text = hashes[good], text[good]
    # Most hashes stand alone in their slot and needn't be sorted.
    slot = (hashes >> U64(64 - SLOT_BITS)).astype(np.int64)
    full = np.bincount(slot, minlength=1 << SLOT_BITS)[slot] > 1
    hashes, text = hashes[full], text[full]
    if not len(hashes):
        return text
    order = np.argsort(hashes)
    hashes, text = hashes[order], text[order]
    edges = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    low, high = np.minimum.reduceat(ids[text], edges), np.maximum.reduceat(ids[text], edges)
    size = np.diff(np.append(edges, len(hashes)))
    return np.unique(text[np.repeat(low != high, size)])


def removed(table: pa.Table, answers: pa.Table, rule: Windows, shards: int) -> tuple[Chunk, np.ndarray]:
    """The chunk, and which of its symbols lie in a window of a smaller document."""
    chunk = load(table, rule.by_word)
    found = strips(chunk, rule, shards)
    cover = np.zeros(int(chunk.first[-1]) + 1, np.int32)

    def mark(begin: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        np.add.at(cover, begin + low, 1)
        np.add.at(cover, begin + high - 1 + rule.size, -1)

    if len(found.order):
        own = chunk.keys[found.text[found.order]]
        later = found.order[own > found.least[found.which]]
        mark(found.begin[later], np.zeros(len(later), np.int64), found.count[later])
        base = {int(s): int(np.searchsorted(found.shard, s)) for s in np.unique(found.shard)}
        for row in answers.to_pylist():
            entry, low, high = (np.frombuffer(row[k], np.uint32).astype(np.int64) for k in ("entry", "low", "high"))
            strip = base[row["shard"]] + entry
            # the answer holds for every place of the strip in the document with the smallest id
            times = found.high[strip] - found.low[strip]
            at = np.repeat(found.low[strip] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
            which = found.order[at]
            same = own[at] == np.repeat(found.least[strip], times)
            low, high = np.repeat(low, times)[same], np.repeat(high, times)[same]
            mark(found.begin[which[same]], low, np.minimum(high, found.count[which[same]]))
    return chunk, np.cumsum(cover[:-1]) > 0


Report = Callable[[Chunk, np.ndarray], pa.Table]


def without_repeats(
    docs: DataFrame, rule: Windows, resolve: Resolve, report: Report, schema: str, id_column: str, text_column: str
) -> DataFrame:
    """``report`` of every chunk; documents are moved once, and both passes read that exchange."""
    spark = docs.sparkSession
    source = docs.select(
        docs[id_column].cast("bigint").alias("doc_id"), F.coalesce(docs[text_column].cast("string"), F.lit("")).alias("text")
    )
    total = source.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    chunks = max(1, math.ceil(total / rule.chunk_bytes))
    # A strip repeats its neighbours' symbols: about (run + size) / run of the text in all.
    run = (rule.size - rule.gram + 2) / 2
    shards = max(1, math.ceil(total * (run + rule.size) / run / rule.shard_bytes))
    source = source.withColumn("h", F.xxhash64("text")).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "h"), F.lit(chunks)).cast("int"))
    source = source.repartition(chunks, "chunk")
    dealt = source.groupBy("chunk")
    sent = dealt.applyInArrow(lambda t: send(t, rule, shards), SENT)
    settled = sent.repartition(shards, "shard").groupBy("shard").applyInArrow(lambda t: settle(t, rule, resolve), ANSWERS)
    answers = settled.repartition(chunks, "chunk").groupBy("chunk")

    def finish(table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows:
            raise ValueError("an answer without a chunk")
        return report(*removed(table, found, rule, shards))

    return dealt.cogroup(answers).applyInArrow(finish, schema)
