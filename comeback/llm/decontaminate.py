"""Finds benchmark items in documents, also when some of their words were changed.

Distances are edit distances between word sequences. Windows of an item's size are embedded by
CGK random walks, which turn edit distance into Hamming distance; repeated samples of a few
places of the walk are compared with those of the item, and what agrees is checked exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comeback.llm.common import staged
from comeback.llm.textarrays import U64, buffers, mix, run_hashes, small_batches, span_hashes, words

#: A-Z in lower case, ASCII that is no letter or digit as space.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[[b for b in range(128) if not chr(b).isalnum()]] = 0x20


@dataclass(frozen=True)
class Matching:
    """``similarity``: 1 - edits / item words, from which a window counts. ``repeats`` samples of
    ``places`` walk places each; at a share p of agreeing places (about 0.5 at similarity 0.8) an
    item is missed with probability (1 - p^places)^repeats. ``walk``: steps per word of the item.
    ``block_bytes``: benchmark text taken into memory at once.
    """

    similarity: float = 0.8
    repeats: int = 64
    places: int = 3
    walk: int = 3
    seed: int = 7
    block_bytes: int = 64 << 20


def folded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and the number of the first word of each text."""
    data, offsets = buffers(column)
    data = FOLD[data]
    starts, ends, first = words(data, offsets)
    return span_hashes(data, starts, ends), first


def edits_allowed(size: int, similarity: float) -> int:
    return math.floor(size * (1 - similarity) + 1e-9)


def intact(size: int, similarity: float) -> int:
    """Length of a run of the item's words that as many edits as are allowed must leave whole."""
    edits = edits_allowed(size, similarity)
    return math.ceil((size - edits) / (edits + 1))


class Items:
    """Benchmark items ready for matching; ids and word hashes only."""

    def __init__(self, ids: list[int], column: pa.Array, rule: Matching):
        hashes, first = folded(column)
        self.rule = rule
        kept = [(i, hashes[a:b]) for i, a, b in zip(ids, first[:-1], first[1:], strict=True) if b > a]
        self.ids = [i for i, _ in kept]
        self.words = [w for _, w in kept]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.vocabulary = [np.unique(w, return_counts=True) for w in self.words]
        # Anchors: a run of the item's words of at most 3, that a match can't do without.
        self.grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        by_size: dict[int, list[tuple[np.ndarray, int]]] = {}
        for n, w in enumerate(self.words):
            size = min(3, intact(len(w), rule.similarity))
            by_size.setdefault(size, []).append((run_hashes(w, size), n))
        for size, found in by_size.items():
            grams = np.concatenate([g for g, _ in found])
            item = np.concatenate([np.full(len(g), n) for g, n in found])
            place = np.concatenate([np.arange(len(g)) for g, _ in found])
            order = np.argsort(grams, kind="stable")
            self.grams[size] = grams[order], item[order], place[order]
        rng = np.random.default_rng(rule.seed)
        self.salts = rng.integers(1, 2**62, rule.repeats).astype(U64)
        self.sampled = rng.random((rule.repeats, rule.places))
        self.keys = [self.sample(n, w[None, :]) for n, w in enumerate(self.words)]

    def plausible(self, item: int, hashes: np.ndarray, first: np.ndarray, rows: np.ndarray, allowed: int) -> np.ndarray:
        """Which windows (text, item, start) have enough of the item's words about them to be a match at all.

        Words that no edit touches stand in the stretch that is aligned, so nothing is lost.
        """
        words, weight = self.vocabulary[item]
        places = rows[:, 2][:, None] + np.arange(-allowed, int(self.sizes[item]) + allowed)[None, :]
        there = (places >= first[rows[:, 0]][:, None]) & (places < first[rows[:, 0] + 1][:, None])
        seen = hashes[np.clip(places, 0, len(hashes) - 1)]
        number = np.minimum(np.searchsorted(words, seen), len(words) - 1)
        row, column = np.nonzero(there & (words[number] == seen))
        held = np.zeros((len(rows), len(words)), bool)
        held[row, number[row, column]] = True
        return held @ weight >= self.sizes[item] - allowed

    def sample(self, item: int, windows: np.ndarray) -> np.ndarray:
        """Key of each window (a row of word hashes, 0 beyond the text) in each repeat.

        A walk reads the word it stands on and stays or goes on by a random bit that depends on
        the step and the word; the sampled steps make the key.
        """
        rule, size = self.rule, int(self.sizes[item])
        steps = rule.walk * size
        chosen = np.sort((self.sampled * steps).astype(np.int64), axis=1)
        count, repeats = len(windows), rule.repeats
        padded = np.concatenate([windows, np.zeros((count, 1), U64)], axis=1)
        end = padded.shape[1] - 1
        at = np.zeros((count, repeats), np.int64)
        keys = np.zeros((count, repeats), U64)
        rows = np.arange(count)[:, None]
        for step in range(int(chosen.max()) + 1):
            word = padded[rows, at]
            for place in range(rule.places):
                hit = chosen[:, place] == step
                if hit.any():
                    keys[:, hit] = mix(keys[:, hit] * U64(31) + word[:, hit] + U64(step))
            bit = mix(word + self.salts[None, :] * U64(2 * step + 1)) >> U64(63)
            at = np.minimum(at + bit.astype(np.int64), end)
        return keys


def fewest_edits(pattern: np.ndarray, text: np.ndarray) -> int:
    """Edits between the pattern and the nearest stretch of the text (bit-parallel columns)."""
    masks: dict[int, int] = {}
    for i, w in enumerate(pattern.tolist()):
        masks[w] = masks.get(w, 0) | (1 << i)
    size = len(pattern)
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score = full, 0, size
    best = score
    for w in text.tolist():
        equal = masks.get(w, 0)
        cross = (((equal & plus) + plus) ^ plus) | equal | minus
        up = minus | ~(cross | plus) & full
        down = plus & cross
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        vertical = equal | minus
        plus = down | ~(vertical | up) & full
        minus = up & vertical
        best = min(best, score)
    return best


def matches(hashes: np.ndarray, first: np.ndarray, items: Items) -> dict[int, dict[int, float]]:
    """Best similarity by item, by text, for a batch of texts."""
    rule = items.rule
    found: dict[int, dict[int, float]] = {}
    windows = []
    for size, (grams, item, place) in items.grams.items():
        runs = run_hashes(hashes, size)
        if not len(runs):
            continue
        slot = (grams >> U64(44)).astype(np.int64)
        present = np.zeros(1 << 20, bool)
        present[slot] = True
        at = np.flatnonzero(present[(runs >> U64(44)).astype(np.int64)])
        low = np.searchsorted(grams, runs[at])
        high = np.searchsorted(grams, runs[at], side="right")
        at, low, count = at[high > low], low[high > low], (high - low)[high > low]
        text = np.searchsorted(first, at, side="right") - 1
        inside = at + size <= first[text + 1]
        at, low, count, text = at[inside], low[inside], count[inside], text[inside]
        which = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        windows.append(np.stack([np.repeat(text, count), item[which], np.repeat(at, count) - place[which]], axis=1))
    if not windows:
        return found
    todo = np.unique(np.concatenate(windows), axis=0)
    for n in np.unique(todo[:, 1]).tolist():
        rows = todo[todo[:, 1] == n]
        size = int(items.sizes[n])
        allowed = edits_allowed(size, rule.similarity)
        for low in range(0, len(rows), 2048):
            part = rows[low : low + 2048]
            part = part[items.plausible(n, hashes, first, part, allowed)]
            if not len(part):
                continue
            begin, end = first[part[:, 0]], first[part[:, 0] + 1]
            places = part[:, 2][:, None] + np.arange(size)[None, :]
            there = (places >= begin[:, None]) & (places < end[:, None])
            seen = np.where(there, hashes[np.clip(places, 0, len(hashes) - 1)], U64(0))
            agree = (seen == items.words[n]).all(axis=1)
            changed = np.flatnonzero(~agree)
            if len(changed):
                agree[changed] = (items.sample(n, seen[changed]) == items.keys[n]).any(axis=1)
            for text, start, a, b in zip(part[agree, 0], part[agree, 2], begin[agree], end[agree], strict=True):
                known = found.get(int(text), {}).get(n, 0.0)
                if known == 1.0:
                    continue
                stretch = hashes[max(a, start - allowed) : min(b, start + size + allowed)]
                edits = fewest_edits(items.words[n], stretch)
                if edits <= allowed and 1 - edits / size > known:
                    found.setdefault(int(text), {})[n] = 1 - edits / size
    return {t: {items.ids[n]: s for n, s in by.items()} for t, by in found.items()}


def _blocks(benchmark: DataFrame, rule: Matching, id_column: str, text_column: str) -> Iterator[Items]:
    """The benchmark in blocks of a checked size."""
    source = benchmark.select(
        benchmark[id_column].cast("bigint").alias("item_id"), benchmark[text_column].cast("string").alias("text")
    ).where("text is not null")
    total = source.agg(F.sum(F.octet_length("text") + 50)).first()[0] or 0
    blocks = max(1, math.ceil(total / rule.block_bytes))
    for n in range(blocks):
        rows = source.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == n).orderBy("item_id", "text").collect()
        yield Items([r["item_id"] for r in rows], pa.array([r["text"] for r in rows], pa.string()), rule)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    rule: Matching | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    clean: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: how many items it holds, which, and the best similarity.

    Words are runs of letters and digits with A-Z in lower case. Null or empty texts hold nothing;
    items without words or without a text are in nothing; items with the same id count once; an
    empty benchmark finds nothing. An item of fewer than five words must stand unchanged. With
    ``clean`` the rows of ``docs`` that hold no item come back instead, all columns unchanged.

    The benchmark goes to the tasks in blocks of ``block_bytes``; with one block, as is usual, no
    row is moved. With more, each block is one pass, whose findings are stored and then added up.
    """
    rule = rule or Matching()
    text_place = docs.columns.index(text_column)
    kind = docs.schema[id_column].dataType.simpleString()
    key = [
        docs[id_column].alias("doc_id"),
        F.xxhash64(docs[text_column]).alias("h"),
        F.coalesce(F.length(docs[text_column]), F.lit(-1)).alias("n"),
    ]

    def finder(items: Items, everything: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (part for whole in batches for part in small_batches([whole], whole.num_columns - 1)):
                hashes, first = folded(batch.column(batch.num_columns - 1))
                found = matches(hashes, first, items)
                rows = [found.get(i, {}) for i in range(batch.num_rows)]
                out = pa.RecordBatch.from_arrays(
                    [
                        *batch.columns[:-1],
                        pa.array([sorted(x for x in r if x is not None) for r in rows], pa.list_(pa.int64())),
                        pa.array([max(r.values(), default=0.0) for r in rows], pa.float64()),
                    ],
                    names=[*batch.schema.names[:-1], "items", "best"],
                )
                yield out if everything else out.filter(pa.array([bool(r) for r in rows], pa.bool_()))

        return run

    def dropper(items: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small_batches(batches, text_place):
                hashes, first = folded(batch.column(text_place).cast(pa.string()))
                found = matches(hashes, first, items)
                yield batch.filter(pa.array([i not in found for i in range(batch.num_rows)], pa.bool_()))

        return run

    report = lambda f: f.select(
        "doc_id", F.size("items").cast("bigint").alias("n_items"), F.array_join("items", ",").alias("items"), "best"
    )
    text = docs[text_column].cast("string").alias("text")
    blocks = _blocks(benchmark, rule, item_column, item_text_column)
    current, following = next(blocks), next(blocks, None)
    if following is None:
        if clean:
            return docs.mapInArrow(dropper(current), docs.schema)
        return report(docs.select(key[0], text).mapInArrow(finder(current, True), f"doc_id {kind}, items array<bigint>, best double"))
    if clean:
        while current is not None:
            docs = staged(docs.mapInArrow(dropper(current), docs.schema), "clean")
            current, following = following, next(blocks, None)
        return docs
    parts = []
    while current is not None:
        found = docs.select(*key, text).mapInArrow(finder(current, False), f"doc_id {kind}, h bigint, n int, items array<bigint>, best double")
        parts.append(staged(found.dropDuplicates(["doc_id", "h", "n"]), "found"))
        current, following = following, next(blocks, None)
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    summed = union.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("g"), F.col("n").alias("m")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("best").alias("best")
    )
    left = docs.select(*key)
    same = left["doc_id"].eqNullSafe(summed["d"]) & left["h"].eqNullSafe(summed["g"]) & (left["n"] == summed["m"])
    joined = left.join(summed, same, "left")
    none = F.array().cast("array<bigint>")
    return report(joined.select("doc_id", F.coalesce("items", none).alias("items"), F.coalesce("best", F.lit(0.0)).alias("best")))
