"""Runs of words that repeat with a period, found in tiles of each scale.

A run is a longest stretch whose words stand again ``period`` words later, and which holds its
smallest period twice or more. Periods are searched by octave [P, 2P): a run with such a period
covers a boundary, a word number divisible by the octave's step, and its tile around that boundary
is all it takes to see it there. So

1. documents are cut into words, and the tiles that may hold a run are exploded, one row each;
2. each tile is solved alone: Z-functions of what follows its boundary and, backwards, of what goes
   before give for every period of the octave how far it holds on both sides;
3. the fragments are shuffled by document and period and stitched where they overlap by a period.

Which tiles may hold a run is decided without loss: within it, some k words in a row (k is the
step) stand again less than 2P words later.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from comeback.llm.common import staged
from comeback.llm.textarrays import U64, mix, run_hashes, small_batches

#: Where word i of a document is taken from, given its id and number of words; None: as they stand.
Source = Callable[[int | None, int], np.ndarray | None]


@dataclass(frozen=True)
class RunRule:
    """``min_words``: least length of a run, which always holds its period twice."""

    min_words: int = 12

    def step(self, octave: int) -> int:
        """Words between boundaries; a run of the octave matches at least so many words in a row."""
        return max(octave, self.min_words - (2 * octave - 1))


def octaves(n: int) -> Iterator[int]:
    """Smallest period of each octave that a text of ``n`` words can hold twice."""
    octave = 1
    while 2 * octave <= n:
        yield octave
        octave *= 2


def words_of(text: bytes, row_id: int | None, source: Source | None) -> list[bytes]:
    """Words between ASCII white space, rearranged by ``source``."""
    words = text.split()
    if source is not None and words:
        places = source(row_id, len(words))
        if places is not None:
            words = [words[i] for i in places.tolist()]
    return words


def numbered(words: list[bytes]) -> np.ndarray:
    """Each word as the number of its first occurrence's rank: equal words, equal numbers."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def boundaries(symbols: np.ndarray, rule: RunRule) -> Iterator[tuple[int, np.ndarray]]:
    """(octave, boundaries) of the tiles that may hold a run.

    Equal stretches have equal hashes, so none is missed; a collision only adds a tile. Stretches
    can only repeat where shorter ones do.
    """
    n = len(symbols)
    least = min(rule.step(o) for o in (1, 2, 4, 8))
    if n < max(rule.min_words, least + 1):
        return
    spread = mix(symbols.astype(U64) + U64(1))
    repeats = np.flatnonzero(_again(run_hashes(spread, least), np.arange(n - least + 1), n))
    for octave in octaves(n):
        step = rule.step(octave)
        places = repeats[repeats + step <= n]
        if not len(places):
            continue
        hashes = run_hashes(spread, step)[places]
        near = places[_again(hashes, places, 2 * octave, ahead=True)]
        if len(near):
            yield octave, np.unique(np.concatenate([-(-near // step) * step, (near // step + 1) * step]))
        if step == octave:  # from here on steps grow
            repeats = places[_again(hashes, places, n)]


def _again(hashes: np.ndarray, places: np.ndarray, within: int, ahead: bool = False) -> np.ndarray:
    """Which places have their hash again less than ``within`` further on (or, unless ``ahead``, back)."""
    order = np.lexsort((places, hashes))
    h, p = hashes[order], places[order]
    close = (h[1:] == h[:-1]) & (p[1:] - p[:-1] < within)
    found = np.zeros(len(h), bool)
    found[order[:-1][close]] = True
    if not ahead:
        found[order[1:][close]] = True
    return found


def z_function(word: list[int]) -> list[int]:
    """Length of the common prefix of the list with each of its suffixes; the whole at 0."""
    n = len(word)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and word[k] == word[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _primes(n: int) -> list[int]:
    found, p = [], 2
    while p * p <= n:
        if n % p == 0:
            found.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return found + [n] if n > 1 else found


def solve_tile(tile: list[int], at: int, octave: int, step: int) -> list[tuple[int, int, int]]:
    """(period, start, end) within the tile of the stretches around its boundary, word ``at``.

    Only smallest periods are told: if a period holds for a whole number of shorter ones, so does
    the run, and an octave before finds it.
    """
    right = tile[at:]
    ahead = z_function(right)
    top = min(2 * octave - 1, len(right) - 1)
    if top < octave:
        return []
    back = tile[:at][::-1]
    # Reversed, the words before boundary + period, for each period of the octave.
    before = tile[max(0, at + octave - step) : at + top][::-1]
    behind = z_function([*back, -1, *before])
    found = []
    for period in range(octave, top + 1):
        lcp = ahead[period]
        lcs = min(behind[len(back) + 1 + top - period], len(back)) if top - period < len(before) else 0
        if lcs + lcp < step or any(ahead[period // p] >= period - period // p for p in _primes(period)):
            continue
        found.append((period, at - lcs, at + period + lcp))
    return found


def _explode(docs: DataFrame, rule: RunRule, source: Source | None, hold: bool) -> DataFrame:
    """From (doc_id, text): a row per tile, and one per document, with its words if it has tiles or ``hold``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        row = (task.partitionId() if task else 0) << 40
        for batch in small_batches(batches, 1):
            texts = batch.column(1).cast(pa.large_string()).cast(pa.large_binary()).to_pylist()
            out = _Rows()
            for doc_id, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                row += 1
                words = words_of(text or b"", doc_id, source)
                symbols = numbered(words)
                n, tiles = len(symbols), 0
                for octave, bounds in boundaries(symbols, rule):
                    step = rule.step(octave)
                    for b in bounds.tolist():
                        low, high = max(0, b - step), min(n, b + 2 * octave + step)
                        if b + octave < high:
                            tiles += 1
                            out.add(row, None, octave, step, low, b, symbols[low:high].astype(np.int32).tobytes(), None, None)
                    if out.size > 1 << 23:
                        yield out.batch()
                joined = b" ".join(words)
                if tiles or hold:
                    out.add(row, doc_id, None, None, None, None, None, n, joined)
                else:
                    out.add(-row, doc_id, None, None, None, None, None, n, hashlib.sha256(joined).hexdigest().encode())
            yield out.batch()

    return docs.mapInArrow(run, _Rows.SCHEMA)


class _Rows:
    """Rows of ``_explode``: tiles have an octave; documents a number of words, and ``held`` is the
    text to look at again, or, with a negative ``row``, the final digest."""

    SCHEMA = "doc_id bigint, row bigint, octave bigint, step bigint, low bigint, boundary bigint, symbols binary, n bigint, held binary"
    TYPES = [pa.int64()] * 6 + [pa.binary(), pa.int64(), pa.binary()]
    NAMES = ["doc_id", "row", "octave", "step", "low", "boundary", "symbols", "n", "held"]

    def __init__(self) -> None:
        self.rows: list[list] = []
        self.size = 0

    def add(self, row, doc_id, octave, step, low, boundary, symbols, n, held) -> None:
        self.rows.append([doc_id, row, octave, step, low, boundary, symbols, n, held])
        self.size += len(symbols or b"") + len(held or b"") + 64

    def batch(self) -> pa.RecordBatch:
        columns = [pa.array([r[i] for r in self.rows], t) for i, t in enumerate(self.TYPES)]
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays(columns, names=self.NAMES)


def _solve(tiles: DataFrame) -> DataFrame:
    """(row, period, start, stop) of every fragment, word numbers of the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            columns = [c.to_pylist() for c in batch.columns]
            for row, octave, step, low, boundary, symbols in zip(*columns, strict=True):
                tile = np.frombuffer(symbols, np.int32).tolist()
                out += [(row, p, low + s, low + e) for p, s, e in solve_tile(tile, boundary - low, octave, step)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], pa.int64()) for i in range(4)], names=["row", "period", "start", "stop"]
            )

    picked = tiles.select("row", "octave", "step", "low", "boundary", "symbols")
    return picked.mapInArrow(run, "row bigint, period bigint, start bigint, stop bigint")


def stitched(fragments: DataFrame, rule: RunRule) -> DataFrame:
    """(row, start, length, period): fragments of a period joined where they overlap by a period."""
    dealt = Window.partitionBy("row", "period").orderBy("start", "stop")
    reach = F.max("stop").over(dealt.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.when(reach.isNull() | (F.col("start") + F.col("period") > reach), 1).otherwise(0)
    pieces = fragments.withColumn("_cut", cut).withColumn("_run", F.sum("_cut").over(dealt))
    runs = pieces.groupBy("row", "period", "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    long_enough = F.col("stop") - F.col("start") >= F.greatest(F.lit(rule.min_words), 2 * F.col("period"))
    return runs.where(long_enough).select("row", "start", (F.col("stop") - F.col("start")).alias("length"), "period")


def collapse_runs(
    docs: DataFrame,
    rule: RunRule | None = None,
    source: Source | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    texts: bool = True,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, ``runs`` (array of start, length, period by start,
    then period) and what is left once the copies after each run's first period are dropped:
    ``collapsed`` (words joined by one space; left out unless ``texts``) and its SHA-256.

    A null or empty text has no words, no runs and an empty ``collapsed``. Repeated rows, and rows
    without an id, are judged each on its own. An empty table gives no rows; other columns are not
    looked at. A run of 1,000,000 equal words is one run; no length or number of runs is capped. One
    document's words and runs have to fit a task; its tiles are spread over tasks.
    """
    rule = rule or RunRule()
    narrow = docs.select(docs[id_column].cast("bigint").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    exploded = staged(_explode(narrow, rule, source, texts), "tiles")
    runs = stitched(_solve(exploded.where("octave is not null")), rule)
    entry = F.struct("start", "length", "period")
    listed = runs.groupBy("row").agg(F.array_sort(F.collect_list(entry)).alias("runs"))
    whole = exploded.where("octave is null").select("doc_id", "row", "n", "held")
    found = whole.where("row > 0").join(listed, "row", "left").select("doc_id", "n", "held", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, digests = [], []
            for held, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = held.split(b" ") if held else []
                stays = np.ones(len(words), bool)
                for span in spans or ():
                    stays[span["start"] + span["period"] : span["start"] + span["length"]] = False
                joined = b" ".join(w for w, s in zip(words, stays.tolist(), strict=True) if s) if spans else held
                digests.append(hashlib.sha256(joined).hexdigest())
                kept.append(joined.decode("utf-8") if texts else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(kept, pa.string()), pa.array(digests, pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed", "collapsed_sha256"],
            )

    shape = "array<struct<start:bigint,length:bigint,period:bigint>>"
    done = found.mapInArrow(run, f"doc_id bigint, n_words bigint, runs {shape}, collapsed string, collapsed_sha256 string")
    none = F.array().cast(shape)
    done = done.withColumn("runs", F.coalesce("runs", none))
    if texts:
        return done
    digest = F.col("held").cast("string").alias("collapsed_sha256")
    plain = whole.where("row < 0").select("doc_id", F.col("n").alias("n_words"), none.alias("runs"), digest)
    return done.drop("collapsed").unionByName(plain)


def longest_run(result: DataFrame) -> DataFrame:
    """Add start, length, period and exponent_milli of the longest run, and ``runs_sha256``.

    Ties go to the smallest start, then the smallest period. No run: four nulls, and the digest of
    an empty text.
    """
    best = F.aggregate(
        "runs",
        F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"),
        lambda a, r: F.when(a.isNull() | (r["length"] > a["length"]), r).otherwise(a),
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return result.withColumn("_best", best).select(
        *[c for c in result.columns if c != "runs"],
        F.size("runs").cast("bigint").alias("n_runs"),
        *[F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("_best.length * 1000 div _best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
    )
