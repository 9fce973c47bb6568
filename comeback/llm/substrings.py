"""Removes words that stand in a run of words of an earlier document.

Shards of the corpus are the reference: each builds a suffix automaton of its strips in the order
of document ids, and each strip is streamed through the automaton of the smaller documents before
it is added. Where the matching statistic reaches the window size, a window is repeated.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from comeback.llm.passages import Chunk, Windows, without_repeats


class SuffixAutomaton:
    """Automaton of all runs of the added sequences."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, sequence: list[int]) -> None:
        state = 0
        for symbol in sequence:
            state = self._extend(state, symbol)

    def _split(self, state: int, target: int, symbol: int) -> int:
        """A copy of ``target`` for the shorter runs that end in ``state`` and the symbol."""
        copy = len(self.next)
        self.next.append(dict(self.next[target]))
        self.link.append(self.link[target])
        self.length.append(self.length[state] + 1)
        self.link[target] = copy
        while state >= 0 and self.next[state].get(symbol) == target:
            self.next[state][symbol] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, symbol: int) -> int:
        target = self.next[last].get(symbol)
        if target is not None:  # the run is known from an earlier sequence
            if self.length[target] == self.length[last] + 1:
                return target
            return self._split(last, target, symbol)
        new = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        state = last
        while state >= 0 and symbol not in self.next[state]:
            self.next[state][symbol] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][symbol]
            exact = self.length[target] == self.length[state] + 1
            self.link[new] = target if exact else self._split(state, target, symbol)
        return new

    def ends(self, sequence: list[int], least: int) -> list[int]:
        """Places where a run of at least ``least`` symbols that is in the automaton ends."""
        out, state, length = [], 0, 0
        step, link, longest = self.next, self.link, self.length
        for at, symbol in enumerate(sequence):
            while state and symbol not in step[state]:
                state = link[state]
                length = longest[state]
            if symbol in step[state]:
                state = step[state][symbol]
                length += 1
                if length >= least:
                    out.append(at)
        return out


def by_automaton(size: int):
    """Resolves strips of words by streaming them through the automaton of smaller documents."""

    def resolve(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
        number: dict[bytes, int] = {}
        raw = data.tobytes()
        texts = [
            [number.setdefault(w, len(number)) for w in raw[a:b].split(b" ")]
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
        ]
        automaton = SuffixAutomaton()
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
        order = np.argsort(ids, kind="stable").tolist()
        waiting: list[int] = []
        for n in order:
            if waiting and ids[waiting[-1]] != ids[n]:
                for m in waiting:
                    if len(out[m]) < len(texts[m]) - size + 1:
                        automaton.add(texts[m])
                waiting = []
            out[n] = np.array(automaton.ends(texts[n], size), np.int64) - (size - 1)
            waiting.append(n)
        return out

    return resolve


SCHEMA = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
KEPT_SCHEMA = "doc_id bigint, n_words bigint, n_removed bigint, kept string"


def _kept(chunk: Chunk, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    count = np.diff(chunk.first)
    before = np.concatenate([[0], np.cumsum(gone)])
    removed = before[chunk.first[1:]] - before[chunk.first[:-1]]
    sizes = chunk.ends - chunk.starts + 1
    stay = chunk.data[np.repeat(~gone, sizes)]
    at = np.concatenate([[0], np.cumsum(np.where(gone, 0, sizes))])[chunk.first]
    raw = stay.tobytes()
    return count, removed, [raw[a : max(a, b - 1)] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _digest(chunk: Chunk, gone: np.ndarray) -> pa.Table:
    count, removed, kept = _kept(chunk, gone)
    hashes = [hashlib.sha256(k).hexdigest() for k in kept]
    return pa.table({"doc_id": chunk.ids.cast(pa.int64()), "n_words": count, "n_removed": removed, "kept_sha256": pa.array(hashes, pa.string())})


def _text(chunk: Chunk, gone: np.ndarray) -> pa.Table:
    count, removed, kept = _kept(chunk, gone)
    texts = pa.array([k.decode() for k in kept], pa.string())
    return pa.table({"doc_id": chunk.ids.cast(pa.int64()), "n_words": count, "n_removed": removed, "kept": texts})


def remove_repeated_words(
    docs: DataFrame, size: int = 13, texts: bool = False, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: its words, how many were removed, and what is left.

    A word goes if some window of ``size`` words over it also starts in a document with a smaller
    id. Words are runs without ASCII white space, as they are. Null and empty texts have no words.
    A null id is larger than all others; rows with the same id (or without one) don't remove each
    other's words. Other columns are not looked at. ``texts`` gives the text left in place of its
    SHA-256.
    """
    rule = Windows(by_word=True, size=size, gram=min(3, size))
    schema, report = (KEPT_SCHEMA, _text) if texts else (SCHEMA, _digest)
    return without_repeats(docs, rule, by_automaton(size), report, schema, id_column, text_column)
