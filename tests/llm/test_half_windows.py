"""Shards of operators 6 and 7 without Spark: what is left out of the search, and that no window is lost by it."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from comeback.llm import passages
from comeback.llm.passages import Windows
from comeback.llm.substrings import by_automaton
from comeback.llm.suffix_arrays import by_intervals, sorted_rotations

RULES = {"bytes": (Windows(by_word=False, size=20, gram=6), by_intervals(20)), "words": (Windows(by_word=True, size=7, gram=3), by_automaton(7))}


def chunk_of(texts):
    kinds = {"doc_id": pa.int64(), "text": pa.large_string(), "h": pa.int64(), "chunk": pa.int32()}
    columns = (range(len(texts)), texts, range(len(texts)), [0] * len(texts))
    return pa.table({k: pa.array(list(v), t) for (k, t), v in zip(kinds.items(), columns, strict=True)})


def covered(texts, rule, resolve):
    chunk = chunk_of(texts)
    found = passages.settle(passages.send(chunk, rule, 1), rule, resolve)
    loaded, gone = passages.removed(chunk, found, rule, 1)
    return [gone[a:b].tolist() for a, b in zip(loaded.first[:-1], loaded.first[1:], strict=True)]


def brute(texts, rule):
    seen, out = set(), []
    for text in texts:
        symbols = text.split(" ") if rule.by_word else list(text.encode())
        windows = [tuple(symbols[i : i + rule.size]) for i in range(len(symbols) - rule.size + 1)]
        gone = [False] * len(symbols)
        for i, window in enumerate(windows):
            if window in seen:
                gone[i : i + rule.size] = [True] * rule.size
        seen |= set(windows)
        out.append(gone)
    return out


@pytest.mark.parametrize("kind", RULES)
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_nothing_is_lost(kind, seed):
    rule, resolve = RULES[kind]
    rng = random.Random(seed)
    joint = " " if rule.by_word else ""
    base = [[rng.choice("ab") for _ in range(200)], ["a"] * 90, list("ab") * 40, list("aab") * 40, [rng.choice("abcdef") for _ in range(300)]]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            part = rng.choice(base)
            start = rng.randrange(len(part))
            parts += part[start : start + rng.randint(1, 60)]
            parts += [rng.choice("abcxyz") for _ in range(rng.randint(0, 3))]
        texts.append(joint.join(parts))
    assert covered(texts, rule, resolve) == brute(texts, rule)


def test_a_minimizer_alone_is_not_searched(monkeypatch):
    rule, resolve = RULES["bytes"]
    rng = random.Random(4)
    line = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    texts = [line(14) + run + line(14) for run in ["".join(rng.choice("0123456789") for _ in range(6)) for _ in range(30)] for _ in range(20)]
    looked = []
    real = passages._with_repeats
    monkeypatch.setattr(passages, "_with_repeats", lambda data, offsets, *rest: looked.append(len(offsets) - 1) or real(data, offsets, *rest))
    assert covered(texts, rule, resolve) == brute(texts, rule)
    assert sum(looked) == 0
    copy = texts[0][:30] + line(9)
    assert covered([*texts, copy], rule, resolve) == brute([*texts, copy], rule)
    assert 0 < sum(looked) < 20


def test_no_hash_stands_twice():
    rule = RULES["bytes"][0]
    data = np.arange(40, dtype=np.uint8)
    assert not len(passages._with_repeats(data, np.array([0, 40]), np.array([7]), rule))


@pytest.mark.parametrize("n", [1, 5, 8, 40, 3000])
def test_rotations(n):
    text = np.random.default_rng(n).integers(97, 99, n).astype(np.uint8)
    for depth in (1, 8, 9, 21):
        order = sorted_rotations(text, depth)
        around = np.tile(text, depth // n + 2)
        begins = [around[i : i + depth].tobytes() for i in order]
        assert sorted(order.tolist()) == list(range(n)) and begins == sorted(begins)
