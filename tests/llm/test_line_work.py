"""What the line dedup leaves undone: words of repeated rows, keys no other line has, most of a comparison."""

from __future__ import annotations

import random

from comeback.llm import fuzzy_lines
from comeback.llm.fuzzy_lines import WHOLE
from tests.llm.fixtures import frame
from tests.llm.test_fuzzy_lines import edits


def test_repeated_rows_count_once(spark):
    """4,000 rows alike, without an id, of 40 words: more than a counter of 16 bits holds."""
    text = " ".join(f"word{i}" for i in range(40))
    sims = [
        [r["sim"] for r in fuzzy_lines._hashed(fuzzy_lines._rows(frame(spark, [(None, text)] * n), "doc_id", "text"), WHOLE).collect()]
        for n in (1, 4000)
    ]
    assert len(sims[0]) == 1 and sims[0] == sims[1]


def test_unshared_hashes_make_no_key(spark):
    rows = [(1, 9, [1, 2, 3]), (2, 9, [2, 3, 4]), (3, 9, [5, 6])]
    lines = spark.createDataFrame(rows, "f bigint, size int, sketch array<bigint>")
    got = {r["f"]: r["sketch"] for r in fuzzy_lines._shared_elements(lines).collect()}
    assert got == {1: [2, 3], 2: [2, 3]}


def test_comparison_is_exact(spark):
    """Pairs on both sides of the limit, edits at the start, at the end and spread, of unequal lengths."""
    rng = random.Random(3)
    pairs = []
    for n in range(300):
        s = "".join(rng.choice("abcdeü ") for _ in range(rng.randint(1, 60)))
        t = list(s)
        low, high = rng.choice([(0.0, 0.3), (0.7, 1.0), (0.0, 1.0)])
        for _ in range(rng.randint(0, len(s) // 3 + 1)):
            at = min(int((low + (high - low) * rng.random()) * (len(t) + 1)), len(t))
            t[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "yz"])
        pairs.append((n, s, "".join(t)))
    got = spark.createDataFrame(pairs, "n int, s string, t string").select("n", fuzzy_lines._same("s", "t", WHOLE).alias("same")).collect()
    want = {n: edits(s, t) <= int(0.2 * max(len(s), len(t)) + 1e-9) for n, s, t in pairs}
    assert {r["n"]: r["same"] for r in got} == want
    assert 60 < sum(want.values()) < 240
