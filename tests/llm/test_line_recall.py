"""Recall of the line dedup against edit similarity alone."""

from __future__ import annotations

import random

from comeback.llm.fuzzy_lines import WHOLE, without_repeated_lines
from tests.llm.fixtures import frame
from tests.llm.test_fuzzy_lines import edits

KINDS = {"5/1": (5, 1), "10/1": (10, 1), "20/1": (20, 1), "20/3": (20, 3), "30/4": (30, 4)}


def pairs(count=80):
    """(kind, line, line) with so many words changed, all of edit similarity 0.8 or more."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    out = []
    for kind, (n, changed) in KINDS.items():
        found = 0
        while found < count:
            line = [rng.choice(words) for _ in range(n)]
            other = list(line)
            for i in rng.sample(range(n), changed):
                other[i] = rng.choice(words)
            a, b = " ".join(line), " ".join(other)
            if a != b and edits(a, b) <= 0.2 * max(len(a), len(b)):
                out.append((kind, a, b))
                found += 1
    return out


def test_recall(spark):
    lines = pairs()
    rows = [(2 * n + i, text) for n, (_, *both) in enumerate(lines) for i, text in enumerate(both)]
    got = {r["doc_id"]: r["lines_removed"] for r in without_repeated_lines(frame(spark, rows), WHOLE).collect()}
    assert not any(got[2 * n] for n in range(len(lines)))
    recall = {k: sum(got[2 * n + 1] for n, x in enumerate(lines) if x[0] == k) / sum(x[0] == k for x in lines) for k in KINDS}
    print(recall)
    assert min(recall.values()) >= 0.95
