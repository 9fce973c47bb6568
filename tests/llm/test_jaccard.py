"""Set join against brute force, with groups larger than a block."""

from __future__ import annotations

import random

import numpy as np
import pytest

from comeback.llm.components import connected
from comeback.llm.jaccard import SetJoin, bucket_sums, link_sets, similar_documents
from tests.llm.fixtures import documents, frame


def brute(rows, percent=90, gram=3):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in rows:
        words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", (text or "").translate(table))]
        sets.append({tuple(words[i : i + gram]) for i in range(len(words) - gram + 1)} if len(words) >= gram else ({tuple(words)} if words else set()))
    holders: dict = {}
    for n, s in enumerate(sets):
        for x in s if rows[n][0] is not None else ():
            holders.setdefault(x, []).append(n)
    up = list(range(len(rows)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for n, s in enumerate(sets):
        common: dict = {}
        for x in s if rows[n][0] is not None else ():
            for m in holders[x]:
                if m > n:
                    common[m] = common.get(m, 0) + 1
        for m, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[m]) - c):
                a, b = find(n), find(m)
                up[max(a, b)] = min(a, b)
    least: dict = {}
    for n, (d, _) in enumerate(rows):
        if d is not None:
            least[find(n)] = min(least.get(find(n), d), d)
    return sorted(((d, len(sets[n]), None if d is None else least[find(n)]) for n, (d, _) in enumerate(rows)), key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def near_copies(seed, families=6, copies=25):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "The"]
    rows = [(900, None), (901, ""), (902, "one"), (903, "ONE"), (904, "one two"), (905, "one two"), (None, "one two"), (None, None)]
    n = 0
    for _ in range(families):
        base = [rng.choice(words) for _ in range(rng.choice([5, 12, 14, 40, 200]))]
        for _ in range(copies):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            if rng.random() < 0.3:
                copy = copy[: -rng.randint(1, 2)]
            rows.append((n, rng.choice([" ", "\n"]).join(copy)))
            n += 1
            if rng.random() < 0.1:
                base = copy
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("block", [4, 4096])
def test_near_copies(spark, seed, block):
    rows = near_copies(seed)
    got = result(similar_documents(frame(spark, rows, extra=True), SetJoin(block=block, bin_bytes=4000)))
    assert got == brute(rows)


def test_whole_table(spark):
    rows = documents("sf0.01")
    assert result(similar_documents(frame(spark, rows))) == brute(rows)


def test_no_rows(spark):
    assert result(similar_documents(frame(spark, []))) == []


def test_similar_sets_share_a_bucket():
    rng = np.random.default_rng(3)
    for size in [*range(1, 60), 100, 333, 1000]:
        for _ in range(20):
            base = rng.integers(0, 2**63, size, dtype=np.int64).astype(np.uint64)
            cut = rng.integers(0, size // 19 + 2)
            other = np.concatenate([base[cut:], rng.integers(0, 2**63, rng.integers(0, size // 19 + 2), dtype=np.int64).astype(np.uint64)])
            both = len(np.intersect1d(base, other))
            if len(other) and 100 * both >= 90 * (len(base) + len(other) - both):
                assert np.intersect1d(bucket_sums(base, 90), bucket_sums(other, 90)).size


def test_tree_links_what_brute_force_links():
    rng = np.random.default_rng(4)
    base = [rng.integers(0, 2**63, 80, dtype=np.int64).astype(np.uint64) for _ in range(5)]
    sets = []
    for _ in range(120):
        s = base[rng.integers(5)].copy()
        change = rng.integers(0, 6)
        s[:change] = rng.integers(0, 2**63, change, dtype=np.int64).astype(np.uint64)
        sets.append(np.sort(s))
    forest = link_sets(sets, 90, 3)
    up = {i: i for i in range(len(sets))}
    find = lambda a: a if up[a] == a else find(up[a])
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if 100 * both >= 90 * (160 - both):
                up[max(find(i), find(j))] = min(find(i), find(j))
    assert [forest.find(i) for i in range(len(sets))] == [find(i) for i in range(len(sets))]


def test_components_of_a_long_path(spark):
    rng = random.Random(5)
    names = rng.sample(range(1000), 80)
    links = [(a, b) for a, b in zip(names, names[1:], strict=False)] + [(5000, 5001), (5001, 5001), (None, 3), (7000, 7000)]
    got = dict(result(connected(spark.createDataFrame(links, "a bigint, b bigint"))))
    assert got == {n: min(names) for n in names} | {5000: 5000, 5001: 5000}
