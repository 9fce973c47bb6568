"""Fuzzy line dedup against a row-by-row version."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from comeback.llm import fuzzy_lines
from comeback.llm.fuzzy_lines import BLOCK_BITS, BLOCKS, without_repeated_lines
from tests.llm.fixtures import documents, frame

WORD = re.compile("[a-z0-9\x80-\U0010ffff]+")
BIG = (1 << 63) - 1


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def word_hashes(spark, words: set[str]) -> dict[str, int]:
    pairs = spark.createDataFrame([(w,) for w in sorted(words)], "w string").select("w", F.xxhash64("w").alias("x")).collect()
    return {r["w"]: r["x"] % (1 << 64) for r in pairs}


def sketches(spark, names: list[str], most: int) -> list[set[int]]:
    """The smallest hashes of two words in a row, for each line."""
    pairs = {p for name in names for p in zip(name.split(" "), name.split(" ")[1:], strict=False)}
    rows = spark.createDataFrame(sorted(pairs) or [("", "")], "a string, b string").select("a", "b", F.xxhash64("a", "b").alias("x")).collect()
    known = {(r["a"], r["b"]): r["x"] for r in rows}
    return [set(sorted({known[p] for p in zip(n.split(" "), n.split(" ")[1:], strict=False)})[:most]) for n in names]


def brute(spark, rows, similarity=0.8, min_words=5, sketch=0):
    texts = sorted({(BIG if d is None else d, t) for d, t in rows if t is not None}, key=lambda r: r[0])
    hashed = {r["t"]: r["h"] for r in spark.createDataFrame([(t,) for _, t in texts] or [("",)], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    spots = []
    for o, t in texts:
        for at, line in enumerate(t.split("\n")):
            words = WORD.findall(line.lower())
            if len(words) >= min_words:
                spots.append(((o, hashed[t], at), words, t))
    known = word_hashes(spark, {w for _, ws, _ in spots for w in ws} | {"x"})
    lines: dict[str, list] = {}
    for spot, words, t in spots:
        lines.setdefault(" ".join(words), []).append((spot, t))
    names = sorted(lines)
    sims = []
    for name in names:
        words = name.split(" ")
        sims.append(sum(1 << b for b in range(64) if 2 * sum(known[w] >> b & 1 for w in words) > len(words)))
    small = sketches(spark, names, sketch) if sketch else [set()] * len(names)
    up = list(range(len(names)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    mask = (1 << BLOCK_BITS) - 1
    for i in range(len(names)):
        for j in range(i):
            agree = sum((sims[i] >> BLOCK_BITS * k & mask) == (sims[j] >> BLOCK_BITS * k & mask) for k in range(BLOCKS))
            if agree >= 2 or len(small[i] & small[j]) >= 2:
                longest = max(len(names[i]), len(names[j]))
                if edits(names[i], names[j]) <= int((1 - similarity) * longest + 1e-9):
                    up[find(i)] = find(j)
    groups: dict[int, list] = {}
    for n, name in enumerate(names):
        groups.setdefault(find(n), []).extend(lines[name])
    gone = set()
    for spots in groups.values():
        first = min(s for s, _ in spots)
        gone |= {(s[0], t, s[2]) for s, t in spots if s != first}
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, None, 0, 0))
            continue
        parts = t.split("\n")
        left = [p for at, p in enumerate(parts) if (BIG if d is None else d, t, at) not in gone]
        out.append((d, "\n".join(left), len(parts), len(parts) - len(left)))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text", "lines_in", "lines_removed").collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_small(spark, seed):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(40)] + ["Über", "the", "of"]
    base = [[rng.choice(words) for _ in range(rng.randint(3, 30))] for _ in range(10)]
    rows = [(900, None), (901, ""), (902, "\n\n"), (None, "a b c d e\nf"), (None, "a b c d e"), (903, "a b c d e")]
    for n in range(40):
        lines = []
        for _ in range(rng.randint(0, 5)):
            line = list(rng.choice(base))
            if rng.random() < 0.4:
                line[rng.randrange(len(line))] = rng.choice(words)
            lines.append(rng.choice([" ", ", ", "  "]).join(line) + rng.choice(["", ".", " !"]))
        rows.append((rng.choice([n, 7]), "\n".join(lines)))
    rows += rows[8:10]
    docs = frame(spark, rows, extra=True).withColumn("lines_in", F.lit(5)).withColumn("gone", F.lit("x"))
    assert result(without_repeated_lines(docs)) == brute(spark, rows)


def test_whole_table(spark):
    rows = documents("sf0.001")
    assert result(without_repeated_lines(frame(spark, rows))) == brute(spark, rows)


def test_whole_table_with_sketches(spark):
    """The rule that the query and the pipeline use."""
    rows = documents("sf0.001")
    assert result(without_repeated_lines(frame(spark, rows), fuzzy_lines.WHOLE)) == brute(spark, rows, sketch=fuzzy_lines.WHOLE.sketch)


def test_no_rows(spark):
    assert result(without_repeated_lines(frame(spark, []))) == []


def test_long_lines_are_hashed_alike(spark, monkeypatch):
    """Counters in sums and bit by bit give the same SimHash, and the same lines go."""
    rows = [(n, " ".join(f"w{i % (7 + n)}" for i in range(k)) + "\nx") for n, k in enumerate((6, 300, 70_000))]
    rows.append((9, rows[1][1]))
    docs = fuzzy_lines._rows(frame(spark, rows), "doc_id", "text")
    want = sorted(map(tuple, fuzzy_lines._hashed(docs, fuzzy_lines.LineRules()).collect()))
    monkeypatch.setattr(fuzzy_lines, "LONG", 10)
    assert sorted(map(tuple, fuzzy_lines._hashed(docs, fuzzy_lines.LineRules()).collect())) == want
    assert result(without_repeated_lines(frame(spark, rows)))[3][1:] == ("x", 2, 1)
