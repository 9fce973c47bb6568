"""Periodic runs against a word-by-word version."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from comeback.llm import periodic, queries
from tests.llm.fixtures import DATA, documents, frame


def brute(words, least=12):
    """(start, length, period) of every run, by comparing each word with the one ``period`` later."""
    n, found = len(words), []
    for period in range(1, n // 2 + 1):
        i = 0
        while i + period < n:
            j = i
            while j + period < n and words[j] == words[j + period]:
                j += 1
            length = j + period - i if j > i else 0
            if length >= max(least, 2 * period):
                part = words[i : i + length]
                if all(part[:-d] != part[d:] for d in range(1, period)):
                    found.append((i, length, period))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return [w.decode() for w in (text or "").encode().split()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_tiles_hold_every_run():
    rng = random.Random(1)
    for _ in range(1500):
        letters = rng.choice([1, 2, 2, 3, 5])
        word = [rng.randrange(letters) for _ in range(rng.randrange(0, 90))]
        for _ in range(rng.randrange(3)):
            if word:
                a, p = rng.randrange(len(word)), rng.randrange(1, 30)
                for i in range(a + p, min(len(word), a + p * rng.randrange(1, 6))):
                    word[i] = word[i - p]
        rule, n, pieces = periodic.RunRule(), len(word), {}
        for octave, bounds in periodic.boundaries(np.array(word, np.int64), rule):
            step = rule.step(octave)
            for b in bounds.tolist():
                low = max(0, b - step)
                for p, s, e in periodic.solve_tile(word[low : b + 2 * octave + step], b - low, octave, step) if b < n else []:
                    pieces.setdefault(p, set()).add((low + s, low + e))
        got = []
        for p, parts in pieces.items():
            current = None
            for s, e in sorted(parts):
                if current and s + p <= current[1]:
                    current[1] = max(current[1], e)
                else:
                    current = [s, e]
                    got.append((p, current))
        got = sorted(((s, e - s, p) for p, (s, e) in got if e - s >= max(12, 2 * p)), key=lambda r: (r[0], r[2]))
        assert got == brute(word), word


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(3)
    rows = [(900, None), (901, ""), (902, " \n\t "), (None, "a b " * 9), (903, "x " * 11), (904, "x " * 12), (905, "Ä ß\x0b" * 7)]
    rows += [(906, "a b c " * 5 + "q " + "d e " * 9), (907, "v w x y z " * 2), (908, "v w x y z u " * 2), (909, "a b " * 6 + "c d " * 6)]
    for n in range(60):
        words = [rng.choice("abc") if n % 2 else f"w{rng.randrange(400)}" for _ in range(rng.randrange(300))]
        a = rng.randrange(len(words) + 1)
        rows.append((n, " ".join(words[:a] + words[a : a + rng.randrange(1, 60)] * rng.randrange(1, 5) + words[a:])))
    return rows + rows[-3:] + [(0, rows[-1][1])]


def test_operator(spark, odd_rows):
    docs = frame(spark, odd_rows, extra=True).selectExpr("*", "2 AS period", "3 AS start", "4 AS runs", "5 AS octave")
    got = [
        (r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"], r["collapsed_sha256"])
        for r in periodic.collapse_runs(docs).collect()
    ]
    want = []
    for doc_id, text in odd_rows:
        words = split(text)
        left = collapsed(words, runs := brute(words))
        want.append((doc_id, len(words), runs, left, sha(left)))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    slim = periodic.collapse_runs(docs.repartition(5), texts=False).collect()
    assert sorted((r["doc_id"], r["collapsed_sha256"]) for r in slim if r["doc_id"] is not None) == sorted(
        (r[0], r[4]) for r in want if r[0] is not None
    )


def test_other_least_length(spark):
    rows = [(n, " ".join(random.Random(n).choice("abc") for _ in range(80))) for n in range(30)]
    for least in (4, 7, 30):
        got = periodic.collapse_runs(frame(spark, rows), periodic.RunRule(least)).collect()
        assert {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in got} == {d: brute(split(t), least) for d, t in rows}


def test_long_texts(spark):
    """One word 300,000 times; a stretch of 40,000 words three times; a megabyte in one word."""
    rng = random.Random(9)
    stretch = [f"w{rng.randrange(10**6)}" for _ in range(40_000)]
    texts = ["a " * 300_000, " ".join(stretch * 3), "x" * (1 << 20)]
    got = {r["doc_id"]: r for r in periodic.collapse_runs(frame(spark, list(enumerate(texts)))).collect()}
    assert [tuple(x) for x in got[0]["runs"]] == [(0, 300_000, 1)] and got[0]["collapsed"] == "a"
    assert [tuple(x) for x in got[1]["runs"]] == [(0, 120_000, 40_000)] and got[1]["collapsed"] == " ".join(stretch)
    assert got[2]["runs"] == [] and got[2]["collapsed"] == texts[2]


def test_no_rows(spark):
    assert periodic.longest_run(periodic.collapse_runs(frame(spark, []))).collect() == []


def test_query(spark):
    """Every column of the query on a whole table."""
    got = {r["doc_id"]: r.asDict() for r in queries.QUERIES["op13_periodic_runs"](spark, f"{DATA}/sf0.001").collect()}
    rows = documents("sf0.001")
    assert set(got) == {d for d, _ in rows}
    seen = 0
    for doc_id, text in rows:
        words = split(text)
        if len(words) > 3000:
            continue  # the word-by-word version is quadratic; long texts have their own test
        key = zlib.crc32(str(doc_id).encode())
        if key % 10 == 0 and words:
            g, n = key // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        seen += bool(runs)
        assert got[doc_id] == {
            "doc_id": doc_id,
            "n_words": len(words),
            "n_runs": len(runs),
            "start": best[0],
            "length": best[1],
            "period": best[2],
            "exponent_milli": 1000 * best[1] // best[2] if runs else None,
            "runs_sha256": sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
            "collapsed_sha256": sha(collapsed(words, runs)),
        }
    assert seen > 10
