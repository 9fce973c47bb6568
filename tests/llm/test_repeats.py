"""Substring and suffix-array dedup against brute force, also over many chunks and shards."""

from __future__ import annotations

import hashlib
import random
import re

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from comeback.llm import passages as passages_module
from comeback.llm import substrings, suffix_arrays
from comeback.llm.passages import Windows, without_repeats
from tests.llm.fixtures import documents, frame

BIG = 1 << 62
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(rows, symbols, size, join):
    first: dict = {}
    cut = [(d, symbols(t or "")) for d, t in rows]
    for d, s in cut:
        for i in range(len(s) - size + 1):
            key = tuple(s[i : i + size])
            first[key] = min(first.get(key, BIG), BIG if d is None else d)
    out = []
    for d, s in cut:
        gone = [False] * len(s)
        for i in range(len(s) - size + 1):
            if first[tuple(s[i : i + size])] < (BIG if d is None else d):
                gone[i : i + size] = [True] * size
        kept = join([x for x, g in zip(s, gone, strict=True) if not g])
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(s), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def by_word(rows, size):
    return [(*r[:3], r[4]) for r in expected(rows, WORD.findall, size, lambda x: " ".join(x).encode())]


def by_byte(rows, size):
    return expected(rows, lambda t: list(t.encode()), size, bytes)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def passages(seed: int) -> list[tuple[int | None, str | None]]:
    """Few distinct words, copied and broken passages, empty and null texts, null and repeated ids."""
    rng = random.Random(seed)
    words = ["a", "bb", "ccc", "dü", "漢字", "the", "of", "x" * 30]
    pool = [[rng.choice(words) for _ in range(rng.randint(1, 60))] for _ in range(6)]
    rows: list[tuple[int | None, str | None]] = [(None, None), (None, "a bb ccc"), (3, ""), (4, None)]
    for n in range(60):
        text: list[str] = []
        for _ in range(rng.randint(0, 5)):
            part = list(rng.choice(pool))
            if rng.random() < 0.5 and part:
                part[rng.randrange(len(part))] = rng.choice(words)
            text += part
        gap = rng.choice([" ", "\n", "\t "])
        rows.append((rng.choice([n, n, None, 7]), gap.join(text)))
    return rows + rows[10:14]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("chunk_bytes", [1500, 1 << 20])
def test_words(spark, seed, chunk_bytes):
    rows = passages(seed)
    rule = Windows(True, 5, 2, chunk_bytes, chunk_bytes)
    docs = frame(spark, rows)
    got = without_repeats(docs, rule, substrings.by_automaton(5), substrings._digest, substrings.SCHEMA, "doc_id", "text")
    assert result(got) == by_word(rows, 5)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("chunk_bytes", [1500, 1 << 20])
def test_bytes(spark, seed, chunk_bytes):
    rows = passages(seed)
    rule = Windows(False, 12, 4, chunk_bytes, chunk_bytes)
    docs = frame(spark, rows)
    report = suffix_arrays._reporter(False)
    got = without_repeats(docs, rule, suffix_arrays.by_intervals(12), report, suffix_arrays.SCHEMA, "doc_id", "text")
    assert result(got) == by_byte(rows, 12)


def test_whole_table(spark):
    rows = documents("sf0.001")
    docs = frame(spark, rows)
    assert result(substrings.remove_repeated_words(docs)) == by_word(rows, 13)
    assert result(suffix_arrays.remove_repeated_bytes(docs)) == by_byte(rows, 50)


def test_no_rows(spark):
    docs = frame(spark, [])
    assert result(substrings.remove_repeated_words(docs)) == []
    assert result(suffix_arrays.remove_repeated_bytes(docs, texts=True)) == []


def test_long_text_of_one_word(spark):
    rows = [(1, "a " * 30000), (2, "a " * 30001 + "b"), (3, "z" * 70000)]
    docs = frame(spark, rows, extra=True)
    got = result(substrings.remove_repeated_words(docs))
    assert [r[:3] for r in got] == [(1, 30000, 0), (2, 30002, 30001), (3, 1, 0)]
    got = result(suffix_arrays.remove_repeated_bytes(docs))
    assert [r[:4] for r in got] == [(1, 60000, 0, 0), (2, 60003, 60002, 1), (3, 70000, 0, 0)]


def test_kept_text(spark):
    rows = [(1, "a b c d e f"), (2, "x a b c d e y")]
    got = result(substrings.remove_repeated_words(frame(spark, rows), size=4, texts=True))
    assert got == [(1, 6, 0, "a b c d e f"), (2, 7, 5, "x y")]


@pytest.mark.parametrize("block", [1, 300, 1 << 21])
@pytest.mark.parametrize("by", ["word", "byte"])
def test_blocks_of_a_shard_make_no_difference(monkeypatch, block, by):
    """The three steps without Spark, with shards searched in blocks of different sizes."""
    monkeypatch.setattr(passages_module, "BLOCK", block)
    rows = passages(5)
    size, rule = (5, Windows(True, 5, 2)) if by == "word" else (12, Windows(False, 12, 4))
    resolve = substrings.by_automaton(5) if by == "word" else suffix_arrays.by_intervals(12)
    report = substrings._digest if by == "word" else suffix_arrays._reporter(False)
    chunks = []
    for n in range(3):
        part = rows[n::3]
        ids = pa.array([d for d, _ in part], pa.int64())
        texts = pa.array([t or "" for _, t in part])
        keys = pa.array([hash(t) for _, t in part], pa.int64())
        chunks.append(pa.table({"doc_id": ids, "text": texts, "h": keys, "chunk": pa.array([n] * len(part), pa.int32())}))
    sent = pa.concat_tables([passages_module.send(c, rule, 2) for c in chunks])
    answers = []
    for shard in (0, 1):
        mine = sent.filter(pc.equal(sent.column("shard"), shard))
        if mine.num_rows:
            answers.append(passages_module.settle(mine, rule, resolve))
    answers = pa.concat_tables(answers)
    got = []
    for n, chunk in enumerate(chunks):
        found = answers.filter(pc.equal(answers.column("chunk"), n))
        out = report(*passages_module.removed(chunk, found, rule, 2))
        got += zip(*(out.column(c).to_pylist() for c in out.column_names), strict=True)
    want = by_word(rows, size) if by == "word" else by_byte(rows, size)
    assert sorted(got, key=repr) == want
