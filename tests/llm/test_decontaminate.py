"""Decontamination against brute-force word alignment."""

from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest

from comeback.llm.decontaminate import Items, Matching, contaminated, edits_allowed, fewest_edits, folded, matches
from tests.llm.fixtures import DATA, documents, frame

WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def words(text: str | None) -> list[str]:
    cut = WORD.findall(text or "")
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in cut]


def nearest(item: list[str], text: list[str]) -> int:
    """Fewest edits between the item and any stretch of the text, row by row."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


def holders(docs, items, similarity=0.8) -> dict:
    """Items by document; a document must share a run of words with an item to be aligned with it."""
    cut = [(i, words(t)) for i, t in items if words(t)]
    out = {}
    for d, t in docs:
        text = words(t)
        known = set(zip(text, text[1:], strict=False)) | {(w,) for w in text}
        found = {}
        for i, item in cut:
            allowed = edits_allowed(len(item), similarity)
            runs = list(zip(item, item[1:], strict=False)) or [(item[0],)]
            # edits touch at most two runs each
            if sum(r in known for r in runs) >= len(runs) - 2 * allowed and (edits := nearest(item, text)) <= allowed:
                found[i] = 1 - edits / len(item)
        out[d] = found
    return out


def test_bit_parallel_alignment():
    import numpy as np

    rng = random.Random(1)
    for _ in range(300):
        a = [rng.randint(1, 4) for _ in range(rng.randint(1, 70))]
        b = [rng.randint(1, 4) for _ in range(rng.randint(0, 90))]
        assert fewest_edits(np.array(a, np.uint64), np.array(b, np.uint64)) == nearest(a, b)


def test_recall_of_edited_items():
    """At every number of allowed edits; the walk's misses stay below what the parameters promise."""
    rng = random.Random(2)
    items = __import__("duckdb").sql(f"SELECT item_id, text FROM '{DATA}/sf0.1/benchmark.parquet'").fetchall()
    ready = Items([i for i, _ in items], pa.array([t for _, t in items]), Matching())
    other = [w for _, t in documents("sf0.001")[:100] for w in t.split()]
    texts, want = [], []
    for _ in range(500):
        i, text = rng.choice(items)
        cut = text.split()
        for _ in range(rng.randint(0, edits_allowed(len(words(text)), 0.8))):
            at = rng.randrange(len(cut))
            cut[at : at + rng.randint(0, 1)] = rng.choices(other, k=rng.randint(0, 1))
        around = rng.sample(other, 60)
        texts.append(" ".join([*around[:30], *cut, *around[30:]]))
        want.append(i)
    found = matches(*folded(pa.array(texts)), ready)
    got = {n: found.get(n, {}) for n in range(len(texts))}
    exact = holders(enumerate(texts), items)
    pairs = [(n, i) for n in exact for i in exact[n]]
    assert sum(i in got[n] for n, i in pairs) >= 0.98 * len(pairs)
    assert all(abs(got[n][i] - exact[n].get(i, -1)) < 1e-9 for n in got for i in got[n])


@pytest.mark.parametrize("block_bytes", [64 << 20, 3000])
def test_tables(spark, block_bytes):
    """Whole tables and odd rows, with the benchmark in one block and in several."""
    items = spark.read.parquet(f"{DATA}/sf0.001/benchmark.parquet")
    odd = [(50, None), (51, ""), (52, "...")]
    more = spark.createDataFrame([*odd, (53, "only three words"), (53, "only three words")], items.select("item_id", "text").schema)
    items = items.select("item_id", "text").unionByName(more)
    rows = [*documents("sf0.001"), (None, None), (1000, ""), (None, "ONLY, three words!"), (1001, "only three")]
    rows += rows[5:7]
    rule = Matching(block_bytes=block_bytes)
    got = contaminated(frame(spark, rows, extra=True), items, rule).collect()
    held = holders(enumerate(t for _, t in rows), [(r["item_id"], r["text"]) for r in items.collect()])
    want = [(d, len(h), ",".join(map(str, sorted(h))), max(h.values(), default=0.0)) for (d, _), h in zip(rows, held.values(), strict=True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    clean = contaminated(frame(spark, rows, extra=True), items, rule, clean=True)
    assert clean.columns == frame(spark, rows, extra=True).columns
    want_ids = [d for (d, _), h in zip(rows, held.values(), strict=True) if not h]
    assert sorted((r["doc_id"] for r in clean.collect()), key=repr) == sorted(want_ids, key=repr)


def test_empty_tables(spark):
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert [tuple(r) for r in contaminated(frame(spark, [(1, "a b c")]), items).collect()] == [(1, 0, "", 0.0)]
    assert contaminated(frame(spark, []), items).collect() == []
