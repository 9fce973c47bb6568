"""Texts made to collide under polynomial hashes, and sets made to meet in empty buckets."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from comeback.llm.components import connected
from comeback.llm.decontaminate import contaminated
from comeback.llm.jaccard import bucket_sums, similar_documents
from comeback.llm.substrings import remove_repeated_words
from comeback.llm.suffix_arrays import remove_repeated_bytes
from comeback.llm.textarrays import SEEDS, span_digests
from tests.llm.fixtures import frame


def thue_morse(letters: str, size: int = 2048) -> str:
    return "".join(letters[bin(i).count("1") & 1] for i in range(size))


A, B = thue_morse("ab"), thue_morse("ba")


def test_words(spark):
    """Twelve shared words and one that differs: no window of 13 is shared, the sets aren't similar."""
    words = " ".join(f"w{i}" for i in range(12))
    docs = frame(spark, [(1, f"{words} {A}"), (2, f"{words} {B}")])
    assert {r["doc_id"]: r["n_removed"] for r in remove_repeated_words(docs).collect()} == {1: 0, 2: 0}
    assert {r["doc_id"]: r["component_id"] for r in similar_documents(docs).collect()} == {1: 1, 2: 2}


def test_bytes(spark):
    """Removed bytes are those of shared 50-byte strings, as counted by brute force."""
    texts = {1: A, 2: B}
    seen = {A[i : i + 50] for i in range(len(A) - 49)}
    gone = {i + k for i in range(len(B) - 49) if B[i : i + 50] in seen for k in range(50)}
    kept = "".join(c for i, c in enumerate(B) if i not in gone)
    got = {r["doc_id"]: r for r in remove_repeated_bytes(frame(spark, list(texts.items()))).collect()}
    assert (got[2]["n_removed"], got[2]["kept_sha256"]) == (len(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert got[1]["n_removed"] == 0


def test_items(spark):
    items = spark.createDataFrame([(1, f"{A} x y z")], "item_id bigint, text string")
    got = contaminated(frame(spark, [(1, f"{B} x y z"), (2, f"q {A} x y z")]), items).collect()
    assert {r["doc_id"]: r["n_items"] for r in got} == {1: 0, 2: 1}


def test_digests_tell_spans_apart():
    """Lengths about every step of eight bytes, trailing zeros, long spans; both seeds differ."""
    rng = random.Random(1)
    spans = {bytes(rng.choice(b"ab\x00") for _ in range(n)) for n in [*range(40), 1023, 1024, 1025, 5000] for _ in range(30)}
    spans = sorted(spans | {b"a" * n for n in range(40)} | {b"\x00" * n for n in range(40)})
    data = np.frombuffer(b"".join(spans), np.uint8)
    ends = np.cumsum([len(s) for s in spans])
    one, two = span_digests(data, ends - [len(s) for s in spans], ends)
    assert len(set(one.tolist())) == len(set(two.tolist())) == len(spans) and not (one == two).any()
    again = [span_digests(np.frombuffer(s + b"rest", np.uint8), np.array([0]), np.array([len(s)]), SEEDS[:1])[0][0] for s in spans]
    assert again == one.tolist()


@pytest.mark.parametrize("percent", [80, 90])
def test_unrelated_sets_do_not_meet(spark, percent):
    rng = np.random.default_rng(6)
    pairs = []
    for size in (20, 60, 200, 600):
        for n in range(400):
            found = np.unique(rng.integers(0, 2**63, size, dtype=np.int64).astype(np.uint64))
            pairs += [(s, size * 1000 + n) for s in bucket_sums(found, percent).tolist()]
    first: dict[int, int] = {}
    links = [(first.setdefault(s, n), n) for s, n in pairs]
    links = [(a, b) for a, b in links if a != b]
    groups: dict[int, int] = {}
    for _, component in connected(spark.createDataFrame(links or [(None, None)], "a bigint, b bigint")).collect():
        groups[component] = groups.get(component, 0) + 1
    assert max(groups.values(), default=0) <= 3


def test_similar_sets_share_a_bucket_at_80():
    rng = np.random.default_rng(7)
    met = 0
    for size in [*range(1, 80), 100, 333, 1000]:
        for _ in range(60):
            base = rng.integers(0, 2**63, size, dtype=np.int64).astype(np.uint64)
            cut, more = rng.integers(0, size // 9 + 2, 2)
            other = np.concatenate([base[cut:], rng.integers(0, 2**63, more, dtype=np.int64).astype(np.uint64)])
            both = len(np.intersect1d(base, other))
            if len(other) and 100 * both >= 80 * (len(base) + len(other) - both):
                met += 1
                assert np.intersect1d(bucket_sums(base, 80), bucket_sums(other, 80)).size
    assert met > 1000
