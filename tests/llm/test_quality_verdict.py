"""The divergence rules against plain counting, over whole tables."""

from __future__ import annotations

import math
import re
from collections import Counter

import duckdb
import pytest

from comeback.llm import quality
from tests.llm.fixtures import DATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SENTENCE = ".,;:?'\"-"


def kind(c):
    if ord(c) > 127:
        return "other"
    if c.islower():
        return "lower"
    if c.isupper():
        return "upper"
    if c.isdigit():
        return "digit"
    if c <= " ":
        return "space"
    return "sentence" if c in SENTENCE else "symbol"


def jensen_shannon(p, q):
    p_all, q_all = sum(p.values()), sum(q.values())
    if not p_all or not q_all:
        return 0.0
    total = 0.0
    for key in p.keys() | q.keys():
        a, b = p.get(key, 0) / p_all, q.get(key, 0) / q_all
        m = (a + b) / 2
        total += (a * math.log2(a / m) if a else 0) + (b * math.log2(b / m) if b else 0)
    return math.sqrt(max(0.0, total / 2))


def brute(rows, rules):
    words, classes = {}, {}
    for _, text, lang in rows:
        if text is not None and lang is not None:
            words.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
            classes.setdefault(lang, Counter()).update(map(kind, text))
    known = {}
    for lang, found in words.items():
        if found.total() >= rules.reference_words:
            common = {w: n for w, n in found.items() if n >= rules.common_share * found.total()}
            known[lang] = common | {None: found.total() - sum(common.values())}
    out = {}
    for doc_id, text, lang in rows:
        found = WORD.findall(text or "")
        windows = Counter(zip(found, found[1:], found[2:], strict=False))
        repeated = {i + k for i in range(len(found) - 2) if windows[tuple(found[i : i + 3])] > 1 for k in range(3)}
        failed = len(found) < 50 or 100 * len(repeated) > 50 * len(found)
        by_class = by_word = None
        if len(found) >= rules.min_words and lang in known:
            by_class = jensen_shannon(Counter(map(kind, text)), classes[lang])
            by_word = jensen_shannon(Counter(w if w in known[lang] else None for w in WORD.findall(text.lower())), known[lang])
        strays = by_class is not None and (by_class > rules.class_limit or by_word > rules.word_limit + rules.noise / len(found) ** 0.5)
        out[doc_id] = len(found), len(repeated), failed, not failed and not strays, by_class, by_word
    return out


@pytest.mark.parametrize(("scale", "rules"), [("sf0.01", quality.QualityRules()), ("sf0.001", quality.QualityRules(reference_words=500, min_words=20, word_limit=0.15))])
def test_verdicts(spark, scale, rules):
    path = f"{DATA}/{scale}/documents.parquet"
    rows = duckdb.sql(f"SELECT doc_id, text, lang FROM '{path}'").fetchall()
    extra = [(10**6, None, "en"), (10**6 + 1, "", None), (10**6 + 2, rows[0][1], None), (10**6 + 3, "Zażółć gęślą jaźń " * 40, "pl")]
    docs = spark.createDataFrame(rows + extra, "doc_id bigint, text string, lang string")
    want = brute(rows + extra, rules)
    got = quality.judge_documents(docs, rules).collect()
    assert len(got) == len(want) and not all(r["kept"] for r in got)
    for r in got:
        n_words, n_repeat, failed, kept, by_class, by_word = want[r["doc_id"]]
        assert (r["n_words"], r["n_repeat_words"], r["base_failed"], r["kept"]) == (n_words, n_repeat, failed, kept)
        assert (r["class_distance"] is None) == (by_class is None)
        if by_class is not None:
            assert (r["class_distance"], r["word_distance"]) == pytest.approx((by_class, by_word), abs=1e-9)


def test_a_verdict_does_not_change_when_other_languages_grow(spark):
    path = f"{DATA}/sf0.01/documents.parquet"
    rows = duckdb.sql(f"SELECT doc_id, text, lang FROM '{path}'").fetchall()
    small = [r for r in rows if r[2] == "es"]
    many = small + [(d + 10**6 * k, t, g) for k in range(1, 3) for d, t, g in rows if g != "es"]
    few, large = (
        {r["doc_id"]: (r["kept"], r["word_distance"]) for r in quality.judge_documents(spark.createDataFrame(x, "doc_id bigint, text string, lang string")).collect()}
        for x in (small, many)
    )
    assert all(large[d] == v for d, v in few.items()) and any(v[1] is not None for v in few.values())
