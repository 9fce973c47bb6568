"""Quality rules, personal data and the encoder: odd rows, whole tables, brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from comeback.llm import personal, piece_table, quality
from tests.llm.fixtures import DATA, documents, frame

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# Encoder


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


PARTS = [" ", "  ", "a", "e", "the", "ing", "\n", "\t", "é", "ß", "😀", "▁", "\x00", "①", "中", "12", "<s>", "<0x0A>", "́", "​"]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.lists(st.sampled_from(PARTS), max_size=40).map("".join), st.text(max_size=40)))
def test_encoder_equals_the_library(text):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    table = piece_table.table_of(MODEL)
    ids = library.encode(text)
    assert table.encode(text) == ids
    assert table.decode(ids) == library.decode(ids)
    joined = ",".join(map(str, ids))
    want = (len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert table.digest(text) == want == table.digest(text)


def test_decoder_on_any_ids(library):
    rng = random.Random(1)
    table = piece_table.table_of(MODEL)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(32000)]) for _ in range(rng.randint(0, 12))]
        assert table.decode(ids) == library.decode(ids)


def test_encoder_on_tables(spark, library):
    rows = [*documents("sf0.001"), (None, None), (7, ""), (7, ""), (8, "ab" * 200_000), (9, " " * 5000)]
    want = []
    for d, t in rows:
        ids = library.encode(t or "")
        want.append((d, ids, library.decode(ids)))
    got = piece_table.encode_documents(frame(spark, rows, extra=True), MODEL)
    assert rows_of(got) == sorted(want, key=repr)
    digests = piece_table.token_digests(frame(spark, rows, extra=True), MODEL)
    hashed = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert rows_of(digests) == sorted(((d, len(i), hashed(",".join(map(str, i))), hashed(x)) for d, i, x in want), key=repr)
    assert rows_of(piece_table.token_digests(frame(spark, []), MODEL)) == []


# Personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) < 256 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(found)


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="@.+-  1234567890abA%_()é4417١", max_size=50))
def test_base_spans(text):
    base, every = personal.find(text)
    assert base == base_spans(text)
    assert set(base) <= set(every)


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("write john (at) mail3 dot example dot com now", "email", "john (at) mail3 dot example dot com"),
        ("a.b [at] ex-ample [dot] org", "email", "a.b [at] ex-ample [dot] org"),
        ("jоhn@exаmple.com ok", "email", "jоhn@exаmple.com"),
        ("joh​n@mail.com", "email", "joh​n@mail.com"),
        ("john＠mail.com", "email", "john＠mail.com"),
        ("plus one five five five one two three four five six seven", "phone", "plus one five five five one two three four five six seven"),
        ("one nine two dot one six eight dot zero dot one", "ip", "one nine two dot one six eight dot zero dot one"),
        ("４４１７７４４２８０３５１５４７", "card", None),
        ("écrire à jean point dupont arobase", None, None),
        ("meet me at the dot com era", None, None),
        ("nine one one is a number, one two three", None, None),
    ],
)
def test_disguises(text, kind, span):
    base, every = personal.find(text)
    added = [x for x in every if x not in base]
    if kind is None:
        assert not added
    else:
        ((start, number, end),) = [x for x in added if personal.KINDS[x[1]] == kind]
        assert text[start:end] == (span or text)


def test_personal_tables(spark):
    long = "a" * 300_000 + "@" + "1" * 300_000 + " +1" * 1000
    rows = [*documents("sf0.001"), (None, None), (5, ""), (5, ""), (6, long), (7, "x@y.zz and +1 555 123 4567")]
    got = rows_of(personal.find_personal(frame(spark, rows, extra=True)))
    want = []
    for d, t in rows:
        base, every = personal.find(t)
        if t is not long:
            assert base == base_spans(t or "")
        counts = Counter(k for _, k, _ in base)
        text = ",".join(f"{personal.KINDS[k]}:{s}:{e}" for s, k, e in base)
        spans = ",".join(f"{personal.KINDS[k]}:{s}:{e}" for s, k, e in every)
        want.append((d, *(counts[k] for k in range(4)), hashlib.sha256(text.encode()).hexdigest(), spans))
    assert got == sorted(want, key=repr)
    assert rows_of(personal.find_personal(frame(spark, []))) == []


# Quality rules


def statistics(text):
    words = WORD.findall(text or "")
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab #|\n\t é", max_size=80))
def test_text_statistics(text):
    assert quality.text_statistics(text) == statistics(text)


def test_quality_tables(spark):
    source = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    rules = quality.QualityRules()
    references = quality.language_references(source, rules)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in source.collect()]
    words: dict = {}
    for _, t, g in rows:
        words.setdefault(g, Counter()).update(WORD.findall(t.lower()))
    for g, counts in words.items():
        total = sum(counts.values())
        assert references[g]["word"] == {w: n for w, n in counts.items() if n >= rules.common_share * total}
    extra = [(None, None, "en"), (1, "", "en"), (2, "w " * 500, "xx"), (3, " ".join(f"v{i}" for i in range(99)), None)]
    docs = spark.createDataFrame(rows + extra + extra, "doc_id bigint, text string, lang string")
    docs = docs.selectExpr("*", "1 AS n_words", "2 AS kept", "3 AS source")
    got = rows_of(quality.judge_documents(docs, references=references))
    assert len(got) == len(rows) + 8
    want = sorted(((d, *statistics(t)) for d, t, _ in rows + extra + extra), key=repr)
    assert sorted((r[:6] for r in got), key=repr) == want
    for r in got:
        assert r[6] == (r[1] < 50 or 100 * r[5] > 50 * r[1])
        assert not (r[6] and r[7])
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{DATA}/sf0.01/labels.parquet'").fetchall())
    kept = {r[0]: r[7] for r in got if r[0] is not None}
    failed = {r[0]: r[6] for r in got}
    assert all(kept[d] for d, q in labels.items() if q == 1 and not failed[d])
    junk = [d for d, q in labels.items() if q == 0 and not failed[d]]
    assert sum(not kept[d] for d in junk) >= 0.9 * len(junk)
    back = quality.judge_documents(docs, references=references, keep=True)
    assert back.columns == docs.columns and back.count() == sum(r[7] for r in got)
    empty = docs.limit(0)
    assert rows_of(quality.judge_documents(empty)) == []


def test_distance_is_between_0_and_1():
    import numpy as np

    assert quality.distance(np.array([1.0, 0]), np.array([0, 5.0])) == pytest.approx(1)
    assert quality.distance(np.array([1.0, 2]), np.array([2, 4.0])) == 0
    assert quality.distance(np.array([0.0, 0]), np.array([2, 4.0])) == 0
