"""Language ID: Viterbi against all labelings, spans, scripts, odd rows, held-out accuracy."""

from __future__ import annotations

import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest

from comeback.llm import languages, queries
from comeback.llm.languages import LanguageRule, best_labels
from tests.llm.fixtures import DATA, frame

SAMPLES = {
    "en": "the house is near the river and they were walking through this old town with their friends",
    "de": "das haus ist nahe dem fluss und sie gingen durch diese alte stadt mit ihren freunden zusammen",
    "ru": "дом стоит у реки и они шли через этот старый город вместе со своими друзьями домой",
    "ja": "いえ は かわ の ちかく に あり かれら は ともだち と この ふるい まち を あるいた",
}


def labelled(rng, n=60):
    rows = []
    for i in range(n):
        lang = rng.choice(list(SAMPLES))
        words = SAMPLES[lang].split()
        rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randint(5, 40))), lang))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    rows = labelled(random.Random(2)) + [(900, None, "en"), (901, "12 34", "xx"), (902, "abc", None), (903, "", "en")]
    return languages.fit_languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "1 AS n", "2 AS kind"))


def test_viterbi_is_the_best_labeling():
    rng = np.random.default_rng(4)
    for _ in range(300):
        sizes = rng.integers(0, 6, rng.integers(1, 6))
        first = np.concatenate([[0], np.cumsum(sizes)])
        scores = -rng.integers(0, 40, (first[-1], 3)) / 4.0
        got = best_labels(scores, first, 2.5)
        for a, b in itertools.pairwise(first):
            def total(labels):
                return sum(scores[a + i, k] for i, k in enumerate(labels)) - 2.5 * sum(x != y for x, y in itertools.pairwise(labels))

            best = max((total(x) for x in itertools.product(range(3), repeat=int(b - a))), default=0)
            assert total(got[a:b].tolist()) == pytest.approx(best)


def test_learned(model):
    assert model.languages == ["de", "en", "ja", "ru"]  # xx has no letter
    assert model.scripts == [{"Latin"}, {"Latin"}, {"Kana"}, {"Cyrillic"}]
    scores, letters = model.word_scores(["house", "город", "かわ", "αβγ", "xдом"])
    assert (scores[0] > languages.NEVER).tolist() == [True, True, False, False]
    assert (scores[1] > languages.NEVER).tolist() == [False, False, False, True]
    assert (scores[2] > languages.NEVER).tolist() == [False, False, True, False]
    assert letters.tolist() == [5, 5, 2, -3, 4] and scores[3].min() >= -model.rule.floor
    assert (scores[4] > languages.NEVER).tolist() == [True, True, False, True]  # no language has both scripts


def test_a_share_sums_to_one(model):
    letters = [g for g in model.counts if len(g) == 1] + ["\x00"]
    for context in ("", "t", "th", " d", "zz", "го"):
        total = sum(model._share(context + c) for c in letters)
        assert total == pytest.approx(np.ones(4), abs=1e-4)


def test_spans_of_mixed_text(spark, model):
    text = f"{SAMPLES['en'].title()}. 12 – {SAMPLES['ru']}! {SAMPLES['de']}\n{SAMPLES['ja']}"
    row = languages.label_languages(frame(spark, [(1, text)]), model).first()
    parts = [(s["lang"], text[s["start"] : s["end"]]) for s in row["spans"]]
    assert parts == [("en", SAMPLES["en"].title()), ("ru", SAMPLES["ru"]), ("de", SAMPLES["de"]), ("ja", SAMPLES["ja"])]
    weight = {k: sum(map(str.isalpha, v)) for k, v in SAMPLES.items()}
    assert row["lang_pred"] == max(weight, key=weight.get)
    assert row["score"] == pytest.approx(max(weight.values()) / sum(weight.values())) and row["n_spans"] == 4


def test_one_foreign_word_is_no_span(spark, model):
    row = languages.label_languages(frame(spark, [(1, "the river and the house ihren the old town with this")]), model).first()
    assert row["n_spans"] == 1 and row["lang_pred"] == "en" and row["score"] == 1


def test_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "12 ½ ٣ ..."), (None, SAMPLES["de"]), (4, "αβγ δεζ"), (5, SAMPLES["ru"]), (5, SAMPLES["ru"])]
    rows += [(6, "İ" * 5 + " " + SAMPLES["en"]), (7, "x" * 100_000), (8, (SAMPLES["de"] + " ") * 20_000), (9, "\U0001d538 the")]
    docs = frame(spark, rows, extra=True).selectExpr("*", "1 AS spans", "2 AS score", "3 AS lang_pred")
    got = {(r["doc_id"], i): r for i, r in enumerate(languages.label_languages(docs.coalesce(1), model).collect())}
    by_id = {k[0]: r for k, r in got.items()}
    assert len(got) == len(rows)
    for i in (1, 2, 3):
        assert (by_id[i]["lang_pred"], by_id[i]["score"], by_id[i]["spans"], by_id[i]["n_spans"]) == ("und", 0.0, [], 0)
    assert by_id[None]["lang_pred"] == "de" and by_id[5]["lang_pred"] == "ru"
    assert by_id[4]["lang_pred"] in model.languages and by_id[4]["score"] == 0
    assert by_id[8]["n_spans"] == 1 and by_id[8]["lang_pred"] == "de"
    assert by_id[7]["lang_pred"] in ("de", "en")
    spread = languages.label_languages(docs.repartition(4), model, spans=False).drop("n_spans")
    same = languages.label_languages(docs.coalesce(1), model).select("doc_id", "lang_pred", "score")
    assert sorted(map(tuple, spread.collect()), key=repr) == sorted(map(tuple, same.collect()), key=repr)


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([(1, "text", None)], "doc_id bigint, text string, lang string")
    none = languages.fit_languages(empty)
    assert [tuple(r) for r in languages.label_languages(empty, none, spans=False).collect()] == [(1, "und", 0.0, 0)]
    assert languages.label_languages(frame(spark, []), none).collect() == []


def test_sample_is_bounded_and_whole_when_small(spark):
    rows = [(i, "aaa" if i % 2 else "bbb", "en" if i % 3 else "de") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    some = languages.fit_languages(docs, LanguageRule(sample_docs=200))
    counted = some.counts[""][some.languages.index("en")] / 4  # three letters and the end of the word
    assert 100 < counted < 320
    whole = languages.fit_languages(docs, LanguageRule(sample_docs=10_000))
    assert whole.counts[""].tolist() == [4000.0, 8000.0]


def test_query(spark):
    """Held-out accuracy on a whole table, and what the contract fixes."""
    rows = queries.QUERIES["op11_language_id"](spark, f"{DATA}/sf0.01").collect()
    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{DATA}/sf0.01/documents.parquet'").fetchall())
    assert sorted(r["doc_id"] for r in rows) == sorted(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    judged = [r for r in rows if r["held_out"] and r["lang_pred"] != "und" and truth[r["doc_id"]]]
    right = sum(r["lang_pred"] == truth[r["doc_id"]] for r in judged) / len(judged)
    print(f"accuracy {right:.4f} of {len(judged)}")
    assert right >= 0.95
