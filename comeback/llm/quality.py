"""Quality rules: text statistics and the divergence of a document from its language.

References are taken from the corpus itself: for each language, how often each character class
occurs and how often each common word does. A document is compared with the reference of its own
language by the Jensen-Shannon distance (square root of the divergence in bits, 0 to 1).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comeback.llm.common import one_pass

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "space", "sentence", "symbol", "other")


def _class_table() -> np.ndarray:
    """Class of each byte of UTF-8; 7 for bytes that go on a character."""
    table = np.full(256, 6, np.int64)
    for code in range(128):
        c = chr(code)
        if c.islower():
            table[code] = 0
        elif c.isupper():
            table[code] = 1
        elif c.isdigit():
            table[code] = 2
        elif code <= 32:
            table[code] = 3
        elif c in ".,;:?'\"-":
            table[code] = 4
        else:
            table[code] = 5
    table[128:192] = 7
    return table


CLASS_OF = _class_table()


@dataclass(frozen=True)
class QualityRules:
    """Parameters of the rules.

    ``common_share``: part of a language's words that makes a word common (so at most 1/share
    words). ``reference_words``: from so many words on a language has a reference; with fewer, a word at
    the common share would have been seen less than ten times, and the histogram would be noise.
    ``min_words``: shorter documents aren't compared. ``class_limit`` and ``word_limit``: largest
    distances kept; ``noise``: what is added to the word limit for a document of n words, as
    noise / sqrt(n), since short texts stray further by chance.
    """

    min_base_words: int = 50
    repeat_percent: int = 50
    common_share: float = 0.002
    reference_words: int = 5000
    min_words: int = 50
    class_limit: float = 0.31
    word_limit: float = 0.20
    noise: float = 2.0


def class_counts(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return np.bincount(CLASS_OF[raw], minlength=8)[:7]


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms with the same bins; 0 if one is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = lambda a: np.where(a > 0, a * np.log2(a / m), 0.0).sum()
        return float(np.sqrt(max(0.0, (kl(p) + kl(q)) / 2)))


def text_statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, words in repeated 3-word windows."""
    if not text:
        return 0, 0, 0, 0, 0
    words = WORD.findall(text)
    seen: set[str] = set()
    repeated = 0
    for line in text.split("\n"):
        if WORD.search(line):
            if line in seen:
                repeated += 1
            else:
                seen.add(line)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    covered = 0
    if len(set(windows)) < len(windows):
        many = Counter(windows)
        end = 0
        for at, window in enumerate(windows):
            if many[window] > 1:
                covered += at + 3 - max(end, at)
                end = at + 3
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), repeated, covered


def language_references(docs: DataFrame, rules: QualityRules, lang_column: str = "lang", text_column: str = "text") -> dict:
    """Reference histograms by language, from every row of ``docs``.

    Python tasks count per batch, Spark sums up. What reaches the driver is bounded: for each language
    with ``reference_words`` words, those with ``common_share`` of them. Languages are a short list of codes.
    """
    source = docs.select(docs[lang_column].cast("string").alias("lang"), docs[text_column].cast("string").alias("text"))
    source = source.where("lang is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: dict[str, Counter] = {}
            classes: dict[str, np.ndarray] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
                classes[lang] = classes.get(lang, 0) + class_counts(text)
            for lang, found in words.items():
                items = [*CLASSES, *found]
                counts = [*map(int, classes[lang]), *found.values()]
                kinds = ["class"] * len(CLASSES) + ["word"] * len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(items)), pa.array(kinds), pa.array(items, pa.string()), pa.array(counts, pa.int64())],
                    names=["lang", "kind", "item", "n"],
                )

    counts = source.mapInArrow(run, "lang string, kind string, item string, n bigint")
    summed = counts.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    with one_pass(summed) as stored:
        totals = stored.where("kind = 'word'").groupBy("lang").agg(F.sum("n").alias("total"))
        large = totals.where(F.col("total") >= max(1, rules.reference_words))
        common = stored.join(F.broadcast(large), "lang").where(
            (F.col("kind") == "class") | (F.col("n") >= rules.common_share * F.col("total"))
        )
        rows = common.collect()
    out: dict = {}
    for row in rows:
        entry = out.setdefault(row["lang"], {"class": {}, "word": {}, "total": row["total"]})
        entry[row["kind"]][row["item"]] = row["n"]
    return out


def _prepared(references: dict) -> dict:
    out = {}
    for lang, entry in references.items():
        names = sorted(entry["word"])
        known = np.array([*(entry["word"][w] for w in names), 0], float)
        known[-1] = entry["total"] - known.sum()
        classes = np.array([entry["class"].get(c, 0) for c in CLASSES], float)
        out[lang] = ({w: i for i, w in enumerate(names)}, known, classes)
    return out


def judge(text: str | None, lang: str | None, prepared: dict, rules: QualityRules) -> tuple:
    """Statistics, the base verdict, both distances (null if not compared) and the verdict."""
    n_words, word_chars, n_symbols, n_dup, n_repeat = text_statistics(text)
    failed = n_words < rules.min_base_words or 100 * n_repeat > rules.repeat_percent * n_words
    by_class = by_word = None
    if text and n_words >= rules.min_words and lang in prepared:
        place, known, classes = prepared[lang]
        by_class = distance(class_counts(text).astype(float), classes)
        other = len(place)
        got = np.bincount([place.get(w, other) for w in WORD.findall(text.lower())], minlength=other + 1)
        by_word = distance(got.astype(float), known)
    strays = by_class is not None and (
        by_class > rules.class_limit or by_word > rules.word_limit + rules.noise / n_words**0.5
    )
    return n_words, word_chars, n_symbols, n_dup, n_repeat, failed, not failed and not strays, by_class, by_word


def judge_documents(
    docs: DataFrame,
    rules: QualityRules | None = None,
    references: dict | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    keep: bool = False,
) -> DataFrame:
    """One row per row of ``docs`` with its statistics, distances and verdict ``kept``.

    A null or empty text has no words and fails the base rule. A document without a language, of
    a language without a reference, or with fewer than ``min_words`` words isn't compared: the
    base rule alone decides. Repeated rows are judged each; an empty table gives no rows; other
    columns are not looked at. With ``keep`` the rows of ``docs`` that are kept come back instead,
    all columns unchanged.
    """
    rules = rules or QualityRules()
    if references is None:
        references = language_references(docs, rules, lang_column, text_column)
    prepared = _prepared(references)

    def verdicts(texts: pa.Array, langs: pa.Array) -> list[tuple]:
        return [judge(t, g, prepared, rules) for t, g in zip(texts.to_pylist(), langs.to_pylist(), strict=True)]

    if keep:
        place = [docs.columns.index(text_column), docs.columns.index(lang_column)]

        def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = verdicts(batch.column(place[0]), batch.column(place[1]))
                yield batch.filter(pa.array([r[6] for r in rows], pa.bool_()))

        return docs.mapInArrow(select, docs.schema)

    source = docs.select(
        docs[id_column].alias("doc_id"),
        docs[text_column].cast("string").alias("text"),
        docs[lang_column].cast("string").alias("lang"),
    )
    kinds = ["bigint"] * 5 + ["boolean"] * 2 + ["double"] * 2
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept class_distance word_distance".split()
    arrow = {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = verdicts(batch.column(1), batch.column(2))
            columns = [pa.array([r[i] for r in rows], arrow[k]) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *names])

    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, {schema}")
