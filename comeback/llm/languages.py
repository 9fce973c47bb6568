"""Language of documents and of spans inside them.

A word's script, told by the ranges its letters lie in, leaves the languages written in it as
candidates. Each candidate scores the word by interpolated counts of its three-letter sequences,
and Viterbi picks the labels of a document's words with the best sum of scores, less a penalty for
each change of language; neighbouring words with one label are a span.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from comeback.llm.textarrays import small_batches

# First and last code point of ranges of letters, and their script.
SCRIPT_RANGES = (
    (0x0041, 0x02AF, "Latin"),
    (0x0370, 0x03FF, "Greek"),
    (0x0400, 0x052F, "Cyrillic"),
    (0x0530, 0x058F, "Armenian"),
    (0x0590, 0x05FF, "Hebrew"),
    (0x0600, 0x06FF, "Arabic"),
    (0x0700, 0x074F, "Syriac"),
    (0x0750, 0x077F, "Arabic"),
    (0x0780, 0x07BF, "Thaana"),
    (0x07C0, 0x07FF, "Nko"),
    (0x08A0, 0x08FF, "Arabic"),
    (0x0900, 0x097F, "Devanagari"),
    (0x0980, 0x09FF, "Bengali"),
    (0x0A00, 0x0A7F, "Gurmukhi"),
    (0x0A80, 0x0AFF, "Gujarati"),
    (0x0B00, 0x0B7F, "Oriya"),
    (0x0B80, 0x0BFF, "Tamil"),
    (0x0C00, 0x0C7F, "Telugu"),
    (0x0C80, 0x0CFF, "Kannada"),
    (0x0D00, 0x0D7F, "Malayalam"),
    (0x0D80, 0x0DFF, "Sinhala"),
    (0x0E00, 0x0E7F, "Thai"),
    (0x0E80, 0x0EFF, "Lao"),
    (0x0F00, 0x0FFF, "Tibetan"),
    (0x1000, 0x109F, "Myanmar"),
    (0x10A0, 0x10FF, "Georgian"),
    (0x1100, 0x11FF, "Hangul"),
    (0x1200, 0x139F, "Ethiopic"),
    (0x13A0, 0x13FF, "Cherokee"),
    (0x1780, 0x17FF, "Khmer"),
    (0x1800, 0x18AF, "Mongolian"),
    (0x1C80, 0x1C8F, "Cyrillic"),
    (0x1E00, 0x1EFF, "Latin"),
    (0x1F00, 0x1FFF, "Greek"),
    (0x2C60, 0x2C7F, "Latin"),
    (0x3040, 0x30FF, "Kana"),
    (0x3130, 0x318F, "Hangul"),
    (0x3400, 0x4DBF, "Han"),
    (0x4E00, 0x9FFF, "Han"),
    (0xA640, 0xA69F, "Cyrillic"),
    (0xA720, 0xA7FF, "Latin"),
    (0xAC00, 0xD7AF, "Hangul"),
    (0xF900, 0xFAFF, "Han"),
    (0xFB50, 0xFDFF, "Arabic"),
    (0xFE70, 0xFEFF, "Arabic"),
    (0xFF21, 0xFF5A, "Latin"),
    (0xFF66, 0xFF9D, "Kana"),
    (0x20000, 0x323AF, "Han"),
)
_STARTS = [low for low, _, _ in SCRIPT_RANGES]
# Runs of letters; a longer one (a text without spaces) is cut, so that labels can change in it.
WORD = re.compile(r"[^\W\d_]{1,32}")
UNKNOWN = "und"
NEVER = -1e6
CACHED_WORDS = 1 << 20


@dataclass(frozen=True)
class LanguageRule:
    """``sample_docs``: about so many documents of each language are counted, drawn by a hash of
    their id. ``max_grams``: most frequent letter sequences kept of a language. ``script_share``: part
    of a language's letters that makes a script one of its own. ``weight``: how many letters' worth
    of belief the shorter context has. ``floor``: how much worse than the best language a word can
    make another; ``switch``: what a change of language costs. As ``floor`` < 2 x ``switch``, one word
    alone never makes a span among candidates.
    """

    sample_docs: int = 2000
    max_grams: int = 20_000
    script_share: float = 0.01
    weight: float = 5.0
    floor: float = 12.0
    switch: float = 8.0


def script_of(letter: str) -> str:
    """The script whose range holds the letter; a letter of no range is its own script."""
    at = bisect_right(_STARTS, ord(letter)) - 1
    return SCRIPT_RANGES[at][2] if at >= 0 and ord(letter) <= SCRIPT_RANGES[at][1] else letter


def lowered(text: str) -> str:
    """Lower case where it keeps the places of characters."""
    low = text.lower()
    return low if len(low) == len(text) else text


def grams_of(word: str) -> list[str]:
    """Each letter with up to two before it; a space begins and ends the word."""
    padded = f" {word} "
    return [padded[max(0, i - 2) : i + 1] for i in range(1, len(padded))]


@dataclass
class LanguageModel:
    """Learned languages in name order, their scripts, and counts of letter sequences by language."""

    languages: list[str]
    scripts: list[set[str]]
    counts: dict[str, np.ndarray]
    rule: LanguageRule
    _vectors: dict[str, int] = field(default_factory=dict)
    _logs: list[np.ndarray] = field(default_factory=list)
    _letters: int = 0

    def _share(self, gram: str) -> np.ndarray:
        """Probability by language of the last letter after those before it."""
        zero = np.zeros(len(self.languages))
        seen = self.counts.get(gram, zero)
        if len(gram) == 1:
            if not self._letters:
                self._letters = sum(len(g) == 1 and g != "<" for g in self.counts)
            return (seen + 0.5) / (self.counts.get("", zero) + 0.5 * (self._letters + 1))
        before = self.counts.get("<" + gram[:-1], zero)
        weight = self.rule.weight
        return (seen + weight * self._share(gram[1:])) / (before + weight)

    def gram_number(self, gram: str) -> int:
        number = self._vectors.get(gram)
        if number is None:
            number = self._vectors[gram] = len(self._logs)
            self._logs.append(np.log(self._share(gram)))
        return number

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores by language, 0 for the best candidate and -floor at worst, NEVER for the others;
        and the letters of each word, negative if no language uses its script."""
        if len(self._logs) > CACHED_WORDS:
            self._vectors.clear()
            self._logs.clear()
        numbers, ends = [], [0]
        for word in words:
            numbers += [self.gram_number(g) for g in grams_of(word)]
            ends.append(len(numbers))
        table = np.array(self._logs).reshape(-1, len(self.languages))
        scores = np.add.reduceat(table[numbers], ends[:-1], axis=0) if words else np.zeros((0, len(self.languages)))
        letters = np.array([sum(map(str.isalpha, w)) for w in words], np.int64)
        masks: dict[frozenset, np.ndarray] = {}
        allowed = np.ones(scores.shape, bool)
        for i, word in enumerate(words):
            used = frozenset(script_of(c) for c in word if c.isalpha())
            mask = masks.get(used)
            if mask is None:
                whole = np.array([used <= s for s in self.scripts])
                mask = masks[used] = whole if whole.any() else np.array([not used.isdisjoint(s) for s in self.scripts])
            if mask.any():
                allowed[i] = mask
            else:
                letters[i] *= -1
        best = np.where(allowed, scores, -np.inf).max(axis=1, keepdims=True, initial=-np.inf)
        return np.where(allowed, np.maximum(scores - best, -self.rule.floor), NEVER), letters


def fit_languages(docs: DataFrame, rule: LanguageRule | None = None, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> LanguageModel:
    """Counts of a sample of ``docs`` by language; rows without text or language teach nothing.

    The driver gets the number of documents per language and at most ``max_grams`` counts of each.
    Languages are taken to be a short list of codes.
    """
    rule = rule or LanguageRule()
    source = docs.select(
        docs[id_column].cast("string").alias("id"), docs[text_column].cast("string").alias("text"), docs[lang_column].cast("string").alias("lang")
    ).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in source.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return LanguageModel([], [], {}, rule)
    parts = 1 << 30
    drawn = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(parts))
    limits = [F.lit(part) for lang, n in sorted(sizes.items()) for part in (lang, min(parts, math.ceil(rule.sample_docs / n * parts)))]
    sample = source.where(drawn < F.element_at(F.create_map(*limits), F.col("lang"))).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            words: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(WORD.findall(lowered(text)))
            for lang, found in words.items():
                seen: Counter = Counter()
                scripts: Counter = Counter()
                for word, n in found.items():
                    for gram in grams_of(word):
                        for at in range(len(gram)):
                            seen[gram[at:]] += n
                    for letter in word:
                        if letter.isalpha():
                            scripts[script_of(letter)] += n
                items = [*seen, *scripts]
                kinds = ["gram"] * len(seen) + ["script"] * len(scripts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(items), pa.string()), pa.array(kinds, pa.string()), pa.array(items, pa.string()), pa.array([*seen.values(), *scripts.values()], pa.int64())],
                    names=["lang", "kind", "item", "n"],
                )

    counts = sample.mapInArrow(run, "lang string, kind string, item string, n bigint").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "item")))
    rows = ranked.where(F.col("rank") <= rule.max_grams).select("lang", "kind", "item", "n").collect()
    return learned([tuple(r) for r in rows], rule)


def learned(rows: list[tuple[str, str, str, int]], rule: LanguageRule) -> LanguageModel:
    """A model from (lang, kind, item, n); a language without a letter isn't learned."""
    languages = sorted({lang for lang, kind, _, _ in rows if kind == "script"})
    place = {lang: i for i, lang in enumerate(languages)}
    letters = [Counter() for _ in languages]
    table: dict[str, np.ndarray] = {}

    def add(gram: str, lang: str, n: int) -> None:
        if gram not in table:
            table[gram] = np.zeros(len(languages), np.float32)
        table[gram][place[lang]] += n

    for lang, kind, item, n in rows:
        if lang not in place:
            continue
        if kind == "script":
            letters[place[lang]][item] = n
        else:
            add(item, lang, n)
            if len(item) > 1:
                add("<" + item[:-1], lang, n)
            else:
                add("", lang, n)
    scripts = [{s for s, n in found.items() if n >= rule.script_share * found.total()} for found in letters]
    return LanguageModel(languages, scripts, table, rule)


def best_labels(scores: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """Label of every word: for each document (words ``first[d]`` to ``first[d + 1]``) the labels with
    the best sum, each change costing ``switch``. All documents advance together, longest first.

    On ties the label stays, and the first language is taken.
    """
    labels = np.zeros(len(scores), np.int64)
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = first[:-1][order], lengths[order]
    steps = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # documents longer than t
    stays = np.ones(scores.shape, bool)
    origin = np.zeros(len(scores), np.int64)
    sums = scores[starts[: active[0]]] if steps else scores
    ends = np.zeros(len(starts), np.int64)
    for t in range(1, steps):
        n = active[t]
        if n < len(sums):
            ends[n : len(sums)] = sums[n:].argmax(axis=1)
            sums = sums[:n]
        rows = starts[:n] + t
        top = sums.argmax(axis=1)
        jump = sums[np.arange(n), top] - switch
        stay = sums >= jump[:, None]
        stays[rows] = stay
        origin[rows] = top
        sums = np.where(stay, sums, jump[:, None]) + scores[rows]
    if steps:
        ends[: len(sums)] = sums.argmax(axis=1)
    current = ends
    for t in range(steps - 1, -1, -1):
        n = active[t]
        rows = starts[:n] + t
        labels[rows] = current[:n]
        if t:
            kept = stays[rows, current[:n]]
            current[:n] = np.where(kept, current[:n], origin[rows])
    return labels


class Labeller:
    """Labels batches of texts; scores of words are kept between batches."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.number: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.languages)))
        self.letters = np.zeros(0, np.int64)

    def _numbers(self, words: list[str]) -> np.ndarray:
        if len(self.number) > CACHED_WORDS:
            self.__init__(self.model)
        new = [w for w in dict.fromkeys(words) if w not in self.number]
        if new:
            for word in new:
                self.number[word] = len(self.number)
            scores, letters = self.model.word_scores(new)
            self.scores = np.concatenate([self.scores, scores])
            self.letters = np.concatenate([self.letters, letters])
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def label(self, texts: list[str | None], spans: bool) -> list[tuple[str, float, int, list | None]]:
        """(language, score, number of spans, spans) of each text."""
        languages = self.model.languages
        if not languages:
            return [(UNKNOWN, 0.0, 0, [] if spans else None) for _ in texts]
        lows = [lowered(t) if t else "" for t in texts]
        words: list[str] = []
        first = [0]
        for low in lows:
            words += WORD.findall(low)
            first.append(len(words))
        numbers = self._numbers(words)
        letters = self.letters[numbers]
        # Runs of numeral signs that are no letters have no label.
        holds = letters != 0
        bounds = np.concatenate([[0], np.cumsum(holds)])[np.array(first)]
        labels = best_labels(self.scores[numbers[holds]], bounds, self.model.rule.switch)
        letters, places = letters[holds], np.flatnonzero(holds)
        of = np.repeat(np.arange(len(texts)), np.diff(bounds))
        weight = np.bincount(of * len(languages) + labels, np.abs(letters), len(texts) * len(languages)).reshape(len(texts), -1)
        sure = np.bincount(of * len(languages) + labels, np.maximum(letters, 0), len(texts) * len(languages)).reshape(len(texts), -1)
        change = np.concatenate([[True], (labels[1:] != labels[:-1]) | (of[1:] != of[:-1])]) if len(labels) else np.zeros(0, bool)
        n_spans = np.bincount(of[change], minlength=len(texts))
        out = []
        for d, low in enumerate(lows):
            a, b = int(bounds[d]), int(bounds[d + 1])
            if a == b:
                out.append((UNKNOWN, 0.0, 0, [] if spans else None))
                continue
            top = int(weight[d].argmax())
            found = None
            if spans:
                at = [m.span() for m in WORD.finditer(low)]
                heads = a + np.flatnonzero(change[a:b])
                tails = [*(heads[1:] - 1), b - 1]
                found = [
                    (at[places[h] - first[d]][0], at[places[t] - first[d]][1], languages[labels[h]])
                    for h, t in zip(heads.tolist(), tails, strict=True)
                ]
            out.append((languages[top], float(sure[d, top] / weight[d].sum()), int(n_spans[d]), found))
        return out


def label_languages(
    docs: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text", spans: bool = True
) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score, n_spans and, if asked for, ``spans`` (start,
    end, lang; characters of the text, end exclusive, from the span's first letter to its last).

    ``lang_pred`` labels most letters (ties: the first name), ``score`` is the part of all letters in its
    spans whose script some learned language uses. A null text and one without a letter are ``und``,
    with score 0 and no spans; so is every text if no language was learned. Letters of a script no
    language uses get the label that costs least, but add nothing to the score. Repeated rows and
    rows without an id are labelled each; an empty table gives no rows; other columns are not looked at.
    """
    source = docs.select(docs[id_column].alias("doc_id"), docs[text_column].cast("string").alias("text"))
    shape = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model)
        for batch in small_batches(batches, 1):
            rows = labeller.label(batch.column(1).to_pylist(), spans)
            columns = [
                batch.column(0),
                pa.array([r[0] for r in rows], pa.string()),
                pa.array([r[1] for r in rows], pa.float64()),
                pa.array([r[2] for r in rows], pa.int64()),
            ]
            names = ["doc_id", "lang_pred", "score", "n_spans"]
            if spans:
                columns.append(pa.array([[dict(zip(("start", "end", "lang"), s, strict=True)) for s in r[3]] for r in rows], shape))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = source.schema["doc_id"].dataType.simpleString()
    extra = ", spans array<struct<start:bigint,end:bigint,lang:string>>" if spans else ""
    return source.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, n_spans bigint{extra}")
