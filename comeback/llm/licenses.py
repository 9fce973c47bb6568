"""License scans by diagonal voting.

All rolling word 3-gram hashes of the documents are joined with the places of the same 3-grams in
a few templates. A copy of a template shows as many matches on one diagonal (place in the
document minus place in the template); insertions and deletions move it to a neighbouring one.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GRAM = 3
MARK = -1


@dataclass(frozen=True)
class Template:
    """``exact`` templates must stand whole; of the others ``share`` of the 3-grams is enough."""

    label: str
    text: str
    exact: bool = False


# Phrases that count as base matches.
PHRASES = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
)
# Public license notices.
NOTICES = (
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the Software), to deal in the Software without restriction, including without limitation"
        " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,"
        " and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The"
        " above copyright notice and this permission notice shall be included in all copies or substantial portions of"
        " the Software.",
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
        " the following conditions are met: Redistributions of source code must retain the above copyright notice, this"
        " list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above"
        " copyright notice, this list of conditions and the following disclaimer in the documentation and/or other"
        " materials provided with the distribution.",
    ),
    Template(
        "apache-2",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance"
        " with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless"
        " required by applicable law or agreed to in writing, software distributed under the License is distributed on"
        " an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    Template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version.",
    ),
    Template("gpl", "licensed under the GNU General Public License version"),
    Template("mpl-2", "subject to the terms of the Mozilla Public License, v. 2.0."),
    Template("cc-by-nc", "licensed under a Creative Commons Attribution NonCommercial"),
    Template("cc-by-nc", "Licensed under CC BY NC 4.0"),
    Template("cc-by-sa", "licensed under a Creative Commons Attribution ShareAlike"),
)


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def template_grams(templates: Sequence[Template]) -> list[tuple[int, int, list[str]]]:
    out = []
    for number, template in enumerate(templates):
        words = re.findall(WORD, template.text.lower())
        if len(words) < GRAM:
            raise ValueError(f"template {template.text!r} has fewer than {GRAM} words")
        out += [(number, at, words[at : at + GRAM]) for at in range(len(words) - GRAM + 1)]
    return out


#: Divided by every band there is without a rest.
BANDS = 840


def band_of(grams: int) -> int:
    """How far diagonals of one copy may lie apart: a tenth of the template, at most 8 words."""
    return max(1, min(8, grams // 10))


def scan_licenses(
    docs: DataFrame,
    templates: Sequence[Template] = PHRASES + NOTICES,
    share: float = 0.8,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: words, places of exact templates, labels and best share.

    A null or empty text has no words, no places, empty labels and score 0; repeated and null ids
    are scanned each; other columns are not looked at. The templates are broadcast: they are an
    argument, not data, and a scan for more than 100,000 3-grams is refused.
    """
    spark = docs.sparkSession
    grams = template_grams(templates)
    if len(grams) > 100_000:
        raise ValueError("too many templates for one scan")
    sizes = [0] * len(templates)
    for number, _, _ in grams:
        sizes[number] += 1
    hashed = lambda w: [F.xxhash64(*w).alias("h"), F.hash(*w).alias("c")]
    known = spark.createDataFrame([(n, at, *w) for n, at, w in grams], "template int, at int, a string, b string, c string")
    known = known.select("template", "at", *hashed([F.col("a"), F.col("b"), F.col("c")]))
    mark = spark.createDataFrame([(MARK, 0, MARK, MARK)], "template int, at int, h bigint, c int")
    facts = spark.createDataFrame(
        [(n, t.label, t.exact, sizes[n], band_of(sizes[n])) for n, t in enumerate(templates)],
        "template int, label string, exact boolean, grams int, band int",
    )

    # One row per word 3-gram, and one mark per document that carries its number of words.
    words = docs.select(
        docs[id_column].alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.regexp_extract_all(lowered(F.coalesce(docs[text_column].cast("string"), F.lit(""))), F.lit(WORD), F.lit(0)).alias("words"),
    )
    at_word = lambda i: [F.col("words")[i + k] for k in range(GRAM)]
    rolling = F.transform(
        F.when(F.size("words") >= GRAM, F.sequence(F.lit(0), F.size("words") - GRAM)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(i.alias("place"), *hashed(at_word(i))),
    )
    count = F.struct(F.size("words").alias("place"), F.lit(MARK).cast("bigint").alias("h"), F.lit(MARK).alias("c"))
    spread = words.select("doc_id", "row", F.explode(F.concat(F.array(count), rolling)).alias("g"))
    spread = spread.select("doc_id", "row", "g.place", "g.h", "g.c")
    votes = spread.join(F.broadcast(known.unionByName(mark)), ["h", "c"])

    diagonals = votes.groupBy("row", "doc_id", "template", (F.col("place") - F.col("at")).alias("diagonal")).agg(
        F.collect_set("at").alias("seen")
    )
    diagonals = diagonals.join(F.broadcast(facts), "template", "left")

    # Neighbouring diagonals of a template become one span. Each is tried as the span's first: the others
    # lie at most ``band`` beyond, so a span is at most that much longer than its template, however far
    # a chain of neighbours would go on. Places are scaled so that ``band`` is the same for all templates.
    scaled = F.col("diagonal") * F.expr(f"{BANDS} div band")
    along = Window.partitionBy("row", "doc_id", "template").orderBy(scaled).rangeBetween(0, BANDS)
    merged = F.size(F.array_distinct(F.flatten(F.collect_list("seen").over(along))))
    spans = diagonals.withColumn("votes", F.when(F.coalesce("exact", F.lit(True)), F.size("seen")).otherwise(merged))
    spans = spans.withColumnRenamed("diagonal", "first")
    # Verified: an exact template with every 3-gram on its diagonal, others with enough of them.
    spans = spans.withColumn("part", F.col("votes") / F.col("grams"))
    whole = F.col("exact") & (F.col("votes") == F.col("grams"))
    good = F.when(F.col("exact"), whole).otherwise(F.col("part") >= share)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return spans.groupBy("row", "doc_id").agg(
        F.max(F.when(F.col("template") == MARK, F.col("first"))).cast("bigint").alias("n_words"),
        F.count_if(whole).alias("n_base"),
        F.min(F.when(whole, F.col("first"))).cast("bigint").alias("first_word"),
        F.max(F.when(whole, F.col("first"))).cast("bigint").alias("last_word"),
        joined(F.when(whole, F.col("label"))).alias("base_labels"),
        joined(F.when(good, F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(~F.col("exact") | whole, F.col("part"))), F.lit(0.0)).alias("score"),
    ).drop("row")


def scan_sql(templates: Sequence[Template] = PHRASES + NOTICES, share: float = 0.8) -> str:
    """The same scan as DuckDB SQL, on the words themselves instead of their hashes."""
    grams = template_grams(templates)
    sizes = [sum(g[0] == n for g in grams) for n in range(len(templates))]
    places = ", ".join(f"({n}, {at}, '{w[0]}', '{w[1]}', '{w[2]}')" for n, at, w in grams)
    facts = ", ".join(
        f"({n}, '{t.label}', {str(t.exact).lower()}, {sizes[n]}, {band_of(sizes[n])})" for n, t in enumerate(templates)
    )
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{WORD}') AS w
  FROM documents),
known(template, place, a, b, c) AS (VALUES {places}),
facts(template, label, exact, grams, band) AS (VALUES {facts}),
g AS (SELECT r, w, unnest(range(len(w) - 2)) AS i FROM d WHERE len(w) > 2),
votes AS (
  SELECT r, template, i - place AS diagonal, place FROM g JOIN known ON w[i + 1] = a AND w[i + 2] = b AND w[i + 3] = c),
diagonals AS (
  SELECT r, template, diagonal, list(DISTINCT place) AS seen, any_value(label) AS label, any_value(exact) AS exact,
    any_value(grams) AS grams, any_value(band) AS band
  FROM votes JOIN facts USING (template) GROUP BY r, template, diagonal),
spans AS (
  SELECT r, label, exact, diagonal AS first, grams, CASE WHEN exact THEN len(seen) ELSE len(list_distinct(flatten(list(seen) OVER (
    PARTITION BY r, template ORDER BY diagonal * ({BANDS} // band) RANGE BETWEEN CURRENT ROW AND {BANDS} FOLLOWING)))) END AS votes
  FROM diagonals),
judged AS (SELECT *, votes::DOUBLE / grams AS part, exact AND votes = grams AS whole FROM spans),
summed AS (
  SELECT r, count(*) FILTER (whole) AS n_base, min(first) FILTER (whole) AS first_word, max(first) FILTER (whole) AS last_word,
    coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (whole), '') AS base_labels,
    coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (CASE WHEN exact THEN whole ELSE part >= {share} END), '') AS labels,
    max(part) FILTER (NOT exact OR whole) AS score
  FROM judged GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
  last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN summed USING (r)
"""
