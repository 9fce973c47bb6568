"""License scans against SQL on whole tables and by hand on odd rows."""

from __future__ import annotations

import random
import re

from comeback.llm import licenses
from tests.llm.fixtures import DATA, frame
from tests.support import normalised, open_duckdb

NOTICE = licenses.NOTICES[0].text


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_equals_sql(spark):
    folder = f"{DATA}/sf0.01"
    database = open_duckdb(folder)
    relation = database.sql(licenses.scan_sql())
    got = licenses.scan_licenses(spark.read.parquet(f"{folder}/documents.parquet"))
    assert normalised(got.columns, rows_of(got)) == normalised(relation.columns, relation.fetchall())


def test_odd_rows(spark):
    rows = [
        (1, None),
        (2, ""),
        (3, "Under the MIT License, cc-by-nc; under THE mit license."),
        (3, "Under the MIT License, cc-by-nc; under THE mit license."),
        (None, "cc by nc"),
        (5, "cc byKnc"),  # the Kelvin sign is no k, and a word of its own neighbours
        (6, "CC BY NC " * 3),
    ]
    got = sorted(rows_of(licenses.scan_licenses(frame(spark, rows, extra=True))), key=repr)
    want = [
        (1, 0, 0, None, None, "", "", 0.0),
        (2, 0, 0, None, None, "", "", 0.0),
        (3, 11, 3, 0, 7, "cc-by-nc,mit", "cc-by-nc,mit", 1.0),
        (3, 11, 3, 0, 7, "cc-by-nc,mit", "cc-by-nc,mit", 1.0),
        (None, 3, 1, 0, 0, "cc-by-nc", "cc-by-nc", 1.0),
        (5, 2, 0, None, None, "", "", 0.0),
        (6, 9, 3, 0, 6, "cc-by-nc", "cc-by-nc", 1.0),
    ]
    assert got == sorted(want, key=repr)
    assert rows_of(licenses.scan_licenses(frame(spark, []))) == []


def test_edited_notice_keeps_its_label(spark):
    """Words put in, left out and changed move the copy to other diagonals, which are merged."""
    rng = random.Random(3)
    words = NOTICE.split()
    edited = list(words)
    for at in sorted(rng.sample(range(len(words)), 6), reverse=True):
        edited[at : at + rng.randint(0, 1)] = rng.choices(["quux", "zork"], k=rng.randint(0, 1))
    half = words[: len(words) // 2]
    rows = [(1, "x " * 50 + " ".join(edited)), (2, " ".join(half)), (3, " ".join(rng.sample(words, len(words))))]
    got = {r[0]: r for r in rows_of(licenses.scan_licenses(frame(spark, rows)))}
    assert got[1][6] == "mit" and 0.8 <= got[1][7] < 1
    assert got[2][6] == "" and 0.4 < got[2][7] < 0.6
    assert got[3][6] == "" and got[3][7] < 0.2


def test_stretched_notice_has_no_label(spark):
    """Every 3-gram in order, each in full after the other: all votes, but no span of the notice's length."""
    for template in licenses.NOTICES:
        words = template.text.split()
        if len(words) < 30:
            continue
        stretched = [w for i in range(len(words) - 2) for w in words[i : i + 3]]
        halves = words[: len(words) // 2] + ["x"] * 40 + words[len(words) // 2 :]
        got = {r[0]: r for r in rows_of(licenses.scan_licenses(frame(spark, [(1, " ".join(stretched)), (2, " ".join(halves)), (3, template.text)])))}
        assert template.label not in got[1][6].split(",") and got[1][7] < 0.5, (template.label, got[1])
        if template.label not in got[2][5].split(","):  # a phrase in a half is a label of its own
            assert template.label not in got[2][6].split(",") and got[2][7] < 0.6
        assert template.label in got[3][6].split(",") and got[3][7] == 1.0


def test_long_text_and_hot_phrase(spark):
    text = "lorem ipsum " * 100_000 + "apache license version 2 " * 5000
    got = rows_of(licenses.scan_licenses(frame(spark, [(1, text)])))
    assert got[0][:6] == (1, 220_000, 5000, 200_000, 200_000 + 4 * 4999, "apache-2")


def test_main_path_is_native(spark):
    plan = licenses.scan_licenses(frame(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
