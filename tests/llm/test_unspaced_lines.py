"""Line dedup of scripts without spaces."""

from __future__ import annotations

import pytest

from comeback.llm.fuzzy_lines import WHOLE, LineRules, without_repeated_lines
from tests.llm.fixtures import frame


@pytest.mark.parametrize("rule", [LineRules(), WHOLE])
def test_unspaced_lines(spark, rule):
    han = "".join(chr(0x4E00 + 37 * i) for i in range(40))
    thai = "".join(chr(0xE01 + i) for i in range(30))
    near = han[:20] + "\u4e01" + han[21:]
    rows = [(1, f"{han}\n{thai}"), (2, f"{han}\nx"), (3, f"x\n{thai}\n\u4e2d\u6587"), (4, near), (5, "\u4e2d\u6587")]
    got = {r["doc_id"]: (r["text"], r["lines_removed"]) for r in without_repeated_lines(frame(spark, rows), rule).collect()}
    assert got[1] == (rows[0][1], 0) and got[2] == ("x", 1) and got[3] == ("x\n\u4e2d\u6587", 1)
    assert got[5] == (rows[4][1], 0)
    if rule is WHOLE:
        assert got[4] == ("", 1)
