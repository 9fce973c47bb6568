"""Archives: round trip, splits anywhere, false gzip magic, odd rows."""

from __future__ import annotations

import hashlib
import io
import random
import zlib

import pyarrow as pa
import pytest

from comeback.llm import warc
from comeback.llm.queries import WARC_SQL
from tests.llm.fixtures import DATA
from tests.support import normalised, open_duckdb


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def archive(payloads: list[bytes], level: int = 6) -> tuple[bytes, list[bytes]]:
    parts = []
    for n, payload in enumerate(payloads):
        plain = zlib.decompress(warc.member(n, f"http://x/{n}", payload, hashlib.sha256(payload).hexdigest(), len(payload), None), 31)
        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
        parts.append(packer.compress(plain) + packer.flush())
    return b"".join(parts), parts


@pytest.mark.parametrize("split", [1, 7, 100, 1000, 10**6])
def test_every_split_owns_the_records_that_start_in_it(split):
    rng = random.Random(split)
    payloads = [bytes(rng.choices(b"abc\x1f\x8b\x08", k=rng.randint(0, 300))) for _ in range(30)]
    # stored blocks, and an archive as payload of another one: magic that starts no record
    inner, _ = archive(payloads[:3])
    whole, parts = archive([*payloads, inner, b"\x1f\x8b\x08" * 50, *payloads], level=0)
    starts, at = [], 0
    for p in parts:
        starts.append(at)
        at += len(p)
    found = []
    for low in range(0, len(whole), split):
        got = list(warc._records(pa.PythonFile(io.BytesIO(whole), "r"), low, low + split))
        assert len(got) == sum(low <= s < low + split for s in starts)
        found += got
    assert found == [zlib.decompress(p, 31) for p in parts]


def test_broken_archives_are_refused():
    whole, _ = archive([b"a" * 500, b"b" * 500])
    for broken in (whole[:-30], whole[: len(whole) // 2] + b"zz" + whole[len(whole) // 2 :]):
        with pytest.raises(ValueError):
            for record in warc._records(pa.PythonFile(io.BytesIO(broken), "r"), 0, len(broken)):
                warc.parsed(record)


@pytest.mark.parametrize("split_bytes", [500, 8 << 20])
def test_whole_table(spark, split_bytes):
    folder = f"{DATA}/sf0.01"
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    records = warc.read_archives(warc.write_archives(pages), split_bytes)
    got = records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    relation = open_duckdb(folder).sql(WARC_SQL)
    assert normalised(got.columns, rows_of(got)) == normalised(relation.columns, relation.fetchall())
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in records.where("record_type = 'response'").collect():
        assert bytes(r["payload"]).decode() == html[r["page_id"]]


def test_odd_rows(spark):
    big, small = "é" * 50, "x" * 99
    rows = [
        (5, "u", big), (3, "u", big), (3, "u", big), (None, "u", big), (9, None, big),
        (1, "u", small), (2, "u", small), (4, "u", None), (6, "u", ""), (None, "a b\r\nWARC-Type: x", "y" * 200), (None, "u", "y" * 200),
        (8, "u", "z" * 3_000_000),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS digest", "2 AS size", "3 AS first")
    got = rows_of(warc.round_trip(spark, pages))
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        first = 3 if html == big else None
        revisit = first is not None and page != first
        want.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=repr)
    assert rows_of(warc.round_trip(spark, pages.limit(0))) == []
