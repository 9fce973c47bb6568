"""Every stage of the pipeline against brute force on the output of the stage before."""

from __future__ import annotations

import hashlib

import duckdb
import public_tokenizers
import sentencepiece

import __spark_entry__ as contract
import corpus_pipeline
from comeback.llm import fuzzy_lines, quality
from tests.llm import test_fuzzy_lines, test_jaccard
from tests.llm.fixtures import DATA
from tests.llm.test_decontaminate import holders

FOLDER = f"{DATA}/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    outputs = [docs]
    for name, stage in corpus_pipeline.STAGES:
        outputs.append(stage(spark, outputs[-1], FOLDER).cache())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert outputs[-1].columns == COLUMNS
    tables = [{r["doc_id"]: r for r in f.collect()} for f in outputs]
    start, rules, lines, groups, clean, encoded = tables

    references = quality._prepared(quality.language_references(docs, quality.QualityRules()))
    kept = {d for d, r in start.items() if quality.judge(r["text"], r["lang"], references, quality.QualityRules())[6]}
    assert set(rules) == kept and all(rules[d] == start[d] for d in kept)
    good = {r[0] for r in duckdb.sql(f"SELECT doc_id FROM '{DATA}/sf0.001/labels.parquet' WHERE quality = 1").fetchall()}
    assert not {d for d in good & set(start) if len(start[d]["text"].split()) >= 50} - kept

    sketch = fuzzy_lines.WHOLE.sketch
    want = test_fuzzy_lines.brute(spark, [(d, r["text"]) for d, r in rules.items()], sketch=sketch)
    assert {(d, t) for d, t, _, gone in want if not gone or t.strip()} == {(d, r["text"]) for d, r in lines.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in lines.values())

    want = test_jaccard.brute([(d, r["text"]) for d, r in lines.items()], corpus_pipeline.NEAR.percent, corpus_pipeline.NEAR.gram)
    assert {d for d, _, c in want if d == c} == set(groups)

    items = duckdb.sql(f"SELECT item_id, text FROM '{FOLDER}/benchmark.parquet'").fetchall()
    held = holders([(d, r["text"]) for d, r in groups.items()], items)
    assert set(clean) == {d for d in groups if not held[d]}

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert set(encoded) == set(clean)
    for d, r in encoded.items():
        ids = model.encode(clean[d]["text"])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(model.decode(ids).encode()).hexdigest()

    whole = {tuple(r) for r in contract.queries()["pipeline"](spark, FOLDER).collect()}
    assert whole == {tuple(r) for r in encoded.values()}
