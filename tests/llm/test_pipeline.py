"""The pipeline's stages one by one, on odd rows and on the driver's smallest documents."""

from __future__ import annotations

from pathlib import Path

import pytest

import corpus_pipeline
from test_near_copies import brute_force

SF = Path("/root/testdata/sf0.001")


def test_stages_are_the_agreed_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "simhash_near_dedup", "mixing", "sentencepiece"]


@pytest.mark.skipif(not SF.exists(), reason="no driver tables here")
def test_stages_on_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, str(SF)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if name != "sentencepiece":
            assert docs.columns == columns
            assert docs.join(before, columns, "left_anti").count() == 0  # stages choose rows, they do not change them
        if name == "simhash_near_dedup":
            assert {r.doc_id for r in docs.collect()} == brute_force({r.doc_id: r.text for r in before.collect()})
    assert docs.filter("not round_trip").count() == 0
    assert corpus_pipeline.run(spark, str(SF)).count() == counts[-1]


@pytest.mark.skipif(not SF.exists(), reason="no driver tables here")
def test_stages_take_empty_and_odd_tables(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, kept string, size int, _lang string, _Score string, _doc_kept string"
    odd = spark.createDataFrame([(*r, "xx", "0", "k") for r in [(1, None, None, None, None, "x", 1), (1, None, None, None, None, "x", 1), (None, "", "en", "s", 0, None, None), (2, "a " * 2000, "en", None, 9, None, None), (3, "!", None, "s", 1, None, None)]], kind)
    for name, stage in corpus_pipeline.STAGES:
        for table in (odd, odd.limit(0)):
            out = stage(spark, table, str(SF))
            assert out.count() >= 0
            assert name == "sentencepiece" or out.columns == odd.columns
