"""The incremental job on input that grows between its runs, on copies."""

from __future__ import annotations

import logging
import re
from collections import Counter
from pathlib import Path

import pytest

from jobs import term_assembly as job
from jobs.common import default_config, load_config

SF = Path("/root/testdata/sf0.001")


def brute(rows) -> dict:
    docs, uses = Counter(), Counter()
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        uses.update((r.source, w) for w in words)
        docs.update((r.source, w) for w in set(words))
    return {k: (docs[k], n) for k, n in uses.items()}


def terms(df) -> dict:
    rows = df.collect()
    assert len(rows) == len({(r.case, r.word) for r in rows})
    return {(r.case, r.word): (r.n_docs, r.n_uses) for r in rows}


@pytest.mark.skipif(not SF.exists(), reason="no driver tables here")
def test_two_runs_over_growing_input(spark, tmp_path, caplog):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    table, args = str(tmp_path / "documents.parquet"), (str(tmp_path / "documents.parquet"), str(tmp_path / "out"), str(tmp_path / "mark"), default_config(job.NAME))
    first, second = docs.filter("doc_id % 3 = 0"), docs.filter("doc_id % 3 <> 0")
    first.coalesce(2).write.parquet(table)
    with caplog.at_level(logging.INFO, logger="tessera.jobs"):
        assert terms(job.run(spark, *args)) == brute(first.collect())
        second.coalesce(1).write.mode("append").parquet(table)
        want = brute(docs.collect())
        assert terms(job.run(spark, *args)) == want
        files = sorted(p for p in (tmp_path / "out").rglob("*.parquet") if p.stat().st_size)
        assert terms(job.run(spark, *args)) == want  # nothing new, nothing changed
    assert [int(re.search(r"read (\d+) new", m).group(1)) for m in caplog.messages] == [first.count(), second.count(), 0]
    kept = {p for p in files if "batch=" in str(p) or "part=" in str(p)}
    assert kept <= set((tmp_path / "out").rglob("*.parquet"))
    # only what a batch touches is written: partial sums have both batches
    partials = spark.read.schema(job.PARTIALS).parquet(str(tmp_path / "out/partials"))
    assert sorted(r.batch for r in partials.select("batch").distinct().collect()) == [0, 1]
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    """A lost checkpoint of the last batch: the same files come as the same batch."""
    table, out = str(tmp_path / "d.parquet"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a b a", "s", "x"), (2, None, None, "x"), (2, None, None, "x"), (3, "b \x0b c", None, "x"), (4, "", "t/u=1", "x"), (5, "é", "t/u=1", "x")], "doc_id long, text string, source string, word string").write.parquet(table)
    config = default_config(job.NAME) | {"parts": 3}
    want = {("s", "a"): (1, 2), ("s", "b"): (1, 1), (None, "b"): (1, 1), (None, "c"): (1, 1), ("t/u=1", "é"): (1, 1)}
    assert terms(job.run(spark, table, out, str(tmp_path / "mark1"), config)) == want
    assert terms(job.run(spark, table, out, str(tmp_path / "mark2"), config)) == want


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(str(tmp_path / "d"))
    for _ in range(2):
        assert job.run(spark, str(tmp_path / "d"), str(tmp_path / "out"), str(tmp_path / "mark"), default_config(job.NAME)).count() == 0


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"parts": 2, "text": "body"}')
    assert load_config(tmp_path / "c.json", parts=None, text="html") == {"parts": 2, "text": "html"}


def test_parts_are_worked_out_for_sums_and_not_for_uses(spark):
    docs = spark.createDataFrame([("a b a", "s"), ("a", "s"), (None, "s"), ("", None), ("b", None)], "text string, source string")
    config = default_config(job.NAME)
    rows = [tuple(r) for r in job.contributions(docs, config).select("case", "word", "n_docs", "n_uses").collect()]
    want = [("s", "a", 0, 1)] * 3 + [("s", "b", 0, 1), (None, "b", 0, 1)] + [("s", "a", 1, 0)] * 2 + [("s", "b", 1, 0), (None, "b", 1, 0)]
    assert Counter(rows) == Counter(want)
    sums = job.partial_sums(docs, config)
    assert {(r.case, r.word): (r.n_docs, r.n_uses) for r in sums.collect()} == {("s", "a"): (2, 3), ("s", "b"): (1, 1), (None, "b"): (1, 1)}
    plan = sums._jdf.queryExecution().optimizedPlan().toString()
    summed, below = plan.split("\n", 1)  # the sums' own results come first
    assert summed.startswith("Aggregate") and "crc32" in summed and "crc32" not in below and "struct" not in plan
