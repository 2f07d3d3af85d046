"""The static job against its closed form, repeated runs, and odd tables."""

from __future__ import annotations

import logging
from pathlib import Path

import duckdb
import pytest

from jobs import network_static as job
from jobs.common import default_config

SF = Path("/root/testdata/sf0.001")
TABLES = ("nation", "supplier", "customer", "orders", "lineitem")


@pytest.mark.skipif(not SF.exists(), reason="no driver tables here")
def test_query_and_repeated_runs(spark, tmp_path, caplog):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    names = "kind, key, nation, load, moved, reaction"
    want = sorted(con.execute(f"select {names} from ({job.SQL}) q").fetchall(), key=repr)
    args = [*[f"{SF}/{t}.parquet" for t in TABLES], str(tmp_path / "out"), default_config(job.NAME)]
    with caplog.at_level(logging.INFO, logger="tessera.jobs"):
        runs = [sorted(map(tuple, job.run(spark, *args).select(*names.split(", ")).collect()), key=repr) for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == len(want)
    assert all(a[:3] == b[:3] and max(abs(x - y) for x, y in zip(a[3:], b[3:], strict=True)) < 1e-6 for a, b in zip(runs[0], want, strict=True))
    assert len(caplog.messages) == 2 and f"wrote {len(want)} nodes" in caplog.messages[0]
    assert len(list((tmp_path / "out").glob("nation=*"))) == 26


def test_odd_tables(spark, tmp_path):
    rows = {
        "nation": ([(1, 0), (2, None), (3, 0)], "n_nationkey int, n_regionkey int"),
        "supplier": ([(5, 1), (5, 1), (6, 9), (None, 1), (8, None)], "s_suppkey long, s_nationkey int"),
        "customer": ([], "c_custkey long, c_nationkey int"),
        "orders": ([(1,), (None,)], "o_custkey long"),
        "lineitem": ([(5, 3.0), (5, None), (77, 2.0), (None, 1.0)], "l_suppkey long, l_quantity double"),
    }
    for t, (data, kind) in rows.items():
        spark.createDataFrame(data, kind).write.parquet(str(tmp_path / t))
    got = {(r.kind, r.key): (r.load, round(r.moved, 6), round(r.reaction, 6)) for r in job.run(spark, *[str(tmp_path / t) for t in TABLES], str(tmp_path / "out"), default_config(job.NAME)).collect()}
    assert got == {("region", 0): (0, 0, -3), ("nation", 1): (0, 3 / 16, 0), ("nation", 3): (0, 0, 0), ("supplier", 5): (3, 3 / 16 + 3 / 16, 0)}


def test_unbalanced_solution_is_told(spark, tmp_path, monkeypatch):
    for t, (c, k) in {"nation": ("n_nationkey", "n_regionkey"), "supplier": ("s_suppkey", "s_nationkey"), "customer": ("c_custkey", "c_nationkey"), "orders": ("o_custkey", "x"), "lineitem": ("l_suppkey", "l_quantity")}.items():
        spark.createDataFrame([(1, 1)], f"{c} long, {k} long").write.parquet(str(tmp_path / t))
    solve = job.elimination.multifrontal
    monkeypatch.setattr(job.elimination, "multifrontal", lambda a, b: solve(a, b).withColumn("val", job.F.col("val") * 2))
    with pytest.raises(job.NotBalancedError):
        job.run(spark, *[str(tmp_path / t) for t in TABLES], str(tmp_path / "out"), default_config(job.NAME))
    assert not (tmp_path / "out").exists()


def test_no_large_table_goes_through_the_driver(spark, tmp_path, monkeypatch):
    for t, (c, k) in {"nation": ("n_nationkey", "n_regionkey"), "supplier": ("s_suppkey", "s_nationkey"), "customer": ("c_custkey", "c_nationkey"), "orders": ("o_custkey", "x"), "lineitem": ("l_suppkey", "l_quantity")}.items():
        spark.createDataFrame([(1, 1)], f"{c} long, {k} long").write.parquet(str(tmp_path / t))
    key = "spark.sql.autoBroadcastJoinThreshold"
    before, solve, seen = spark.conf.get(key), job.elimination.multifrontal, []
    monkeypatch.setattr(job.elimination, "multifrontal", lambda a, b: seen.append(spark.conf.get(key)) or solve(a, b))
    job.run(spark, *[str(tmp_path / t) for t in TABLES], str(tmp_path / "out"), default_config(job.NAME))
    assert seen == [job.BROADCAST] and spark.conf.get(key) == before
