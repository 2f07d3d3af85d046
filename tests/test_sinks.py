"""Number text of the COO writer against C's formatting."""

from __future__ import annotations

from tessera.sources import sinks


def test_coo_text_rounds_ties_to_even_as_c_does(spark):
    ties = [100005.0, 100015.0, 270045.0, -100005.0, 1000050.0, 0.5, 0.0, 1e-300, 123456789.0]
    mat = spark.createDataFrame([(i, i, v) for i, v in enumerate(ties)], "row long, col long, val double")
    got = {r.row: r.value for r in sinks.coo_table(mat).collect()}
    assert got == {i: f"{v:.4e}" for i, v in enumerate(ties)}
    assert got[0] == "1.0000e+05" and got[2] == "2.7004e+05"
