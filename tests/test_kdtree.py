"""The k-d tree against all distances; clusters, points in one place, few points, none."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import kdtree, transfer

KIND = "id long, x double, y double, z double"


def cloud(spark, at):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], KIND)


def clustered(rng, n):
    at = rng.random((n, 3))
    at[: n * 9 // 10] *= [0.2, 0.2, 0.25]
    return at


def brute(a, s, k):
    d = sum((a[:, None, c] - s[None, :, c]) ** 2 for c in range(3))
    return {(i, r): int(j) for i, row in enumerate(d) for r, j in enumerate(np.lexsort((np.arange(len(s)), row))[:k])}


def found(frame):
    return {(r.a, r.k): r.s for r in frame.collect()}


@pytest.mark.parametrize("kind", ["clustered", "one place", "plane with ties"])
def test_equal_to_all_distances(spark, kind):
    rng = np.random.default_rng(2)
    s = {"clustered": clustered(rng, 600), "one place": np.where(np.arange(300)[:, None] < 250, 0.5, rng.random((300, 3))), "plane with ties": np.c_[rng.integers(0, 9, (400, 2)), np.zeros(400)]}[kind]
    a = np.r_[clustered(rng, 120), [[0.5, 0.5, 0.5], [-3, 7, 2], [4, 4, 0]]]
    assert found(kdtree.knn(cloud(spark, a), cloud(spark, s), 5, leaf_rows=20)) == brute(a, s, 5)


def test_leaves_keep_their_bound(spark):
    s = cloud(spark, np.r_[clustered(np.random.default_rng(4), 1500), np.zeros((500, 3))])
    points, boxes = kdtree.grown(s.limit(10), s, 4, leaf_rows=50)
    leaves = points.filter("is_s").groupBy("node").agg(F.count("*").alias("n"))
    assert leaves.agg(F.max("n")).first()[0] <= 50
    assert leaves.agg(F.sum("n")).first()[0] == 2000 and points.filter("not is_s").count() == 10 and len(boxes) < 25


def test_few_points_and_none(spark):
    three, none = cloud(spark, np.eye(3)), spark.createDataFrame([], KIND)
    assert found(kdtree.knn(three, three, 5)) == brute(np.eye(3), np.eye(3), 5)
    assert kdtree.knn(three, none, 2).count() == 0 and kdtree.knn(none, three, 2).count() == 0
    assert found(kdtree.knn(three, three, 2)) == found(transfer.knn(three, three, 2))
