"""Transfer between point clouds: nearest neighbours, weights, displacements, loads.

Clouds are (id, x, y, z). `a` points are aerodynamic, `s` points structural. A
transfer table is (a, k, s, d2, w): the k-th neighbour of a, its squared distance and
its weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.dense import rotation
from tessera.session import cut

NUGGET = 1e-8


def knn(a_points: DataFrame, s_points: DataFrame, k: int) -> DataFrame:
    """(a, k, s, d2): the k nearest s of each a, from k = 0, ties to the smaller id; exact.

    Points are put in cubes of a width that holds about k points; an `a` looks in
    its own and the touching cubes. All points within one width are among those, so
    an `a` with k of them within it is settled; the others go on with cubes of twice
    the width. Only equi-joins on cubes; each round joins what is left.
    """
    n, *box = s_points.agg(F.count("*"), *[f(c) for c in "xyz" for f in (F.min, F.max)]).first()
    spread = [hi - lo for lo, hi in zip(box[::2], box[1::2], strict=True)] if n else [0.0]
    a_box = a_points.agg(*[f(c) for c in "xyz" for f in (F.min, F.max)]).first()
    if not n or a_box[0] is None:
        return a_points.sparkSession.createDataFrame([], "a long, k int, s long, d2 double")
    farthest = sum(max(b, d) - min(a, c) for a, b, c, d in zip(box[::2], box[1::2], a_box[::2], a_box[1::2], strict=True)) + 1e-300
    dims = [s for s in spread if s > 1e-12 * max(spread)] or [1.0]
    width = (float(np.prod(dims)) * k / n) ** (1 / len(dims))
    s = cut(s_points.select(F.col("id").alias("s"), *[F.col(c).alias(f"s{c}") for c in "xyz"]))
    left = cut(a_points.select(F.col("id").alias("a"), "x", "y", "z"))
    steps = F.array(*[F.struct(*[F.lit(v).alias(f"d{c}") for v, c in zip(d, "xyz", strict=True)]) for d in np.ndindex(3, 3, 3)])
    out = None
    while True:
        last = width >= farthest
        cells = s.select("*", *[F.floor(F.col(f"s{c}") / width).alias(f"c{c}") for c in "xyz"])
        asks = left.select("*", F.explode(steps).alias("d"))
        asks = asks.select("a", "x", "y", "z", *[(F.floor(F.col(c) / width) + F.col(f"d.d{c}") - 1).alias(f"c{c}") for c in "xyz"])
        d2 = sum((F.pow(F.col(c) - F.col(f"s{c}"), 2) for c in "yz"), F.pow(F.col("x") - F.col("sx"), 2))
        near = asks.join(cells, ["cx", "cy", "cz"]).select("a", "s", d2.alias("d2"))
        if not last:
            near = near.filter(F.col("d2") <= width * width)
        rank = F.row_number().over(Window.partitionBy("a").orderBy("d2", "s")) - 1
        top = cut(near.withColumn("k", rank).filter(F.col("k") < k))
        full = top if last else top.join(top.filter(F.col("k") == k - 1).select("a"), "a", "left_semi")
        out = full if out is None else out.unionByName(full)
        if last:
            break
        left = cut(left.join(full.select("a").distinct(), "a", "left_anti"))
        if not left.take(1):
            break
        width *= 2
    return out.select("a", F.col("k").cast("int").alias("k"), "s", "d2")


def gauss_weights(neighbours: DataFrame, beta: float) -> DataFrame:
    """`neighbours` with w = exp(-beta d2), scaled to sum 1 for each a."""
    raw = F.exp(-beta * F.col("d2"))
    return neighbours.withColumn("w", raw / F.sum(raw).over(Window.partitionBy("a")))


def transfer_table(s_points: DataFrame, a_points: DataFrame, k: int, beta: float) -> DataFrame:
    return gauss_weights(knn(a_points, s_points, k), beta)


def _packed(table: DataFrame, s_points: DataFrame, a_points: DataFrame, *extra: DataFrame) -> DataFrame:
    """(a, pa, ns): a point with its neighbours (k, s, w, their place and the values of `extra`, (id, x, y, z)).

    An a has k neighbours, so the list is bounded.
    """
    rows = table.select("a", "k", "s", "w")
    for i, points in enumerate((s_points, *extra)):
        rows = rows.join(points.select(F.col("id").alias("s"), F.array("x", "y", "z").alias(f"p{i}")), "s")
    packed = rows.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("k", "s", "w", *[f"p{i}" for i in range(1 + len(extra))]))).alias("ns"))
    return packed.join(a_points.select(F.col("id").alias("a"), F.array("x", "y", "z").alias("pa")), "a")


def _arrays(pdf: pd.DataFrame, fields: list[str]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(row numbers, [values]) of rows with equally many neighbours."""
    sizes = pdf["ns"].map(len).to_numpy()
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        rows = [pdf["ns"].iloc[i] for i in at]
        yield at, [np.array([[x[f] for x in r] for r in rows]) for f in fields]


def _lin_operators(w: np.ndarray, xs: np.ndarray, xa: np.ndarray) -> np.ndarray:
    """(A, n, 3, 3): T_n with ua = sum of T_n us_n."""
    mean = np.einsum("an,and->ad", w, xs)
    q, d = xs - mean[:, None], xa - mean
    h = np.einsum("an,ani,anj->aij", w, q, q)
    trace = np.trace(h, axis1=1, axis2=2)[:, None, None] * np.eye(3)
    inv = np.linalg.inv(h - trace + NUGGET * trace)
    turn = lambda v: np.stack([np.stack([0 * v[..., 0], -v[..., 2], v[..., 1]], -1), np.stack([v[..., 2], 0 * v[..., 0], -v[..., 0]], -1), np.stack([-v[..., 1], v[..., 0], 0 * v[..., 0]], -1)], -2)
    return w[..., None, None] * (turn(d)[:, None] @ inv[:, None] @ turn(q) + np.eye(3))


def linear_displacements(table: DataFrame, s_points: DataFrame, a_points: DataFrame, us: DataFrame) -> DataFrame:
    """(id, x, y, z): displacements of the a points by the linearised scheme."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = np.zeros((len(pdf), 3))
            for at, (w, xs, u) in _arrays(pdf, ["w", "p0", "p1"]):
                t = _lin_operators(w, xs, np.stack(pdf["pa"].iloc[at].to_list()))
                out[at] = np.einsum("anij,anj->ai", t, u)
            yield pd.DataFrame({"id": pdf["a"], "x": out[:, 0], "y": out[:, 1], "z": out[:, 2]})

    return _packed(table, s_points, a_points, us).mapInPandas(run, "id long, x double, y double, z double")


def _spread(rows: list, pdf: pd.DataFrame, at: np.ndarray, f: np.ndarray) -> None:
    for i, forces in zip(at, f, strict=True):
        rows += [(n["s"], *v) for n, v in zip(pdf["ns"].iloc[i], forces.tolist(), strict=True)]


def _summed(parts: DataFrame, s_points: DataFrame) -> DataFrame:
    """Sums by point, for every s point: 0 for those that no a point leans on."""
    none = s_points.select("id", *[F.lit(0.0).alias(c) for c in "xyz"])
    return parts.unionByName(none).groupBy("id").agg(*[F.sum(c).alias(c) for c in "xyz"])


def linear_loads(table: DataFrame, s_points: DataFrame, a_points: DataFrame, fa: DataFrame) -> DataFrame:
    """(id, x, y, z): loads on all s points, by the transposes of the same operators; work and total load are kept."""
    loads = fa.select(F.col("id").alias("a"), F.array("x", "y", "z").alias("fa"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list = []
            for at, (w, xs) in _arrays(pdf, ["w", "p0"]):
                t = _lin_operators(w, xs, np.stack(pdf["pa"].iloc[at].to_list()))
                _spread(rows, pdf, at, np.einsum("anij,ai->anj", t, np.stack(pdf["fa"].iloc[at].to_list())))
            yield pd.DataFrame(rows, columns=["id", "x", "y", "z"])

    parts = _packed(table, s_points, a_points).join(loads, "a").mapInPandas(run, "id long, x double, y double, z double")
    return _summed(parts, s_points)


def _rotated(w, x0, u):
    mean0, mean = np.einsum("an,and->ad", w, x0), np.einsum("an,and->ad", w, x0 + u)
    q = x0 - mean0[:, None]
    h = np.einsum("an,ani,anj->aij", w, x0 + u - mean[:, None], q)
    return mean0, mean, q, h


def displacements(table: DataFrame, s_points: DataFrame, a_points: DataFrame, us: DataFrame) -> DataFrame:
    """(id, x, y, z): displacements by the best rigid motion of each a's neighbours (rotation from the covariance)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = np.zeros((len(pdf), 3))
            for at, (w, x0, u) in _arrays(pdf, ["w", "p0", "p1"]):
                xa = np.stack(pdf["pa"].iloc[at].to_list())
                mean0, mean, _, h = _rotated(w, x0, u)
                out[at] = np.einsum("aij,aj->ai", rotation(h), xa - mean0) + mean - xa
            yield pd.DataFrame({"id": pdf["a"], "x": out[:, 0], "y": out[:, 1], "z": out[:, 2]})

    return _packed(table, s_points, a_points, us).mapInPandas(run, "id long, x double, y double, z double")


def loads(table: DataFrame, s_points: DataFrame, a_points: DataFrame, us: DataFrame, fa: DataFrame) -> DataFrame:
    """(id, x, y, z): loads by the transposed derivative of `displacements` at us.

    With H = U S V^T a change dH turns the rotation by U W V^T, where W is the skew
    part of U^T dH V over the sums of singular values; f . dua becomes a sum over
    the neighbours' own displacements.
    """
    forces = fa.select(F.col("id").alias("a"), F.array("x", "y", "z").alias("fa"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list = []
            for at, (w, x0, u) in _arrays(pdf, ["w", "p0", "p1"]):
                xa, f = np.stack(pdf["pa"].iloc[at].to_list()), np.stack(pdf["fa"].iloc[at].to_list())
                mean0, _, q, h = _rotated(w, x0, u)
                left, s, vt = np.linalg.svd(h)
                sign = np.where(np.linalg.det(left @ vt) < 0, -1.0, 1.0)
                left, s = left.copy(), s.copy()
                left[:, :, 2] *= sign[:, None]
                s[:, 2] *= sign
                g, d = np.einsum("aij,ai->aj", left, f), np.einsum("aij,aj->ai", vt, xa - mean0)
                sums = s[:, :, None] + s[:, None, :]
                skew = (g[:, :, None] * d[:, None, :] - g[:, None, :] * d[:, :, None]) / np.where(np.abs(sums) > 1e-300, sums, np.inf)
                m = left @ skew @ vt
                _spread(rows, pdf, at, w[..., None] * (f[:, None] + np.einsum("aij,anj->ani", m, q)))
            yield pd.DataFrame(rows, columns=["id", "x", "y", "z"])

    parts = _packed(table, s_points, a_points, us).join(forces, "a").mapInPandas(run, "id long, x double, y double, z double")
    return _summed(parts, s_points)


def deformed(points: DataFrame, moves: DataFrame) -> DataFrame:
    m = moves.select("id", *[F.col(c).alias(f"u{c}") for c in "xyz"])
    return points.join(m, "id").select("id", *[(F.col(c) + F.col(f"u{c}")).alias(c) for c in "xyz"])
