"""Whitening against a plain eigendecomposition, its solver on hard matrices, and its edge cases."""

import math

import numpy as np
import pytest
from conftest import FOLDER
from pyspark.sql import functions as F

from hotgrid import llm
from hotgrid.llm import whitening

QUERY = llm.queries()["op11_contour_whitening"]


def plain(rows):
    """(ids, grid rows, deviations, eigenvalues, vectors, trace) in whole numbers and with numpy's own solver."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    grid = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept]
    distinct = np.array(sorted({tuple(g) for g in grid}), object)
    n, sums = len(distinct), distinct.sum(axis=0)
    centred = ((distinct * n - sums) / n).astype(float)
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    deviations = [int(sum((n * a - s) ** 2 for a, s in zip(g, sums, strict=True))) for g in grid]
    off = np.array([[(n * a - s) / n for a, s in zip(g, sums, strict=True)] for g in grid], float)
    return [i for i, _ in kept], n, deviations, off, values[::-1], vectors[:, ::-1].T, float(np.trace(cov))


def check(spark, rows, got):
    ids, n, deviations, off, values, vectors, trace = plain(rows)
    k = min(16, len(values))
    assert len(got) == k * len(ids)
    at = {i: j for j, i in enumerate(ids)}
    white = np.zeros((len(ids), k))
    for r in got:
        j, c = at[r["vec_id"]], r["component"] - 1
        white[j, c] = r["whitened"]
        assert r["n"] == n and r["deviation"] == deviations[j] and r["identity_error"] <= 1e-4
        assert r["explained"] == pytest.approx(values[c] / trace, rel=1e-9)
    want = off @ vectors[:k].T / np.sqrt(values[:k])
    signs = np.sign((white * want).sum(axis=0))
    assert np.abs(white - want * signs).max() < 1e-8


def test_query_equals_plain(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    check(spark, rows, QUERY(spark, FOLDER).collect())


def test_rows_that_drop_out(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(size=20)]) for i in range(80)]
    rows += [(100, rows[0][1]), (101, [c + 1e-9 for c in rows[1][1]]), (102, None), (103, [None] + rows[2][1][1:]), (104, [math.nan] + rows[3][1][1:])]
    rows += [(105, [math.inf] + rows[3][1][1:]), (106, [-math.inf] + rows[3][1][1:]), (None, rows[5][1])]
    df = spark.createDataFrame([(i, v, 1, "z") for i, v in rows], "vec_id bigint, embedding array<double>, x int, deviation string")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    check(spark, rows, QUERY(spark, str(tmp_path)).collect())


@pytest.mark.parametrize(
    "rows", [[], [(1, None)], [(1, [])], [(1, [2.0, 3.0])], [(1, [2.0, 3.0])] * 3, [(1, [1.0, 2.0]), (2, [3.0])]]
)
def test_nothing_to_scale(spark, tmp_path, rows):
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = QUERY(spark, str(tmp_path))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and not out.collect()


def test_other_lengths_and_huge_entries(spark):
    rows = [(i, [float(i), float(i * i % 7)]) for i in range(9)] + [(20, [1.0]), (21, [1e30, 0.0]), (22, [2.0**39, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, v array<double>").where(whitening.usable(F.col("v")))
    df = df.select("vec_id", whitening.on_grid(F.col("v")).alias("x"))
    got = whitening.components_of(whitening.whiten(df, whitening.fit(df)), whitening.fit(df)).collect()
    assert {r["vec_id"] for r in got} == set(range(9)) | {22}
    assert [r["deviation"] for r in got if r["vec_id"] == 22] == [None] * len([r for r in got if r["vec_id"] == 22])


def turned(values):
    q, _ = np.linalg.qr(np.random.default_rng(len(values)).standard_normal((len(values), len(values))))
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize(
    "values",
    [
        [1.0], [3.0, 3.0], [5.0] * 20 + [1.0] * 30, [1 + 1e-9 * i for i in range(30)] + [0.01 * i for i in range(30)],
        [10.0 ** (-i / 4) for i in range(50)], [1e6, 1e3] + [1.0] * 40, [4.0] * 5 + [0.0] * 40, [0.0] * 4,
    ],
)
def test_solver_misses_none(values):
    matrix = turned(values)
    matrix = (matrix + matrix.T) / 2
    found, vectors = whitening.leading_eigenpairs(matrix, 16)
    want = sorted((v for v in values if v > 1e-12 * max(values)), reverse=True)[:16]
    assert np.allclose(found, want, rtol=0, atol=1e-12 * max(values)) and len(found) == len(want)
    if len(want):
        assert np.abs(vectors @ vectors.T - np.eye(len(want))).max() < 1e-12
        assert np.abs(matrix @ vectors.T - vectors.T * found).max() < 1e-12 * max(values)


def test_inertia_counts():
    matrix = turned([5.0, 4.0, 2.0, 2.0, -1.0, 0.5])
    inertia = whitening.Inertia(matrix)
    assert [inertia.above(s) for s in (6, 4.5, 3, 1, 0, -2)] == [0, 1, 2, 4, 5, 6]
