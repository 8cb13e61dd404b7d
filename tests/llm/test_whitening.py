"""Whitening against NumPy's eigenvectors."""

import math

import numpy as np
from conftest import SF
from pyspark.sql import functions as F

from costlens.llm import queries, whitening


def rows_of(frame):
    out = {}
    for row in frame.collect():
        out.setdefault(row.vec_id, []).append(row)
    return out


def check(found, kept):
    """``kept``: (vec_id, x) of all rows of one width with well parted variances."""
    x = np.unique(np.array([v for _, v in kept], np.int64), axis=0)
    n, sums = len(x), [int(s) for s in x.astype(object).sum(axis=0)]
    centred = x - x.mean(axis=0)
    variance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(variance)
    values, vectors = values[::-1], vectors[:, ::-1]
    top = min(4, x.shape[1])
    signs = {}
    for doc, v in kept:
        rows = sorted(found[doc], key=lambda r: r.component)
        assert [r.component for r in rows][:top] == list(range(1, top + 1)) or len(rows) % top == 0
        for r in rows:
            assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(v, sums))
            assert math.isclose(r.explained, values[r.component - 1] / values.sum(), rel_tol=1e-9, abs_tol=1e-12)
            assert r.identity_error < 1e-8
            expected = (np.array(v) - x.mean(axis=0)) @ vectors[:, r.component - 1] / math.sqrt(values[r.component - 1])
            if abs(expected) > 1e-3:
                sign = signs.setdefault(r.component, math.copysign(1, expected * r.whitened))
                assert math.isclose(sign * r.whitened, expected, rel_tol=1e-6, abs_tol=1e-7)


def floored(vector):
    return [math.floor(256 * c) + 0 for c in vector]


def test_query(spark):
    found = rows_of(queries.QUERIES["op13_whitening"](spark, SF))
    vectors = [(r.vec_id, floored(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(found, vectors)


def test_scales_far_apart(spark):
    """Columns of very unlike size, where one Cholesky step without a shift would lose the small ones."""
    rng = np.random.default_rng(5)
    table = rng.normal(size=(300, 5)) * np.array([1e9, 1e6, 1e3, 10, 1]) @ np.eye(5)
    frame = spark.createDataFrame([(i, [float(c) for c in row]) for i, row in enumerate(table)], "vec_id long, embedding array<double>").repartition(4)
    x = np.array([floored(row) for row in table], np.int64)
    models = whitening.fit(frame.select(whitening.whole_numbers(F.col("embedding")).alias("x")))
    centred = x - x.mean(axis=0)
    variance = np.linalg.svd(centred)[1] ** 2 / len(x)
    assert np.allclose(models[5].variance, variance[:4], rtol=1e-9) and models[5].error < 1e-9


def test_awkward_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(size=3) * [3, 2, 1]], "x") for i in range(40)]
    rows += [(100, rows[0][1], "x"), (0, rows[0][1], "x"), (None, rows[1][1], "x")]
    bad = [(200, None, "x"), (201, [1.0, None, 2.0], "x"), (202, [float("nan"), 1.0, 1.0], "x"), (203, [float("inf"), 1.0, 1.0], "x"), (204, [], "x")]
    other = [(300 + i, [float(i % 2), float(i % 2)], "x") for i in range(6)]  # width 2, one direction only
    frame = spark.createDataFrame(rows + bad + other, "vec_id long, embedding array<double>, x string").withColumn("width", F.lit(1)).withColumn("n", F.lit(1)).repartition(3)
    found = rows_of(whitening.whiten(frame))
    assert not set(found) & {200, 201, 202, 203, 204}
    check(found, [(i, floored(v)) for i, v, _ in rows])
    assert len(found[0]) == 6 and len(found[None]) == 3
    flat = sorted((r.component, r.whitened, r.explained, r.n) for r in found[301])
    assert flat[1][1] == 0.0 and flat[0][3] == 2 and math.isclose(abs(flat[0][1]), 1.0) and math.isclose(flat[0][2], 1.0)


def test_all_equal_and_none(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<double>")
    rows = whitening.whiten(same).collect()
    assert len(rows) == 10 and all(r.whitened == 0 and r.n == 1 and r.deviation == 0 and r.explained == 0 for r in rows)
    assert whitening.whiten(same.limit(0)).count() == 0


def test_large_entries(spark):
    frame = spark.createDataFrame([(1, [1e30]), (2, [-1e30]), (3, [0.5])], "vec_id long, embedding array<double>")
    found = rows_of(whitening.whiten(frame))
    assert found[1][0].deviation is None and len(found) == 3
