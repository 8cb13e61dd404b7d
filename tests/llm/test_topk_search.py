"""Search against a loop over all pairs, with blocks, shards, index groups and parts of a few rows."""

import math

import numpy as np
import pytest

from costlens.llm import topk_search


def brute(rows, every, k):
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a, (query, x) in enumerate(kept):
        if query % every == 0:
            scores = [(-sum(p * q for p, q in zip(x, y)), i) for b, (i, y) in enumerate(kept) if b != a and len(y) == len(x)]
            out += [(query, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def found(frame):
    return sorted(tuple(row) for row in frame.select("query_id", "rank", "vec_id", "score").collect())


def vectors():
    rng = np.random.default_rng(11)
    middle = rng.normal(size=(6, 5))
    rows = [(i, [float(c) for c in middle[i % 6] + 0.2 * rng.normal(size=5)]) for i in range(300)]
    rows += [(1000 + i, [0.5, 0.5, 0.5, 0.5, 0.5]) for i in range(60)]  # one vector for many rows: ties
    rows += [(7, rows[7][1]), (10, rows[10][1]), (10, rows[11][1])]  # repeated ids and rows
    rows += [(2000 + i, [float(c) for c in rng.normal(size=3)]) for i in range(12)]  # another width
    rows += [(3000, [1.0]), (3010, []), (3020, []), (None, rows[0][1])]
    rows += [(3100, None), (3110, [1.0, None, 1.0, 1.0, 1.0]), (3120, [float("nan")] * 5), (3130, [float("inf")] * 5)]
    return rows


@pytest.mark.parametrize("sizes", [(4, 16, 3, 5), (128, 16_384, 1024, 4096)])
def test_search(spark, sizes):
    rows = vectors()
    frame = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<double>, width int, x string, shard int").repartition(3)
    assert found(topk_search.search(frame, 10, 4, *sizes)) == brute(rows, 10, 4)


def test_fewer_than_k_and_none(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, -1.0])], "vec_id long, embedding array<float>")
    assert found(topk_search.search(frame)) == [(0, 1, 1, 256 * 256 - 512 * 256)]
    assert topk_search.search(frame.limit(0)).count() == 0
    assert topk_search.search(frame.where("vec_id = 1")).count() == 0


def test_scores_beyond_doubles(spark):
    rows = [(0, [3e6, 1.0]), (1, [3e6, 1.0]), (2, [3e6, 1.01]), (3, [-3e6, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(topk_search.search(frame, 1, 3)) == brute(rows, 1, 3)


def test_bounds_skip_blocks():
    """On rows in clusters most blocks are ruled out, and the result is that of scoring all."""
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(64, 16)) * 300
    table = np.floor(np.repeat(middle, 128, axis=0) + rng.normal(size=(8192, 16)) * 20).astype(np.int64)
    starts = np.arange(0, 8192, 128)
    ids = np.arange(8192)
    code, matrix = topk_search._packed(table)
    shard = topk_search.Shard({
        "width": 16, "rows": 8192, "block": 128, "ids": ids.astype("<i8").tobytes(), "code": code, "matrix": matrix, "high": np.maximum.reduceat(table, starts).tobytes(),
        "low": np.minimum.reduceat(table, starts).tobytes(), "least": np.minimum.reduceat(ids, starts).tobytes()})
    places = np.arange(0, 8192, 50)
    best = topk_search.Best(len(places), 5)
    scored = shard.search(table[places], best, places)
    assert scored < 0.2 * len(places) * 64
    scores = table[places] @ table.T
    scores[np.arange(len(places)), places] = np.iinfo(np.int64).min
    order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores.astype(float)), axis=1)[:, :5]
    assert (best.ids == order).all() and (best.scores == np.take_along_axis(scores, order, 1)).all()
