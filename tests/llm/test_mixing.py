"""Rates of the mix against a root found by bisection, and copies against targets."""

import math
from collections import defaultdict

import pytest
from conftest import SF
from pyspark.sql import functions as F

from costlens.llm import mixing

DDL = "doc_id long, text string, source string"


def brute_targets(sizes):
    """Source -> target: shares by weight, the excess of capped sources shared anew until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {name: (3, 1, 2)[i % 3] for i, name in enumerate(names)}
    total, capped = 1.5 * sum(map(sum, sizes.values())), set()
    while True:
        left = total - sum(2 * sum(sizes[s]) for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        target = {s: 2 * sum(sizes[s]) if s in capped else left * weight[s] / free for s in names}
        above = {s for s in names if target[s] > 2 * sum(sizes[s])}
        if not above - capped:
            return target
        capped |= above


def brute_tilt(sizes, target):
    mean = sum(sizes) / len(sizes)
    words = lambda t: sum(n * min(2.0, math.exp(min(50, t * n / mean))) for n in sizes)
    low, high = -2.0**30, 2.0**30
    for _ in range(300):
        middle = (low + high) / 2
        low, high = (middle, high) if words(middle) < target else (low, middle)
    return low, mean


def checked(rows):
    sizes = defaultdict(list)
    for r in rows:
        sizes[r.source].append(r.size)
    targets = brute_targets(sizes)
    for source, own in sizes.items():
        mine = [r for r in rows if r.source == source]
        assert all(r.source_size == sum(own) and math.isclose(r.target, targets[source], rel_tol=1e-9) for r in mine)
        assert all(0 <= r.copies <= 2 and r.taken == r.copies * r.size for r in mine)
        if 0 < targets[source] < 2 * sum(own) * (1 - 1e-9):
            tilt, mean = brute_tilt(own, targets[source])
            for r in mine:
                assert math.isclose(r.rate, 1.0 if not r.size else min(2.0, math.exp(tilt * r.size / mean)), rel_tol=1e-5)
        yield source, targets[source], sum(r.taken for r in mine)


@pytest.mark.parametrize("few", [0, 10_000])
def test_mix_of_documents(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW_SOURCES", few)
    rows = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    for source, target, taken in checked(rows):
        assert abs(taken - target) <= 0.03 * target, source  # a dozen documents a source
    again = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet").repartition(5)).collect()
    assert sorted((r.doc_id, r.copies) for r in rows) == sorted((r.doc_id, r.copies) for r in again)


def test_unlike_sources(spark):
    """One source that is capped, one thinned to a small part, one of very long and very short texts, one without words."""
    rows = [(i, "w " * (1 + i % 7), "a") for i in range(30)] + [(100 + i, "w " * (1 + i % 50), "b") for i in range(600)]
    rows += [(1000 + i, "w " * (1 if i % 2 else 3000), "c") for i in range(60)] + [(2000, "", "d"), (2001, None, "d"), (2002, " \n", None)]
    found = mixing.mix(spark.createDataFrame(rows, DDL)).collect()
    assert len(found) == len(rows)
    for source, target, taken in checked(found):
        assert abs(taken - target) <= (1500 if source == "c" else 5), source


def test_rows_without_id(spark):
    rows = [(None, f"{s} {i} " + "w " * (i % 20), s) for s in "abc" for i in range(100)]
    docs = spark.createDataFrame(rows, DDL)
    for name in ("_copies", "row", "class", "bin", "lambda", "chance", "size", "target", "cuts", "col"):
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    out = mixing.copies(docs.repartition(3))
    assert out.columns == docs.columns
    kept = out.select("text", "source", "size").collect()
    assert {r["size"] for r in kept} == {"own size"}
    words = defaultdict(int)
    for r in kept:
        words[r.source] += len(r.text.split())
    sizes = defaultdict(list)
    for _, text, source in rows:
        sizes[source].append(len(text.split()))
    for source, target in brute_targets(sizes).items():
        assert abs(words[source] - target) <= 10


def test_copies_are_those_of_the_mix(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    times = {r.doc_id: r["count"] for r in mixing.copies(docs).groupBy("doc_id").count().collect()}
    assert all(times.get(r.doc_id, 0) == r.copies for r in mixing.mix(docs).collect())


def test_without_words(spark):
    rows = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, " ", None)], DDL)).collect()
    assert len(rows) == 3 and all(r.target == 0 and r.taken == 0 for r in rows)
