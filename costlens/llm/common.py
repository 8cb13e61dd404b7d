"""Helpers that several operators share: words and their hashes, sorted groups in a task, linked groups of rows."""

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

from costlens.session import materialise

_MULTIPLIERS = np.random.default_rng(20240501).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def byte_values(column) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.binary()).to_pylist()


def released(run):
    """``run`` over the batches of a task, which hands its memory back at its end: workers are reused by later tasks of other kinds."""
    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return whole


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows, few at a time, so that what a task derives from a batch stays small."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def window_hashes(hashes: np.ndarray, width: int, variant: int = 0) -> np.ndarray:
    """A 64-bit hash of every ``width`` consecutive word hashes; variants are independent of each other."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = np.full(count, np.uint64(width + 1000 * variant))
    for place in range(width):
        total += hashes[place:place + count] * _MULTIPLIERS[(place + 23 * variant) % 64]
    return mixed(total)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of a stream sorted by ``key``, each with the offsets where its groups begin and end."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        values = table[key].to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1])
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), starts
        rest = table.slice(starts[-1])
    if rest is not None and rest.num_rows:
        yield rest, np.array([0, rest.num_rows])


def linked(count: int, near: Callable[[int], np.ndarray]) -> np.ndarray:
    """Labels of the connected rows of one group, where ``near(i)`` marks the rows linked with row i (and i).

    Rows of the largest part found so far need no comparison among themselves, so only rows outside it
    are compared with all others. The labels are those of comparing all pairs.
    """
    label, done, row = np.arange(count), np.zeros(count, bool), 0
    while True:
        done[row] = True
        joined = np.unique(label[near(row)])
        if len(joined) > 1:
            label[np.isin(label, joined)] = joined[0]
        rest = np.flatnonzero(~done & (label != np.bincount(label).argmax()))
        if not len(rest):
            return label
        row = rest[0]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of undirected edges (a, b): component is the smallest node that can be reached.

    Alternating large-star and small-star steps; each halves the distance to the smallest node. Hubs are
    salted. Nodes without an edge to another node are not listed.
    """
    def state(frame):
        row = frame.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        return row[0], row[1]

    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = state(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        spread = least.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
        large = (
            both.where("b > a").withColumn("_salt", F.pmod(F.xxhash64("b"), F.lit(16)).cast("int"))
            .join(spread, ["a", "_salt"]).select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
        )
        large = materialise(large)
        small = large.groupBy("a").agg(F.min("b").alias("least"))
        now = materialise(
            large.join(small, "a").select(F.explode(F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("e"))
            .select("e.*").where("a <> b").distinct()
        )
        after = state(now)
        if after == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = after


def in_ranges(docs: DataFrame, target_bytes: int) -> tuple[DataFrame, list[int], int]:
    """Documents with ``chunk``, the number of their range of doc_id, of about ``target_bytes`` of text each.

    Ranges ascend with doc_id (null first). Also the smallest id of each range, as found in the data, and all
    bytes of text. Every row of one doc_id is in one range.
    """
    order = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, round(total / target_bytes))
    found = docs.agg(F.percentile_approx(order, [i / count for i in range(count)], 20 * count + 1000).alias("cuts")).first()[0]
    cuts = sorted(set(found or [-(2**63)]))
    splits = [float("-inf"), *sorted({float(cut) for cut in cuts[1:]} - {float(cuts[0])}), float("inf")]
    if len(splits) == 2:
        return docs.withColumn("chunk", F.lit(0).cast("long")), cuts, total
    placed = docs.withColumn("_order", order.cast("double"))
    placed = Bucketizer(splits=splits, inputCol="_order", outputCol="_chunk").transform(placed)
    return placed.withColumn("chunk", F.col("_chunk").cast("long")).drop("_order", "_chunk"), cuts, total
