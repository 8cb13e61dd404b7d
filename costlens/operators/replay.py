"""Replay of a log through the semantic cache, as an independent set over conflicts found once.

A request is a hit if an earlier stored one with a similar vector is still alive, and an answered miss is stored. So the
stored requests are the lexicographically first independent set, in the order of time and id, of the graph that
links answered requests that could answer each other.

Requests with one vector inside one span of the time to live form a group: at most one of them is ever stored, as it
hides the others. The links between groups of the same or neighbouring spans are found by one exact search and written.
Then rounds decide on all spans of the log at once: the first open request of every group that no earlier open
request of a linked group may answer is stored, and whatever it answers is closed. The earliest open request is always
decided, so the rounds end; their number is the longest chain of requests that each wait for the one before, whatever the
length of the log, since a pause of one span ends a chain. A round reads the open requests and the links, and
writes what stays open; the files of the round before are removed. Requests that are not answered, and those that were hits, are
judged at the end by one join with what is stored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from costlens import constants as K
from costlens.operators.similarity import (
    BLOCK_ROWS, MAX_BROADCAST_ROWS, _CHUNK, _blocks, _in_spans, _matrix, _small, _unit, _vectors,
)
from costlens.session import materialise, new_dir, remove

_SURE = 1 - 1e-9  # at thresholds above, a vector may miss itself by rounding, and copies are not grouped
_LINKS = "a long, b long"


def _similar(threshold: float, span: int, widths):
    """A function of two tables of groups: the pairs with similar vectors that can be alive together."""
    def pairs(asked: pa.Table, known: pa.Table) -> pa.Table:
        a, b = [], []
        width = widths(known)
        directions = _unit(_matrix(known.column("embedding"), width))
        gid, bucket, first, last = (np.asarray(known.column(name)) for name in ("gid", "bucket", "first", "last"))
        for start in range(0, asked.num_rows, _CHUNK):
            some = asked.slice(start, _CHUNK)
            row, place = np.nonzero(_unit(_matrix(some.column("embedding"), width)) @ directions.T >= threshold)
            own = {name: np.asarray(some.column(name))[row] for name in ("gid", "bucket", "first", "last")}
            apart = own["bucket"] - bucket[place]
            near = ((apart == 0) | (apart == 1)) & (first[place] < own["last"] + span) & (own["first"] < last[place] + span)
            a.append(own["gid"][near])
            b.append(gid[place][near])
            other = near & (apart == 1)  # pairs of one span are met from both sides
            a.append(gid[place][other])
            b.append(own["gid"][other])
        join = lambda parts: pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64), pa.int64())
        return pa.table({"a": join(a), "b": join(b)})

    return pairs


def conflicts(groups: DataFrame, span: int, threshold: float, block_rows: int, max_broadcast_rows: int) -> DataFrame:
    """``a, b``: all ordered pairs of linked groups, each group with itself too. Groups: gid, embedding, _dim, bucket, first, last."""
    head = _small(groups, max_broadcast_rows)
    if head is not None:
        dims = np.asarray(head.column("_dim"))
        shared = groups.sparkSession.sparkContext.broadcast({int(d): head.filter(pa.array(dims == d)).combine_chunks() for d in np.unique(dims)})

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                asked, dims = pa.Table.from_batches([batch]), np.asarray(batch.column("_dim"))
                for width, known in shared.value.items():
                    same = asked.filter(pa.array(dims == width))
                    if same.num_rows:
                        yield from _similar(threshold, span, lambda _, width=width: width)(same, known).combine_chunks().to_batches()

        return groups.mapInArrow(search, _LINKS)
    visits = groups.withColumn("_bucket", F.explode(F.array(F.col("bucket"), F.col("bucket") - 1)))
    visits, homes = _in_spans(visits, groups.toDF(*groups.columns).withColumn("_bucket", F.col("bucket")), threshold, block_rows)
    left, right = _blocks(visits, homes, ["_dim", "_cell", "_bucket"], "gid", "gid", block_rows)
    on = ["_dim", "_cell", "_bucket", "_lb", "_rb"]
    pairs = _similar(threshold, span, lambda known: known.column("_dim")[0].as_py())

    def meet(asked: pa.Table, known: pa.Table) -> pa.Table:
        if not asked.num_rows or not known.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        return pairs(asked, known)

    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(meet, _LINKS)


def replay(
    requests: DataFrame, ttl_seconds: int = K.CACHE_TTL_SECONDS, stored: DataFrame | None = None, threshold: float = K.CACHE_THRESHOLD,
    block_rows: int = BLOCK_ROWS, max_broadcast_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Hit or miss of every request when each answered miss is stored for the ones after it.

    ``requests``: ``request_id`` (integer), ``asked_at, embedding, answered``. Returns ``request_id, asked_at, hit, stored``.
    ``stored`` carries earlier stored requests in. A request without a vector, or whose vector is zero, is a miss; one without a
    time is a miss that is not stored.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be positive: unrelated vectors score zero")
    span = ttl_seconds * 1_000_000
    spark = requests.sparkSession
    kept = ["request_id", "asked_at", "embedding"]
    rows = requests.select(*kept, F.coalesce("answered", F.lit(False)).alias("answered"), F.lit(False).alias("carried"))
    if stored is not None:
        rows = rows.unionByName(stored.select(*kept, F.lit(True).alias("answered"), F.lit(True).alias("carried")))
    t = F.unix_micros("asked_at")
    vector = [F.xxhash64("embedding").alias("v1"), F.xxhash64(F.lit("v"), "embedding").alias("v2")]
    alone = F.lit(0) if threshold <= _SURE else F.col("request_id")
    able = t.isNotNull() & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.select("*", t.alias("t"), F.floor(t / span).alias("bucket"), alone.alias("alone"), able.alias("able"), *vector)

    key = ["v1", "v2", "bucket", "alone"]
    groups = rows.where("able").groupBy(*key).agg(F.any_value("embedding").alias("embedding"), F.min("t").alias("first"), F.max("t").alias("last"))
    groups = materialise(_vectors(groups).withColumn("gid", F.monotonically_increasing_id()))
    links = materialise(conflicts(groups.drop(*[k for k in key if k != "bucket"]), span, threshold, block_rows, max_broadcast_rows).distinct())
    events = materialise(rows.drop("embedding").join(groups.select("gid", *key), key, "left").drop(*key))

    folder = new_dir(spark, "replay")
    chosen = events.where("carried AND gid IS NOT NULL").select("gid", "t", "request_id")
    chosen.write.parquet(f"{folder}/chosen/round=0")
    waiting = events.where("answered AND NOT carried AND gid IS NOT NULL").select("gid", "t", "request_id")
    now = f"{folder}/open-0"
    _without(waiting, _reached(chosen, links), span).write.parquet(now)
    number = 0
    while not (waiting := spark.read.schema(_OPEN).parquet(now)).isEmpty():
        number += 1
        path = f"{folder}/chosen/round={number}"
        _free(waiting, links, span).write.parquet(path)
        after = f"{folder}/open-{number}"
        _without(waiting, _reached(spark.read.schema(_OPEN).parquet(path), links), span).write.parquet(after)
        remove(spark, now)
        now = after
    chosen = spark.read.schema(_OPEN).parquet(*[f"{folder}/chosen/round={k}" for k in range(number + 1)])
    hit = _served(events.where("NOT carried AND gid IS NOT NULL"), _reached(chosen, links), span).select("request_id", "t").withColumn("hit", F.lit(True))
    verdicts = events.where("NOT carried").join(hit.withColumnRenamed("t", "_t"), ["request_id"], "left")
    served = F.coalesce("hit", F.lit(False))
    verdicts = materialise(verdicts.select("request_id", "asked_at", served.alias("hit"), (~served & F.col("answered") & F.col("t").isNotNull()).alias("stored")))
    remove(spark, folder)
    return verdicts


_OPEN = "gid long, t long, request_id long"


def _reached(chosen: DataFrame, links: DataFrame) -> DataFrame:
    """``gid, s, sid``: the groups that stored requests can answer, each stored request's own among them."""
    return chosen.join(links, F.col("gid") == F.col("a")).select(F.col("b").alias("gid"), F.col("t").alias("s"), F.col("request_id").alias("sid"))


def _alive(span: int):
    return (F.col("t") < F.col("s") + span) & ((F.col("s") < F.col("t")) | ((F.col("s") == F.col("t")) & (F.col("sid") < F.col("request_id"))))


def _served(rows: DataFrame, reached: DataFrame, span: int) -> DataFrame:
    return rows.join(reached.withColumnRenamed("gid", "_gid"), (F.col("gid") == F.col("_gid")) & _alive(span), "left_semi")


def _without(rows: DataFrame, reached: DataFrame, span: int) -> DataFrame:
    """Open requests that are neither stored themselves nor answered by a stored one."""
    own = (F.col("s") == F.col("t")) & (F.col("sid") == F.col("request_id"))
    return rows.join(reached.withColumnRenamed("gid", "_gid"), (F.col("gid") == F.col("_gid")) & (own | _alive(span)), "left_anti")


def _free(waiting: DataFrame, links: DataFrame, span: int) -> DataFrame:
    """The first open request of every group that no earlier open request of a linked group may answer.

    A linked group counts as alive from its first to its last open request; that may hold a request one round too long, never too short.
    """
    firsts = waiting.groupBy("gid").agg(F.min(F.struct("t", "request_id")).alias("f"), F.max("t").alias("last"))
    own = firsts.select(F.col("gid").alias("a"), "f")
    other = firsts.select(F.col("gid").alias("b"), F.col("f").alias("g"), F.col("last").alias("until"))
    held = links.where("a <> b").join(own, "a").join(other, "b").where((F.col("g") < F.col("f")) & (F.col("until") + span > F.col("f.t")))
    return firsts.join(held.select(F.col("a").alias("gid")), "gid", "left_anti").select("gid", "f.t", "f.request_id")
