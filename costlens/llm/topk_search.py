"""Exact search for the highest inner products, block at a time.

Vectors become whole numbers, floor(256 * component), and stand in an order that brings similar ones together: by
the nearest of a bounded number of sampled pivots. Consecutive rows form blocks, with the largest and smallest
value of every component; consecutive blocks form a shard, one row of a written table, whose matrices are its
forward index. For a query, the summed maxima of its components over a block bound every score in it. A query takes
the blocks of a shard in the order of their bounds, scores all rows of a block through the forward index, and stops
where the bounds fall below its kth score so far. Queries begin in the shard they live in; the kth score
found there goes along to the other shards. An index of shard bounds first tells which shards can matter at all,
so a query is sent to those only. Bounds at the kth score itself count while a smaller vec_id is possible.

Groups are bounded on both sides: a shard holds SHARD rows at most, an index group INDEX shards, and the queries that
meet them are dealt into parts of about PART rows, the shard copied to each part. Work grows as queries times
rows times the share of blocks that bounds can't rule out. The sample of pivots (PIVOTS rows by hash of vec_id)
decides the order of rows and so the speed, never a score.

A candidate is every row but the query's own; repeated rows are rows of their own and may find each other. Vectors that
are null or hold null or non-finite components, and rows without vec_id, take no part. Only vectors of one width meet.
Scores beyond 64 bits count as the bound. Other columns are ignored. Without queries or rows there are no rows.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from costlens.llm.whitening import usable, whole_numbers
from costlens.session import materialise

BLOCK = 128
SHARD = 16_384
INDEX = 1024
PART = 4096
PIVOTS = 256
NO_SCORE, NO_ID = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_CODES = ("<i2", "<i4", "<i8")
_SHARD = "width int, shard long, rows int, block int, ids binary, code int, matrix binary, high binary, low binary, least binary"
_QUERY = "home long, place int, query_id long, code int, vector binary, kth_score long, kth_id long"
_FOUND = "home long, place int, query_id long, vec_id long, score long"


def _packed(table: np.ndarray) -> tuple[int, bytes]:
    """The number of the narrowest code that holds all values, and the bytes."""
    most = int(max(table.max(initial=0), ~table.min(initial=0)))
    code = next(i for i, kind in enumerate(_CODES) if most <= np.iinfo(kind).max)
    return code, table.astype(_CODES[code]).tobytes()


def _unpacked(code: int, data: bytes, width: int, rows: int) -> np.ndarray:
    return np.frombuffer(data, _CODES[code]).astype(np.int64).reshape(rows, width)


def _largest(table: np.ndarray) -> int:
    return int(max(table.max(initial=0), -table.min(initial=0)))


def products(a: np.ndarray, b: np.ndarray, reach: int) -> np.ndarray:
    """Exact inner products of rows, where no sum of products exceeds ``reach``; beyond 64 bits the bound."""
    if reach < 2**24:
        return (a.astype(np.float32, copy=False) @ b.T.astype(np.float32, copy=False)).astype(np.int64)
    if reach < 2**53:
        return (a.astype(np.float64, copy=False) @ b.T.astype(np.float64, copy=False)).astype(np.int64)
    exact = a.astype(object) @ b.T.astype(object)
    return np.array([[min(max(int(s), NO_SCORE + 1), NO_ID) for s in row] for row in exact], np.int64).reshape(len(a), len(b))


def bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The largest possible score of each query in each block, by the summed extremes of its components."""
    reach = 2 * queries.shape[1] * _largest(queries) * max(_largest(high), _largest(low))
    if reach >= 2**53:
        return np.full((len(queries), len(high)), NO_ID)
    return products(np.maximum(queries, 0), high, reach) + products(np.minimum(queries, 0), low, reach)


class Best:
    """The k best (score, vec_id) so far of every query, best first; a given kth is a floor that need not be among them."""

    def __init__(self, count: int, k: int, kth_score: np.ndarray | None = None, kth_id: np.ndarray | None = None):
        self.k = k
        self.scores, self.ids = np.full((count, k), NO_SCORE), np.full((count, k), NO_ID)
        self.kth_score = np.full(count, NO_SCORE) if kth_score is None else kth_score.copy()
        self.kth_id = np.full(count, NO_ID) if kth_id is None else kth_id.copy()

    def possible(self, rows: np.ndarray, bound: np.ndarray, least: np.ndarray) -> np.ndarray:
        kth = self.kth_score[rows]
        return (bound > kth) | ((bound == kth) & (least < self.kth_id[rows]))

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        hopeful = (scores >= self.kth_score[rows, None]).any(axis=1)
        rows, scores = rows[hopeful], scores[hopeful]
        if not len(rows):
            return
        all_scores = np.hstack([self.scores[rows], scores])
        all_ids = np.hstack([self.ids[rows], np.where(scores == NO_SCORE, NO_ID, ids[None, :])])
        order = np.lexsort((all_ids, ~all_scores), axis=1)[:, :self.k]
        self.scores[rows], self.ids[rows] = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_ids, order, 1)
        last, last_id = self.scores[rows, -1], self.ids[rows, -1]
        better = (last > self.kth_score[rows]) | ((last == self.kth_score[rows]) & (last_id < self.kth_id[rows]))
        self.kth_score[rows[better]], self.kth_id[rows[better]] = last[better], last_id[better]


class Shard:
    def __init__(self, row: dict):
        self.width, self.rows = row["width"], row["rows"]
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.matrix = _unpacked(row["code"], row["matrix"], self.width, self.rows)
        self.starts, self.block = np.arange(0, self.rows, row["block"]), row["block"]
        blocks = len(self.starts)
        self.high, self.low = (np.frombuffer(row[name], "<i8").reshape(blocks, self.width) for name in ("high", "low"))
        self.least = np.frombuffer(row["least"], "<i8")
        self.largest = _largest(self.matrix)

    def search(self, queries: np.ndarray, best: Best, own: np.ndarray | None = None) -> int:
        """Adds the rows of this shard to ``best``; ``own`` are the places of the queries themselves. Returns the blocks scored."""
        if not len(queries):
            return 0
        reach = self.width * _largest(queries) * self.largest
        kind = np.float32 if reach < 2**24 else np.float64 if reach < 2**53 else np.int64
        left, right = queries.astype(kind), self.matrix.astype(kind)
        bound = bounds(queries, self.high, self.low)
        order, scored = np.argsort(~bound, axis=1, kind="stable"), 0  # ~bound is -bound - 1, without overflow
        rows = np.arange(len(queries))
        for turn in range(order.shape[1]):
            block = order[rows, turn]
            limit = bound[rows, block]
            rows, block, limit = (part[limit >= best.kth_score[rows]] for part in (rows, block, limit))
            if not len(rows):
                break
            now = best.possible(rows, limit, self.least[block])
            chosen, blocks = rows[now], block[now]
            by_block = np.argsort(blocks, kind="stable")
            cuts = np.flatnonzero(np.diff(blocks[by_block])) + 1
            for part in np.split(by_block, cuts) if len(by_block) else []:
                start = self.starts[blocks[part[0]]]
                end, who = min(start + self.block, self.rows), chosen[part]
                scores = products(left[who], right[start:end], reach)
                if own is not None:
                    inside = np.flatnonzero((own[who] >= start) & (own[who] < end))
                    scores[inside, own[who][inside] - start] = NO_SCORE
                best.add(who, scores, self.ids[start:end])
                scored += len(who)
        return scored


def _cut(shard_rows: int, block: int):
    """Shards of consecutive rows of one width."""
    def shard(number, ids, table):
        starts = np.arange(0, len(ids), block)
        extreme = [part.reduceat(table, starts, axis=0) if table.shape[1] else np.zeros((len(starts), 0), np.int64) for part in (np.maximum, np.minimum)]
        code, matrix = _packed(table)
        values = [table.shape[1], number, len(ids), block, ids.astype("<i8").tobytes(), code, matrix, *(e.astype("<i8").tobytes() for e in extreme),
                  np.minimum.reduceat(ids, starts).astype("<i8").tobytes()]
        kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
        fields = [part.split() for part in _SHARD.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([value], kinds[kind]) for value, (_, kind) in zip(values, fields)], [name for name, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, now = TaskContext.get().partitionId() << 32, [], None

        def cut(last: bool):
            nonlocal held, number
            ids, table = np.concatenate([i for i, _ in held]), np.concatenate([t for _, t in held])
            whole = len(ids) if last else len(ids) // shard_rows * shard_rows
            for start in range(0, whole, shard_rows):
                number += 1
                end = min(start + shard_rows, whole)
                yield shard(number, ids[start:end], table[start:end])
            held = [(ids[whole:], table[whole:])] if whole < len(ids) else []

        for batch in batches:
            lists = batch["x"]
            values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            ids, widths = batch["vec_id"].to_numpy(), np.diff(offsets)
            ends = np.concatenate([np.flatnonzero(np.diff(widths)) + 1, [len(ids)]]) if len(ids) else []
            start = 0
            for end in ends:
                width = int(widths[start])
                if held and now != width:
                    yield from cut(True)
                now = width
                held.append((ids[start:end], values[offsets[start]:offsets[end]].reshape(end - start, width)))
                start = end
            if sum(len(i) for i, _ in held) >= shard_rows:
                yield from cut(False)
        if held:
            yield from cut(True)

    return run


def _found_table(home, place, query_id, best: Best) -> pa.Table:
    rows, at = np.nonzero(best.scores != NO_SCORE)
    return pa.table({"home": home[rows], "place": place[rows], "query_id": query_id[rows], "vec_id": best.ids[rows, at], "score": best.scores[rows, at]})


def _at_home(k: int, every: int):
    """Queries with what their own shard holds: one row for each result, and the query itself with its kth."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                place = np.flatnonzero(shard.ids % every == 0)
                queries = shard.matrix[place]
                best = Best(len(place), k)
                shard.search(queries, best, place)
                count = len(place)
                found = [[(int(i), int(s)) for i, s in zip(ids, scores) if s != NO_SCORE] for ids, scores in zip(best.ids, best.scores)]
                vectors = [_packed(q[None, :]) for q in queries]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(count, shard.width, np.int32)), pa.array(np.full(count, row["shard"], np.int64)), pa.array(place.astype(np.int32)),
                    pa.array(shard.ids[place]), pa.array([c for c, _ in vectors], pa.int32()), pa.array([v for _, v in vectors], pa.binary()),
                    pa.array(best.kth_score), pa.array(best.kth_id),
                    pa.array([[{"vec_id": i, "score": s} for i, s in part] for part in found], pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.int64())]))),
                ], ["width", "home", "place", "query_id", "code", "vector", "kth_score", "kth_id", "found"])

    return run


def _matrix(table: pa.Table, width: int) -> np.ndarray:
    rows = [_unpacked(code, vector, width, 1) for code, vector in zip(table["code"].to_pylist(), table["vector"].to_pylist())]
    return np.concatenate(rows) if rows else np.zeros((0, width), np.int64)


def _whereto(index: pa.Table, queries: pa.Table) -> pa.Table:
    """The shards of an index group that can hold a result, for each query."""
    if index.num_rows and queries.num_rows:
        width = index["width"][0].as_py()
        high, low = (np.stack([np.frombuffer(row, "<i8") for row in index[name].to_pylist()]) for name in ("top", "bottom"))
        shards, least = index["shard"].to_numpy(), index["first"].to_numpy()
        bound = bounds(_matrix(queries, width), high, low)
        kth, kth_id, home = (queries[name].to_numpy()[:, None] for name in ("kth_score", "kth_id", "home"))
        rows, at = np.nonzero(((bound > kth) | ((bound == kth) & (least[None, :] < kth_id))) & (shards[None, :] != home))
        picked = queries.select([part.split()[0] for part in _QUERY.split(", ")]).take(pa.array(rows))
        return pa.table({"width": np.full(len(rows), width, np.int32), "shard": shards[at]} | {name: picked[name] for name in picked.column_names})
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.table({part.split()[0]: pa.array([], kinds[part.split()[1]]) for part in ("width int, shard long, " + _QUERY).split(", ")})


def _elsewhere(k: int):
    def run(shards: pa.Table, queries: pa.Table) -> pa.Table:
        empty = Best(0, k)
        if not shards.num_rows or not queries.num_rows:
            nothing = np.empty(0, np.int64)
            return _found_table(nothing, nothing.astype(np.int32), nothing, empty)
        shard = Shard(shards.slice(0, 1).to_pylist()[0])
        best = Best(queries.num_rows, k, queries["kth_score"].to_numpy(), queries["kth_id"].to_numpy())
        shard.search(_matrix(queries, shard.width), best)
        return _found_table(queries["home"].to_numpy(), queries["place"].to_numpy(), queries["query_id"].to_numpy(), best)

    return run


def _near_pivots(pivots: dict[int, np.ndarray]):
    def run(batches):
        for batch in batches:
            lists = batch["x"]
            values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            widths, near = np.diff(offsets), np.zeros(len(batch), np.int32)
            for width in np.unique(widths):
                if width in pivots:
                    rows = np.flatnonzero(widths == width)
                    table = values[offsets[rows][:, None] + np.arange(width)].astype(float)
                    near[rows] = (table @ pivots[width].T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], lists, pa.array(widths.astype(np.int32)), pa.array(near)], ["vec_id", "x", "width", "near"])

    return run


def _dealt(holders: DataFrame, asked: DataFrame, keys: list[str], part_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``part``: queries of one holder in parts of about ``part_rows``, the holder copied to each."""
    parts = asked.groupBy(*keys).agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))
    held = holders.join(parts, keys).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    own = F.pmod(F.xxhash64("home", "place"), F.col("parts")).cast("int")
    return held, asked.join(parts, keys).withColumn("part", own).drop("parts")


def search(
    vectors: DataFrame, every: int = 50, k: int = 5, block: int = BLOCK, shard_rows: int = SHARD, index_rows: int = INDEX, part_rows: int = PART,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best rows for each row whose vec_id is divisible by ``every``."""
    rows = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(F.col("embedding")).alias("x"))
    sample: dict[int, list] = {}
    for row in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect():
        sample.setdefault(len(row.x), []).append(np.array(row.x, float))
    pivots = {width: np.stack([p / max(np.linalg.norm(p), 1e-300) for p in found]) for width, found in sample.items()}
    order = ["width", "near", "vec_id"]
    near = materialise(rows.mapInArrow(_near_pivots(pivots), "vec_id long, x array<long>, width int, near int"))
    total = near.count()
    shards = materialise(near.repartitionByRange(max(1, -(-total // shard_rows)), *order).sortWithinPartitions(*order).mapInArrow(_cut(shard_rows, block), _SHARD))

    at_home = materialise(shards.mapInArrow(_at_home(k, every), f"width int, {_QUERY}, found array<struct<vec_id:long,score:long>>"))
    count = shards.count()
    groups = -(-count // index_rows)

    def summed_up(batches):
        for batch in batches:
            table = batch.to_pydict()
            shapes = [(len(least) // 8, width) for least, width in zip(table["least"], table["width"])]
            high = [np.frombuffer(h, "<i8").reshape(shape).max(axis=0).tobytes() for h, shape in zip(table["high"], shapes)]
            low = [np.frombuffer(h, "<i8").reshape(shape).min(axis=0).tobytes() for h, shape in zip(table["low"], shapes)]
            least = [int(np.frombuffer(row, "<i8").min()) for row in table["least"]]
            yield pa.RecordBatch.from_arrays([batch["width"], batch["shard"], pa.array(high, pa.binary()), pa.array(low, pa.binary()), pa.array(least, pa.int64())], ["width", "shard", "top", "bottom", "first"])

    index = shards.select("width", "shard", "high", "low", "least").mapInArrow(summed_up, "width int, shard long, top binary, bottom binary, first long")
    index = index.withColumn("group", F.pmod(F.xxhash64("shard"), F.lit(groups or 1)).cast("int"))
    asked = at_home.drop("found").withColumn("group", F.explode(F.sequence(F.lit(0), F.lit((groups or 1) - 1))))
    held, dealt = _dealt(index, asked, ["width", "group"], part_rows)
    sent = held.groupBy("width", "group", "part").cogroup(dealt.groupBy("width", "group", "part")).applyInArrow(_whereto, f"width int, shard long, {_QUERY}")
    held, dealt = _dealt(shards, materialise(sent), ["width", "shard"], part_rows)
    away = held.groupBy("width", "shard", "part").cogroup(dealt.groupBy("width", "shard", "part")).applyInArrow(_elsewhere(k), _FOUND)

    here = at_home.select("home", "place", "query_id", F.explode("found").alias("f")).select("home", "place", "query_id", "f.vec_id", "f.score")
    best = Window.partitionBy("home", "place").orderBy(F.desc("score"), "vec_id")
    return here.unionByName(away).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
