"""Exact vector search as Spark joins.

``similar_entries`` finds, per query, the best entry at or above a cosine threshold. With a time to live, a query meets the
entries of two spans of time. A span with more entries than a block is cut into the cells of pivot vectors; a query visits only
the cells that can hold an entry close enough. On unit vectors cosine >= c means distance <= r = sqrt(2 - 2c), and a point within r
of the query lies in cell i only if, for every pivot j, the query is at most r beyond the plane
halfway between pivots i and j. That test loses no pair. A cell with many rows is cut into blocks
on both sides, each pair of blocks is one task's matrix product, and a block returns one row per
query at most, so neither a hot cell nor a crowd of copies meets in one task or is spelled out pair
by pair. Without times, the best entry is the nearest one, found as below with the threshold as first bound.
Where all entries fit a small broadcast, which is checked, queries are not moved at all.
Every row of the queries is a query of its own and every row of the entries an entry, whatever their ids:
rows that are moved carry a number written once.

``nearest`` finds the k nearest labelled examples of each query. A small example table, which is
the normal case, is broadcast after its size was checked; a large one streams past parts of the queries, which keep
their best k and a bound on what can still enter. Vectors of unlike widths have similarity 0, like those without direction.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from costlens import constants as K
from costlens.functions.vectors import as_doubles
from costlens.operators.skew import salted_join
from costlens.session import materialise

BLOCK_ROWS = 8192
MAX_PIVOTS = 1024
MAX_BROADCAST_ROWS = 20_000
MAX_BROADCAST_BYTES = 128 * 1024 * 1024
PART_BLOCKS = 4
LANE_BLOCKS = 16
LEAST_TASKS = 64
_CHUNK = 512
_STREAMED = 2048
_SLACK = 1e-7
SCORE_DIGITS = 12


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, width)


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def _pivots(entries: DataFrame, block_rows: int, rows: int | None = None) -> np.ndarray:
    """Up to MAX_PIVOTS unit vectors of one width, one for each block of ``rows`` (of all entries); they decide speed, never results."""
    wanted = min(MAX_PIVOTS, (entries.count() if rows is None else rows) // block_rows)
    if wanted < 2:
        return np.empty((0, 0))
    rows = entries.select("embedding", F.xxhash64("embedding").alias("h")).distinct().orderBy("h").limit(wanted).toArrow()
    vectors = rows.column("embedding").to_pylist()
    widths = [len(v) for v in vectors]
    width = max(set(widths), key=widths.count)
    return _unit(np.array([v for v in vectors if len(v) == width], dtype=np.float64))


def _vectors(df: DataFrame) -> DataFrame:
    """Rows that have a vector, with its width; vectors of unlike widths never meet."""
    return (
        df.withColumn("embedding", as_doubles(F.col("embedding")))
        .withColumn("_dim", F.size("embedding")).where(F.col("_dim") > 0)
    )


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """Add a number of its own for every row, written once so that it stays the same."""
    return materialise(df.withColumn(name, F.monotonically_increasing_id()))


def _with_cells(df: DataFrame, pivots: np.ndarray, reach: float | None, marked: str | None = None) -> DataFrame:
    """Add ``_cell``: the home cell, or with ``reach`` one row per cell to visit. Rows not ``marked`` are all in cell 0."""
    if not len(pivots):
        return df.withColumn("_cell", F.lit(0))
    shared = df.sparkSession.sparkContext.broadcast(pivots)
    schema = T.StructType(df.schema.fields + [T.StructField("_cells", T.ArrayType(T.IntegerType()))])

    def visited(near: np.ndarray, corners: np.ndarray, gaps: np.ndarray) -> list[np.ndarray]:
        """Per query the cells within reach of every halfway plane."""
        closest = near.argmax(axis=1)
        ahead = near[np.arange(len(near)), closest][:, None] - near
        # the plane to the closest pivot rules out most cells, the others are tried on the rest
        query, cell = np.nonzero(ahead <= reach * gaps[closest] + _SLACK)
        keep = np.concatenate([
            (near[q] - near[q, c][:, None] <= reach * gaps[c] + _SLACK).all(axis=1)
            for q, c in ((query[i:i + _CHUNK], cell[i:i + _CHUNK]) for i in range(0, len(query), _CHUNK))])
        return np.split(cell[keep], np.searchsorted(query[keep], np.arange(1, len(near))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corners = shared.value
        gaps = np.sqrt(np.maximum(0.0, 2 - 2 * corners @ corners.T)) if reach is not None else None
        for batch in batches:
            dims = np.asarray(batch.column("_dim"))
            cells: list = [[0]] * len(dims)
            fits = dims == corners.shape[1]
            if marked is not None:
                fits &= np.asarray(batch.column(marked).fill_null(False))
            fits = np.flatnonzero(fits)
            for start in range(0, len(fits), _CHUNK):
                part = fits[start:start + _CHUNK]
                near = _unit(_matrix(batch.column("embedding").take(pa.array(part)), corners.shape[1])) @ corners.T
                found = near.argmax(axis=1)[:, None] if reach is None else visited(near, corners, gaps)
                for row, numbers in zip(part, found):
                    cells[row] = numbers.tolist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cells, pa.list_(pa.int32()))],
                names=[*batch.schema.names, "_cells"])

    return df.mapInArrow(assign, schema).withColumn("_cell", F.explode("_cells")).drop("_cells")


def _in_spans(asked: DataFrame, known: DataFrame, threshold: float, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of a search inside spans of time (``_bucket``) with ``_cell``.

    Only spans with more rows than a block are cut into cells; a question of any other span visits one.
    """
    key = ["_dim", "_bucket"]
    crowds = materialise(known.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > block_rows))
    largest = crowds.agg(F.max("n")).first()[0]
    if largest is None:
        return asked.withColumn("_cell", F.lit(0)), known.withColumn("_cell", F.lit(0))
    crowds = crowds.select(*key, F.lit(True).alias("_crowded"))
    known, asked = (salted_join(df.withColumn("_spread", F.xxhash64("embedding")), crowds, key, "_spread", "left").drop("_spread") for df in (known, asked))
    pivots = _pivots(known.where("_crowded"), block_rows, largest)
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    return (_with_cells(asked, pivots, reach, "_crowded").drop("_crowded"), _with_cells(known, pivots, None, "_crowded").drop("_crowded"))


def _blocks(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, block_rows: int):
    """Cut both sides of each group into blocks and copy every block to its partners.

    The group sizes are looked up through a salted join, so a group of any size is spread.
    """
    def sizes(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.ceil(F.count("*") / block_rows).cast("int").alias(name))

    counts = sizes(left, "_lefts").join(sizes(right, "_rights"), keys)

    def place(df: DataFrame, row_id: str, own: str, other: str, own_block: str, other_block: str) -> DataFrame:
        return (
            salted_join(df, counts, keys, row_id)
            .withColumn(own_block, F.pmod(F.xxhash64(row_id, F.lit(1)), F.col(own)).cast("int"))
            .withColumn(other_block, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
            .drop("_lefts", "_rights")
        )

    return (
        place(left, left_id, "_lefts", "_rights", "_lb", "_rb"),
        place(right, right_id, "_rights", "_lefts", "_rb", "_lb"),
    )


def attach_best(
    queries: DataFrame,
    entries: DataFrame,
    payload: list[str],
    threshold: float = K.CACHE_THRESHOLD,
    ttl_seconds: int | None = None,
    block_rows: int = BLOCK_ROWS,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Every query (without its vector) beside ``cache_id, score`` and the payload of its best entry.

    Queries without a match keep nulls. Equal scores (to 12 digits) go to the smallest cache_id.
    With ``ttl_seconds`` an entry counts only while ``stored_at <= asked_at < stored_at + ttl``.
    """
    timed = ttl_seconds is not None
    span = F.lit((ttl_seconds or 0) * 1_000_000)
    start = F.unix_micros("stored_at") if timed else F.lit(0)
    e = _vectors(entries).select(
        "cache_id", "embedding", "_dim", *payload, *([start.alias("start"), (start + span).alias("until")] if timed else []))
    head = _small(e, max_broadcast_rows)
    if head is not None:
        q = queries.withColumn("embedding", as_doubles(F.col("embedding")))
        if timed:
            q = q.withColumn("at", F.unix_micros("asked_at"))
        return _attach_broadcast(q, e, head, _matcher(threshold, timed), queries.drop("embedding").columns, ["cache_id", *payload])
    q, e = _numbered(queries, "_row"), _numbered(e, "_entry")
    asked = _vectors(q.select("_row", "embedding", *([F.unix_micros("asked_at").alias("at")] if timed else [])))
    stored = e.drop(*payload)
    found = _alive_blocks(asked, stored, (ttl_seconds or 0) * 1_000_000, _matcher(threshold, True), threshold, block_rows) if timed \
        else _untimed_blocks(asked, stored, threshold, block_rows)
    served = salted_join(found.drop("cache_id"), e.select("_entry", "cache_id", *payload), ["_entry"], "_row").drop("_entry")
    return q.drop("embedding").join(served, "_row", "left").select(*queries.drop("embedding").columns, "cache_id", *payload, "score")


def similar_entries(
    queries: DataFrame,
    entries: DataFrame,
    threshold: float = K.CACHE_THRESHOLD,
    ttl_seconds: int | None = None,
    block_rows: int = BLOCK_ROWS,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """``query_id, cache_id, score`` of the queries that have a match (see ``attach_best``)."""
    if ttl_seconds is not None:
        span = ttl_seconds * 1_000_000
        start = F.unix_micros("stored_at")
        return similar_alive(
            queries.select("query_id", "embedding", F.unix_micros("asked_at").alias("at")),
            entries.select("cache_id", "embedding", start.alias("start"), (start + span).alias("until")),
            span, threshold, block_rows=block_rows, max_broadcast_rows=max_broadcast_rows)
    e = _vectors(entries.select("cache_id", "embedding"))
    q = _vectors(queries.select("query_id", "embedding"))
    head = _small(e, max_broadcast_rows)
    if head is not None:
        return _attach_broadcast(q, e, head, _matcher(threshold), ["query_id"], ["cache_id"]).where("cache_id IS NOT NULL")
    q = _numbered(q, "_row")
    found = _untimed_blocks(q, e.withColumn("_entry", F.lit(0).cast("long")), threshold, block_rows)
    return q.select("_row", "query_id").join(found, "_row").select("query_id", "cache_id", "score")


def _untimed_blocks(q: DataFrame, e: DataFrame, threshold: float, block_rows: int) -> DataFrame:
    """``_row, cache_id, _entry, score``: copies of an entry are one entry and copies of a question one question."""
    e = e.groupBy("embedding", "_dim").agg(F.min(F.struct("cache_id", "_entry")).alias("m")).select("embedding", "_dim", "m.*")
    q = q.withColumn("_vector", _vector_key())
    asked = q.groupBy("_vector").agg(F.first("embedding").alias("embedding"), F.first("_dim").alias("_dim"))
    if threshold <= 0:
        raise ValueError("the threshold must be positive: unrelated vectors score zero")
    # the number of an entry travels in the place of a tier
    known = e.select(F.col("cache_id").alias("exemplar_id"), F.col("_entry").cast("string").alias("tier"), "embedding")
    nearby = _nearest_blocks(asked.select("_vector", "embedding"), known, 1, block_rows, threshold).select("_vector", F.explode("neighbours").alias("n"))
    found = nearby.select("_vector", F.col("n.exemplar_id").alias("cache_id"), F.col("n.tier").cast("long").alias("_entry"), F.col("n.similarity").alias("score"))
    return salted_join(q.select("_row", "_vector"), found, ["_vector"], "_row").select("_row", "cache_id", "_entry", "score")


def similar_alive(
    queries: DataFrame, entries: DataFrame, span: int, threshold: float = K.CACHE_THRESHOLD,
    earlier_only: bool = False, block_rows: int = BLOCK_ROWS, max_broadcast_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """The best entry alive when the query is asked: ``start <= at < until``, in microseconds.

    An entry lives past the end of the ``span`` after its start's span by no more than one
    span, so a query meets the entries of its own span and the one before. ``earlier_only``
    orders an entry and a query of the same moment by their integer ids.
    """
    e, q = _vectors(entries), _vectors(queries)
    matcher = _matcher(threshold, timed=True, earlier_only=earlier_only)
    head = _small(e, max_broadcast_rows)
    if head is not None:
        return _attach_broadcast(q, e, head, matcher, ["query_id"], ["cache_id"]).where("cache_id IS NOT NULL")
    q = _numbered(q, "_row")
    found = _alive_blocks(q, e.withColumn("_entry", F.lit(0).cast("long")), span, matcher, threshold, block_rows)
    return q.select("_row", "query_id").join(found, "_row").select("query_id", "cache_id", "score")


def _alive_blocks(q: DataFrame, e: DataFrame, span: int, matcher, threshold: float, block_rows: int) -> DataFrame:
    """``_row, cache_id, _entry, score`` of the queries with a match alive at ``at``."""
    now = F.floor(F.col("at") / span)
    return _best_blocks(
        q.withColumn("_bucket", F.explode(F.array(now, now - 1))),
        e.withColumn("_bucket", F.floor(F.col("start") / span)),
        threshold, matcher, ["_dim", "_cell", "_bucket"], block_rows)


def _small(df: DataFrame, max_rows: int) -> pa.Table | None:
    """The whole frame if it is within the broadcast bounds; its rows are counted and measured before any is fetched."""
    def taken(field: T.StructField) -> Column:
        if isinstance(field.dataType, T.ArrayType):
            return F.coalesce(F.size(field.name), F.lit(0)) * 8
        return F.coalesce(F.octet_length(field.name), F.lit(0)) if isinstance(field.dataType, T.StringType) else F.lit(8)

    held = sum((taken(field).cast("long") for field in df.schema.fields), F.lit(0).cast("long"))
    rows, size = df.select(held.alias("held")).limit(max_rows + 1).agg(F.count("*"), F.sum("held")).first()
    if rows > max_rows or (size or 0) > MAX_BROADCAST_BYTES:
        return None
    head = df.toArrow()
    return head if head.nbytes <= MAX_BROADCAST_BYTES else None


def _vector_key() -> Column:
    """128 bits naming a vector."""
    return F.concat_ws(":", F.xxhash64("embedding").cast("string"), F.xxhash64(F.lit("v"), "embedding").cast("string"))


def _matcher(threshold: float, timed: bool = False, earlier_only: bool = False):
    """A function of questions, entries and the entries' unit vectors: which questions have a
    match, which entry it is, and its score."""
    if threshold <= 0:
        raise ValueError("the threshold must be positive: unrelated vectors score zero")

    def match(asked: pa.Table, stored: pa.Table, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        score = _unit(_matrix(asked.column("embedding"), directions.shape[1])) @ directions.T
        row, entry = np.nonzero(score >= threshold)
        if timed:
            at = np.asarray(asked.column("at"))[row]
            start = np.asarray(stored.column("start"))[entry]
            alive = (start <= at) & (at < np.asarray(stored.column("until"))[entry])
            if earlier_only:
                earlier_id = np.asarray(stored.column("cache_id"))[entry] < np.asarray(asked.column("query_id"))[row]
                alive &= (start < at) | earlier_id
            row, entry = row[alive], entry[alive]
        value = score[row, entry]
        # entries come in id order: among equal rounded scores the smallest id is first
        order = np.lexsort((entry, -np.round(value, SCORE_DIGITS), row))
        best = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
        return row[best], entry[best], value[best]

    return match


def _attach_broadcast(q: DataFrame, e: DataFrame, head: pa.Table, match, kept: list[str], payload: list[str]) -> DataFrame:
    """Every query meets all entries where it is; nothing is shuffled."""
    head = head.sort_by("cache_id")
    dims = np.asarray(head.column("_dim"))
    by_width = {int(d): head.filter(pa.array(dims == d)).combine_chunks() for d in np.unique(dims)}
    shared = q.sparkSession.sparkContext.broadcast((by_width, head.select(payload).slice(0, 0)))
    schema = T.StructType([
        *[q.schema[c] for c in kept], *[T.StructField(c, e.schema[c].dataType) for c in payload], T.StructField("score", T.DoubleType())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, nothing = shared.value
        known = {width: (table, _unit(_matrix(table.column("embedding"), width))) for width, table in tables.items()}
        for batch in batches:
            widths = np.asarray(batch.column("embedding").value_lengths().fill_null(0))
            asked = pa.Table.from_batches([batch])
            for width in np.unique(widths):
                same = asked.filter(pa.array(widths == width))
                for start in range(0, same.num_rows, _CHUNK):
                    yield from answer(same.slice(start, _CHUNK), *known.get(int(width), (None, None)), nothing)

    def answer(asked: pa.Table, stored: pa.Table | None, directions: np.ndarray | None, nothing: pa.Table) -> list[pa.RecordBatch]:
        where = np.full(asked.num_rows, -1)
        score = np.full(asked.num_rows, np.nan)
        if stored is not None:
            rows, best, value = match(asked, stored, directions)
            where[rows], score[rows] = best, value
        missing = pa.array(where < 0)
        spots = pa.Array.from_pandas(where, mask=np.asarray(missing))
        out = [asked.column(c) for c in kept]
        out += [(nothing if stored is None else stored).column(c).take(spots) for c in payload]
        out.append(pa.Array.from_pandas(score, mask=np.asarray(missing)))
        return pa.table(out, names=[*kept, *payload, "score"]).combine_chunks().to_batches()

    return q.mapInArrow(search, schema)


def _best_blocks(q: DataFrame, e: DataFrame, threshold: float, match, keys: list[str], block_rows: int) -> DataFrame:
    """``_row, cache_id, _entry, score``: the best entry of every ``_row`` of the queries that has one."""
    visits, homes = _in_spans(q, e, threshold, block_rows)
    left, right = _blocks(visits, homes, keys, "_row", "cache_id", block_rows)
    on = [*keys, "_lb", "_rb"]

    def meet(asked: pa.Table, stored: pa.Table) -> pa.Table:
        if asked.num_rows == 0 or stored.num_rows == 0:
            return pa.table({
                "_row": asked.column("_row").slice(0, 0), "cache_id": stored.column("cache_id").slice(0, 0),
                "_entry": stored.column("_entry").slice(0, 0), "score": pa.array([], pa.float64())})
        stored = stored.sort_by([("cache_id", "ascending"), ("_entry", "ascending")])
        directions = _unit(_matrix(stored.column("embedding"), stored.column("_dim")[0].as_py()))
        parts = []
        for start in range(0, asked.num_rows, _CHUNK):
            some = asked.slice(start, _CHUNK)
            rows, best, value = match(some, stored, directions)
            parts.append(pa.table({
                "_row": some.column("_row").take(pa.array(rows)), "cache_id": stored.column("cache_id").take(pa.array(best)),
                "_entry": stored.column("_entry").take(pa.array(best)), "score": pa.array(value)}))
        return pa.concat_tables(parts)

    schema = T.StructType([
        T.StructField("_row", q.schema["_row"].dataType), T.StructField("cache_id", e.schema["cache_id"].dataType),
        T.StructField("_entry", T.LongType()), T.StructField("score", T.DoubleType())])
    per_block = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(meet, schema)
    rank = F.struct((-F.round("score", SCORE_DIGITS)).alias("s"), F.col("cache_id").alias("c"), F.col("_entry").alias("e"), F.col("score").alias("x"))
    return per_block.groupBy("_row").agg(F.min(rank).alias("m")).select(
        "_row", F.col("m.c").alias("cache_id"), F.col("m.e").alias("_entry"), F.col("m.x").alias("score"))


# ---- k nearest examples ------------------------------------------------------------------

def _neighbour_type(exemplars: DataFrame) -> T.DataType:
    return T.ArrayType(T.StructType([
        T.StructField("exemplar_id", exemplars.schema["exemplar_id"].dataType),
        T.StructField("tier", T.StringType()),
        T.StructField("similarity", T.DoubleType()),
    ]))


def _by_width(examples: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The places and unit vectors of the examples of each width."""
    examples = examples.combine_chunks()
    widths = np.asarray(examples.value_lengths().fill_null(0))
    places = [(int(width), np.flatnonzero(widths == width)) for width in np.unique(widths) if width > 0]
    return [(place, _unit(_matrix(examples.take(pa.array(place)), width))) for width, place in places]


def _top(asked: pa.Array | pa.ChunkedArray, known: list[tuple[np.ndarray, np.ndarray]], ids: pa.Array, tiers: pa.Array, k: int) -> pa.Array:
    """Per query the k best examples as a list column; examples arrive in id order."""
    if isinstance(asked, pa.ChunkedArray):
        asked = asked.combine_chunks()
    widths = np.asarray(asked.value_lengths().fill_null(-1))
    score = np.zeros((len(asked), len(ids)))
    for places, unit in known:
        fits = np.flatnonzero(widths == unit.shape[1])
        if len(fits):
            score[np.ix_(fits, places)] = _unit(_matrix(asked.take(pa.array(fits)), unit.shape[1])) @ unit.T
    keep = min(k, len(ids))
    rounded = np.round(score, SCORE_DIGITS)
    picked = np.argsort(-rounded, axis=1, kind="stable")[:, :keep]
    flat = pa.array(picked.ravel())
    values = pa.StructArray.from_arrays(
        [ids.take(flat), tiers.take(flat), pa.array(np.take_along_axis(score, picked, axis=1).ravel())],
        names=["exemplar_id", "tier", "similarity"])
    return pa.ListArray.from_arrays(pa.array(np.arange(len(asked) + 1, dtype=np.int32) * keep), values)


def nearest(
    queries: DataFrame, exemplars: DataFrame, k: int = K.ROUTE_TOP_K,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``neighbours``: the k nearest examples, best first, ties to the smallest id.

    Queries need ``query_id`` and ``embedding``; all their columns but the vector are kept.
    Examples need ``exemplar_id, tier, embedding``.
    """
    examples = exemplars.select("exemplar_id", "tier", as_doubles(F.col("embedding")).alias("embedding"))
    queries = queries.withColumn("embedding", as_doubles(F.col("embedding")))
    head = _small(examples, max_broadcast_rows)
    if head is not None and not head.num_rows:
        return queries.drop("embedding").withColumn("neighbours", F.array().cast(_neighbour_type(examples)))
    if head is not None:
        return _nearest_broadcast(queries, examples, head.sort_by("exemplar_id"), k)
    found = _nearest_blocks(queries, examples, k, block_rows)
    return found.withColumn("neighbours", F.coalesce("neighbours", F.array().cast(_neighbour_type(examples))))


def _nearest_broadcast(queries: DataFrame, examples: DataFrame, head: pa.Table, k: int) -> DataFrame:
    shared = queries.sparkSession.sparkContext.broadcast(
        (_by_width(head.column("embedding")), head.column("exemplar_id").combine_chunks(), head.column("tier").combine_chunks()))
    kept = [f for f in queries.schema.fields if f.name != "embedding"]
    schema = T.StructType([*kept, T.StructField("neighbours", _neighbour_type(examples))])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, ids, tiers = shared.value
        for batch in batches:
            asked = batch.column("embedding")
            found = pa.concat_arrays([
                _top(asked.slice(start, _CHUNK), vectors, ids, tiers, k) for start in range(0, len(asked), _CHUNK)])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(f.name) for f in kept], found], names=[*[f.name for f in kept], "neighbours"])

    return queries.mapInArrow(search, schema)


def _parts_and_lanes(asked: int, known: int, block_rows: int) -> tuple[int, int]:
    """In how many parts the queries and lanes the examples are cut; every query is copied to all lanes, every example to all parts."""
    parts, lanes = (max(1, -(-rows // (block_rows * blocks))) for rows, blocks in ((asked, PART_BLOCKS), (known, LANE_BLOCKS)))
    most = max(1, -(-asked // block_rows)), max(1, -(-known // block_rows))
    while parts * lanes < LEAST_TASKS and (parts, lanes) != most:
        if lanes == most[1] or (parts < most[0] and parts <= PART_BLOCKS * lanes):
            parts = min(2 * parts, most[0])
        else:
            lanes = min(2 * lanes, most[1])
    return parts, lanes


def _nearest_blocks(queries: DataFrame, examples: DataFrame, k: int, block_rows: int, floor: float = -np.inf) -> DataFrame:
    """Parts of the queries, each with its running top k, past which the examples stream in lanes.

    Examples get a number that ascends with their id, so ties are told by numbers. They stand in the order of their home
    cells; consecutive rows form chunks, and queries that are too far from the cap around a chunk, by what they
    have already found, don't score it. A part holds up to PART_BLOCKS times ``block_rows`` queries, a lane up to LANE_BLOCKS
    times as many examples, and fewer where there would be less than LEAST_TASKS pairs of them; a query brings home one list
    of k for each lane. Examples less similar than ``floor`` are left out; equal ids are told by their tiers, shorter ones first.
    """
    queries = _numbered(queries, "_row")
    ordered = examples.repartitionByRange("exemplar_id").sortWithinPartitions("exemplar_id", F.length("tier"), "tier")
    examples = _numbered(ordered, "_number")
    parts, lanes = _parts_and_lanes(queries.count(), examples.count(), block_rows)
    homes = _with_cells(examples.withColumn("_dim", F.size("embedding")), _pivots(examples.where(F.size("embedding") > 0), block_rows), None)
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    none = lambda name: F.lit(None).cast(examples.schema[name].dataType).alias(name)
    asked = queries.select(
        F.pmod(F.xxhash64("_row"), F.lit(parts)).cast("int").alias("_part"), each(lanes).alias("_lane"), F.lit(-1).alias("_cell"),
        F.col("_row").alias("_number"), "embedding", none("exemplar_id"), none("tier"))
    known = homes.select(
        each(parts).alias("_part"), F.pmod(F.xxhash64("_number"), F.lit(lanes)).cast("int").alias("_lane"), "_cell", "_number", "embedding", "exemplar_id", "tier")
    key = ["_part", "_lane"]
    met = asked.unionByName(known).repartition(4 * parts * lanes, *key).sortWithinPartitions(*key, "_cell", "_number")  # queries before examples
    found = met.mapInArrow(_streamed(k, floor), T.StructType([
        T.StructField("_row", T.LongType()), T.StructField("number", T.ArrayType(T.LongType())), T.StructField("similarity", T.ArrayType(T.DoubleType())),
        T.StructField("exemplar_id", T.ArrayType(examples.schema["exemplar_id"].dataType)), T.StructField("tier", T.ArrayType(T.StringType()))]))
    one = F.arrays_zip("number", "similarity", "exemplar_id", "tier")
    listed = found.select("_row", F.transform(one, lambda n: F.struct(
        (-F.round(n["similarity"], SCORE_DIGITS)).alias("order"), n["number"].alias("number"), n["exemplar_id"].alias("exemplar_id"),
        n["tier"].alias("tier"), n["similarity"].alias("similarity"))).alias("found"))
    if lanes > 1:
        listed = listed.groupBy("_row").agg(F.flatten(F.collect_list("found")).alias("found"))  # k for each lane
    best = F.slice(F.array_sort("found"), 1, k)
    merged = listed.select("_row", F.transform(best, lambda n: F.struct(n["exemplar_id"].alias("exemplar_id"), n["tier"].alias("tier"), n["similarity"].alias("similarity"))).alias("neighbours"))
    return queries.drop("embedding").join(merged, "_row", "left").drop("_row")


class _Running:
    """The best k examples so far of the queries of one part and lane."""

    def __init__(self, rows: np.ndarray, vectors: pa.Array, k: int, floor: float = -np.inf):
        self.rows, self.k, self.floor = rows, k, floor
        self.widths = np.asarray(vectors.value_lengths().fill_null(-1))
        self.units = {int(w): (place, _unit(_matrix(vectors.take(pa.array(place)), w))) for w in np.unique(self.widths) if w > 0
                      for place in [np.flatnonzero(self.widths == w)]}
        self.rounded = np.full((len(rows), k), -np.inf)
        self.score, self.number = self.rounded.copy(), np.full((len(rows), k), np.iinfo(np.int64).max)
        self.seen: list[pa.Table] = []  # numbers, ids and tiers of the lane
        self.scored = 0

    def add(self, chunk: pa.Table) -> None:
        numbers = np.asarray(chunk.column("_number"))
        known = _by_width(chunk.column("embedding"))
        open_rows = np.ones(len(self.rows), bool)
        if len(known) == 1 and len(known[0][0]) == len(numbers):
            self._close(open_rows, known[0][1])
        changed = False
        for start in range(0, len(self.rows), _CHUNK):
            some = start + np.flatnonzero(open_rows[start:start + _CHUNK])
            if len(some):
                changed |= self._merge(some, numbers, known)
        if changed:
            self.seen.append(chunk.select(["_number", "exemplar_id", "tier"]))

    def _close(self, open_rows: np.ndarray, units: np.ndarray) -> None:
        """Closes queries whose angle to the cap around the chunk rules out every row of it."""
        middle = units.mean(axis=0)
        length = np.linalg.norm(middle)
        if length == 0 or not (np.linalg.norm(units, axis=1) > 0.5).all() or units.shape[1] not in self.units:
            return
        middle /= length
        reach = np.arccos(np.clip((units @ middle).min(), -1, 1))
        place, asked = self.units[units.shape[1]]
        angle = np.arccos(np.clip(asked @ middle, -1, 1))
        bound = np.cos(np.maximum(angle - reach, 0)) + _SLACK
        directed = np.linalg.norm(asked, axis=1) > 0.5
        open_rows[place[directed & (bound < np.maximum(self.rounded[place, -1], self.floor))]] = False

    def _scores(self, some: np.ndarray, count: int, known: list, kind: type) -> np.ndarray:
        score = np.zeros((len(some), count), kind)
        for places, units in known:
            if units.shape[1] in self.units:
                own, asked = self.units[units.shape[1]]
                fits = np.flatnonzero(self.widths[some] == units.shape[1])
                found = asked[np.searchsorted(own, some[fits])].astype(kind, copy=False) @ units.astype(kind, copy=False).T
                if found.shape == score.shape:
                    return found
                score[np.ix_(fits, places)] = found
        return score

    def _exactly(self, some: np.ndarray, row: np.ndarray, place: np.ndarray, count: int, known: list) -> np.ndarray:
        """The scores of single pairs."""
        if 16 * len(row) > len(some) * count:
            return self._scores(some, count, known, np.float64)[row, place]
        score = np.zeros(len(row))
        for places, units in known:
            if units.shape[1] in self.units:
                own, asked = self.units[units.shape[1]]
                at = np.full(count, -1)
                at[places] = np.arange(len(places))
                fits = np.flatnonzero((self.widths[some[row]] == units.shape[1]) & (at[place] >= 0))
                score[fits] = np.einsum("ij,ij->i", asked[np.searchsorted(own, some[row[fits]])], units[at[place[fits]]])
        return score

    def _merge(self, some: np.ndarray, numbers: np.ndarray, known: list) -> bool:
        """Scores in single precision tell which pairs can enter; those are scored again in double precision."""
        near = self._scores(some, len(numbers), known, np.float32)
        self.scored += near.size
        slack = (max(units.shape[1] for _, units in known) + 8) * 2.0**-22 if known else 0.0  # several times the rounding error
        bound, past = np.maximum(self.rounded[some, -1], self.floor), len(numbers) - self.k
        unfilled = np.flatnonzero(bound == -np.inf)
        if len(unfilled) and past >= 0:
            bound[unfilled] = np.partition(near[unfilled], past, axis=1)[:, past] - slack
        row, place = np.divmod(np.flatnonzero(near >= (bound - slack).astype(np.float32)[:, None]), len(numbers))
        score = self._exactly(some, row, place, len(numbers), known)
        rounded = np.round(score, SCORE_DIGITS)
        hopeful = (rounded >= self.rounded[some[row], -1]) & (score >= self.floor)
        row, place, score, rounded = row[hopeful], place[hopeful], score[hopeful], rounded[hopeful]
        if not len(row):
            return False
        count = np.bincount(row, minlength=len(some))
        spot = np.arange(len(row)) - (np.cumsum(count) - count)[row]
        changed = np.flatnonzero(count)
        line = np.searchsorted(changed, row)
        some = some[changed]

        def widened(old: np.ndarray, new: np.ndarray, filler) -> np.ndarray:
            out = np.full((len(some), self.k + count.max()), filler, old.dtype)
            out[:, :self.k] = old[some]
            out[line, self.k + spot] = new
            return out

        joined = [widened(self.rounded, rounded, -np.inf), widened(self.score, score, -np.inf), widened(self.number, numbers[place], np.iinfo(np.int64).max)]
        order = np.lexsort((joined[2], -joined[0]), axis=1)[:, :self.k]
        self.rounded[some], self.score[some], self.number[some] = (np.take_along_axis(part, order, 1) for part in joined)
        return True

    def result(self, kind: pa.DataType) -> pa.RecordBatch:
        there = self.rounded > -np.inf
        offsets = pa.array(np.concatenate([[0], np.cumsum(there.sum(axis=1))]).astype(np.int32))
        numbers = self.number[there]
        ids, tiers = pa.array([], kind), pa.array([], pa.string())
        if self.seen:
            seen = pa.concat_tables(self.seen).combine_chunks()
            seen = seen.sort_by("_number")
            at = pa.array(np.searchsorted(np.asarray(seen.column("_number")), numbers))
            ids, tiers = (seen.column(name).combine_chunks().take(at) for name in ("exemplar_id", "tier"))
        columns = [pa.array(numbers), pa.array(self.score[there]), ids, tiers.cast(pa.string())]
        return pa.RecordBatch.from_arrays(
            [pa.array(self.rows), *[pa.ListArray.from_arrays(offsets, column) for column in columns]], ["_row", "number", "similarity", "exemplar_id", "tier"])


def _streamed(k: int, floor: float = -np.inf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked, running, kind = None, [], None, None

        def ready():
            nonlocal running, asked
            if running is None and asked:
                table = pa.concat_tables(asked)
                running, asked = _Running(np.asarray(table.column("_number")), table.column("embedding").combine_chunks(), k, floor), []
            return running

        for batch in batches:
            table = pa.Table.from_batches([batch])
            kind = table.schema.field("exemplar_id").type
            group = np.asarray(table.column("_part")).astype(np.int64) << 32 | np.asarray(table.column("_lane"))
            is_query = np.asarray(table.column("_cell")) < 0
            edges = np.flatnonzero((np.diff(group) != 0) | (np.diff(is_query.astype(int)) != 0)) + 1
            for start, end in zip([0, *edges], [*edges, table.num_rows]):
                if start == end:
                    continue
                if group[start] != now:
                    if ready():
                        yield running.result(kind)
                    now, asked, running = group[start], [], None
                part = table.slice(start, end - start)
                if is_query[start]:
                    asked.append(part)
                elif ready():
                    for first in range(0, part.num_rows, _STREAMED):
                        running.add(part.slice(first, _STREAMED))
        if ready():
            yield running.result(kind)

    return run


def neighbour_rows(found: DataFrame) -> DataFrame:
    """One row per neighbour: ``query_id, rank, exemplar_id, tier, similarity``."""
    return found.select("query_id", F.posexplode("neighbours").alias("place", "n")).select(
        "query_id", (F.col("place") + 1).cast("long").alias("rank"), "n.exemplar_id", "n.tier", "n.similarity")
