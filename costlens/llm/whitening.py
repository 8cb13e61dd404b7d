"""Whitening of embeddings by shifted CholeskyQR.

Entries become whole numbers, x = floor(256 * entry). The model is fitted to every distinct vector once. With A the
table of centred rows, one distributed pass sums the Gram matrix of A; its Cholesky factor, of the Gram matrix plus
a small shift so that it always exists, is R1. The next passes sum the Gram matrix of A divided by the factors so
far, by triangular solves, and give R2 and R3: the quotient has orthonormal columns, and A = Q R with R = R3 R2 R1.
The singular value decomposition of R gives the components: right singular vectors, and variances as squared
singular values over the number of rows. The whitened value of a row is its projection on a component over the
component's standard deviation. Where the columns of A depend on each other, a Gram matrix without a
Cholesky factor is split by its eigenvectors instead, which ends the passes.

A task holds one batch of rows and a Gram matrix; partial matrices are added row by row of the matrix, so that no
task and not the driver sees one for every partition. Partial sums are added in a fixed order.

Vectors that are null or hold null or non-finite entries have no rows. Repeated rows and rows without vec_id get their
own rows. Vectors of unlike widths belong to models of their own. Entries beyond 2^62 / 256 count as that bound.
A component without variance (variance at most 1e-13 of the largest) has whitened 0 and is left out of the error.
``deviation`` beyond 64 bits is null. A table without rows gives none. Other columns are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from costlens.session import materialise

TOP = 4
SCALE = 256.0
FLAT = 1e-13
BOUND = 2.0**62


def usable(vector: Column) -> Column:
    """Neither null nor with null or non-finite entries."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def whole_numbers(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(F.least(F.greatest(c.cast("double") * SCALE, F.lit(-BOUND)), F.lit(BOUND))))


def _tables(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of the vectors of each width in a batch."""
    lists = batch.column(column)
    values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    widths = np.diff(offsets)
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        yield rows, values[offsets[rows][:, None] + np.arange(width)]


def _exploded(table: np.ndarray, width: int, task: int, place: str = "row"):
    count = len(table)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(count, width, np.int32)), pa.array(np.arange(count, dtype=np.int32)), pa.array(np.full(count, task, np.int64)),
         pa.array([row.tobytes() for row in table], pa.binary())], ["width", place, "part", "numbers"])


def _added(partial: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """The sums of partial matrices, by width: rows are added where they meet, and only the sums are collected."""
    def add(batches):
        now, total = None, None
        for batch in batches:
            for width, row, numbers in zip(batch["width"].to_pylist(), batch["row"].to_pylist(), batch["numbers"].to_pylist()):
                if (width, row) != now:
                    if now is not None:
                        yield now, total
                    now, total = (width, row), np.zeros(len(numbers) // 8, kind)
                total = total + np.frombuffer(numbers, kind)
        if now is not None:
            yield now, total

    def run(batches):
        for (width, row), total in add(batches):
            yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([row], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["width", "row", "numbers"])

    sums = partial.repartition("width", "row").sortWithinPartitions("width", "row", "part").mapInArrow(run, "width int, row int, numbers binary")
    found: dict[int, dict[int, np.ndarray]] = {}
    for width, row, numbers in sums.collect():  # a matrix of one model: rows times width
        found.setdefault(width, {})[row] = np.frombuffer(bytes(numbers), kind)
    return {width: np.stack([rows[i] for i in range(len(rows))]) for width, rows in found.items()}


def _task_sums(measure):
    """Adds ``measure(matrix)`` over all rows of a task, for each width."""
    def run(batches):
        from pyspark import TaskContext

        sums = {}
        for batch in batches:
            for _, table in _tables(batch, "x"):
                width = table.shape[1]
                found = measure(width, table)
                sums[width] = sums[width] + found if width in sums else found
        for width, found in sums.items():
            yield _exploded(found, width, TaskContext.get().partitionId())

    return run


PARTIAL = "width int, row int, part long, numbers binary"


def _counts(x: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """n and the exact sums of every dimension, by width; sums are carried in three limbs of 31 bits."""
    def measure(width, table):
        out = np.zeros((width + 1, 3), np.int64)
        out[width, 0] = len(table)
        for limb in range(3):
            part = table >> 62 if limb == 2 else (table >> (31 * limb)) & (2**31 - 1)
            out[:width, limb] = part.sum(axis=0)
        return out

    found = _added(x.mapInArrow(_task_sums(measure), PARTIAL), "<i8")
    return {width: (int(t[width, 0]), [int(a) + (int(b) << 31) + (int(c) << 62) for a, b, c in t[:width]]) for width, t in found.items() if width}


def _grams(x: DataFrame, means: dict[int, np.ndarray], factors: dict[int, list[np.ndarray]]) -> dict[int, np.ndarray]:
    """The Gram matrices of the centred rows divided by the factors so far."""
    def measure(width, table):
        if not width:
            return np.zeros((0, 0))
        rows = (table - means[width]).T
        for factor in factors[width]:
            rows = np.linalg.solve(factor.T, rows)  # a triangular system
        return rows @ rows.T

    return _added(x.mapInArrow(_task_sums(measure), PARTIAL), "<f8")


def _factor(gram: np.ndarray, rows: int, first: bool) -> tuple[np.ndarray, bool]:
    """(F, whether F is triangular and can be divided by) with F' F = gram, shifted in the first pass."""
    width = len(gram)
    if first:
        shift = 11 * (rows * width + width * (width + 1)) * np.finfo(float).eps / 2 * max(np.trace(gram), np.finfo(float).tiny)
        gram = gram + min(shift, 1e-3 * np.trace(gram) / width + np.finfo(float).tiny) * np.eye(width)
    try:
        return np.linalg.cholesky(gram).T, True
    except np.linalg.LinAlgError:
        values, vectors = np.linalg.eigh(gram)
        return np.sqrt(np.maximum(values, 0))[:, None] * vectors.T, False


class Model:
    """What whitening needs of one width: n, exact sums, components as columns, their variances and shares."""

    def __init__(self, n: int, sums: list[int], r: np.ndarray):
        self.n, self.sums = n, sums
        self.mean = np.array([total / n for total in sums])
        _, singular, right = np.linalg.svd(r)
        variance = singular**2 / n
        self.variance, self.components = variance[:TOP], right[:TOP].T
        self.explained = self.variance / variance.sum() if variance.sum() > 0 else np.zeros(len(self.variance))
        self.flat = self.variance <= FLAT * variance[0]
        scale = np.where(self.flat, 0.0, 1 / np.sqrt(np.where(self.flat, 1.0, self.variance)))
        self.projection = self.components * scale
        self.error = 0.0

    def whitened(self, table: np.ndarray) -> np.ndarray:
        return (table - self.mean) @ self.projection

    def deviations(self, table: np.ndarray) -> list[int | None]:
        limit = (self.n * max(int(np.abs(table).max(initial=0)), 1) + max(map(abs, self.sums))) ** 2 * len(self.sums)
        if limit < 2**63:
            return ((self.n * table - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums)) for row in table]
        return [total if total < 2**63 else None for total in exact]


def fit(x: DataFrame) -> dict[int, Model]:
    """A model for each width of ``x`` (array<bigint>), whose rows are distinct."""
    counts = _counts(x)
    means = {width: np.array([total / n for total in sums]) for width, (n, sums) in counts.items()}
    factors, ends = {width: [] for width in counts}, {}
    for number in range(3):
        if len(ends) == len(counts):
            break
        for width, gram in _grams(x, means, factors).items():
            if width and width not in ends:
                factor, again = _factor(gram, counts[width][0], number == 0)
                if again:
                    factors[width].append(factor)
                else:
                    ends[width] = factor
    models = {}
    for width, (n, sums) in counts.items():
        r = ends.get(width, np.eye(width))
        for factor in reversed(factors[width]):
            r = r @ factor
        models[width] = Model(n, sums, r)

    def measure(width, table):
        if not width:
            return np.zeros((0, 0))
        rows = np.hstack([models[width].whitened(table), np.ones((len(table), 1))])
        return rows.T @ rows

    for width, gram in _added(x.mapInArrow(_task_sums(measure), PARTIAL), "<f8").items():
        if width:
            mean = gram[:-1, -1] / gram[-1, -1]
            spread = gram[:-1, :-1] / gram[-1, -1] - np.outer(mean, mean) - np.eye(len(mean))
            live = ~models[width].flat
            models[width].error = float(np.abs(spread[np.ix_(live, live)]).max(initial=0.0))
    return models


def whiten(vectors: DataFrame) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error; see the module's text."""
    rows = vectors.where(usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(F.col("embedding")).alias("x"))
    models = fit(materialise(rows.select("x").distinct()))

    def run(batches):
        for batch in batches:
            for places, table in _tables(batch, "x"):
                model = models.get(table.shape[1])
                if model is None:
                    continue
                count, top = len(places), len(model.variance)
                ids = batch["vec_id"].take(pa.array(np.repeat(places, top)))
                deviation = np.repeat(np.array(model.deviations(table), object), top)
                tiled = lambda values: pa.array(np.tile(values, count))
                yield pa.RecordBatch.from_arrays(
                    [ids, tiled(np.arange(1, top + 1, dtype=np.int32)), pa.array(np.full(count * top, model.n, np.int64)), pa.array(deviation, pa.int64()),
                     pa.array(model.whitened(table).ravel()), tiled(model.explained), pa.array(np.full(count * top, model.error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
