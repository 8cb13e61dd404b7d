"""Running totals and exact quantiles that never sort a whole table, tier or day in one task.

A global window puts every row in one task, and a window per day or tier does the same as soon
as one of them holds most rows. Here the rows are cut into ranges of the full sort key, which
ends in a unique column, so no range can be hot. Each range is summed, the few range totals
are accumulated, and the window runs inside a range on top of what came before it.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from costlens.functions.money import dollars, from_units, units
from costlens.session import materialise

ROWS_PER_RANGE = 500_000
MAX_RANGES = 4096
_SAMPLES_PER_RANGE = 50


def with_range(df: DataFrame, keys: list[str], rows_per_range: int = ROWS_PER_RANGE) -> tuple[DataFrame, bool]:
    """Add ``_range``: 0, 1, ... in key order, a pure function of the keys; and whether there is but one.

    The cut points come from a small sample; they decide only how even the ranges are.
    """
    total = df.count()
    ranges = min(MAX_RANGES, -(-total // rows_per_range))
    if ranges <= 1:
        return df.withColumn("_range", F.lit(0)), True
    fraction = min(1.0, _SAMPLES_PER_RANGE * ranges / total)
    def nulls_first(row: tuple) -> list[tuple]:
        return [(value is not None, value) if value is not None else (False,) for value in row]

    sample = sorted((tuple(row) for row in df.select(*keys).sample(fraction, seed=7).collect()), key=nulls_first)
    cuts = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}, key=nulls_first) if sample else []
    if not cuts:
        return df.withColumn("_range", F.lit(0)), True
    bounds = F.array(*[F.struct(*[F.lit(v).cast(df.schema[k].dataType).alias(k) for k, v in zip(keys, cut)]) for cut in cuts])
    steps = [1 << bit for bit in reversed(range(len(cuts).bit_length()))]
    key = F.struct(*[F.col(k) for k in keys])

    def advance(found: Column, step: Column) -> Column:
        """Binary search: the number of cut points at or before the key."""
        ahead = found + step
        return F.when((ahead <= len(cuts)) & (F.get(bounds, ahead - 1) <= key), ahead).otherwise(found)

    return df.withColumn("_range", F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), advance)), False


def _before(totals: DataFrame, by: list[str], columns: dict[str, str], kept: tuple[str, ...] = ()) -> DataFrame:
    """Exclusive running sums over range totals: at most MAX_RANGES rows per group."""
    window = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    return totals.select(*by, "_range", *kept, *[
        F.coalesce(F.sum(source).over(window), F.lit(0)).alias(target) for source, target in columns.items()],
        F.sum("n").over(whole).alias("rows"))


def cumulative_savings(logs: DataFrame, rows_per_range: int = ROWS_PER_RANGE, points: int | None = None) -> DataFrame:
    """``id, created_at, position, rows, cumulative_savings`` in time order.

    With ``points`` only the rows that ``downsample`` keeps: the ranges' counts tell which of them hold one, and
    the rows of the others are neither moved nor ordered.
    """
    rows, single = with_range(logs.select("created_at", "id", "savings_usd"), ["created_at", "id"], rows_per_range)
    if not single:
        totals = rows.groupBy("_range").agg(F.count("*").alias("n"), F.sum(units(F.col("savings_usd"))).alias("saved"))
        # one row per range, at most MAX_RANGES of them
        before = _before(totals, [], {"n": "rows_before", "saved": "saved_before"}, ("n",))
        if points is not None:
            before = materialise(before.where(_holds_point(F.col("rows_before"), F.col("n"), F.col("rows"), points)))
            rows = rows.join(F.broadcast(before.select("_range")), "_range", "left_semi")
    inside = Window.partitionBy("_range").orderBy("created_at", "id")
    upto_row = inside.rowsBetween(Window.unboundedPreceding, 0)
    running = rows.select(
        "created_at", "id", "_range", F.row_number().over(inside).alias("_n"),
        F.coalesce(F.sum(units(F.col("savings_usd"))).over(upto_row), F.lit(0).cast("long")).alias("_saved"),
        *([F.count("*").over(Window.partitionBy("_range")).alias("rows")] if single else []))
    nothing = F.lit(0).cast("long")
    if single:
        placed = running.withColumn("rows_before", nothing).withColumn("saved_before", nothing)
    else:
        placed = running.join(F.broadcast(before.drop("n")), "_range")
    series = placed.select(
        "id", "created_at", (F.col("_n") + F.col("rows_before")).cast("long").alias("position"), "rows",
        dollars(from_units(F.col("_saved") + F.col("saved_before"))).alias("cumulative_savings"))
    return series if points is None else downsample(series, points)


def _step(points: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col("rows") / points))


def _holds_point(before: Column, n: Column, rows: Column, points: int) -> Column:
    """Whether positions ``before + 1`` to ``before + n`` hold one that ``downsample`` keeps."""
    step = _step(points)
    return (F.floor((before + n - 1) / step) > F.floor((before - 1) / step)) | (before + n == rows)


def downsample(series: DataFrame, points: int) -> DataFrame:
    """Evenly spaced points of a positioned series plus its last point."""
    step = _step(points)
    return series.where(((F.col("position") - 1) % step == 0) | (F.col("position") == F.col("rows")))


def exact_quantiles(
    df: DataFrame, by: str, value: str, quantiles: list[float], rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """``by, rows, q0, q1, ...``: linearly interpolated quantiles per group.

    Equal values are counted before anything is ordered, then the ranks wanted are looked up in
    ranges of (group, value).
    """
    return quantiles_of_counts(value_counts(df, by, value), by, value, quantiles, rows_per_range)


def value_counts(df: DataFrame, by: str, value: str) -> DataFrame:
    """``by, value, n``, written: how often every value stands in its group, nulls left out."""
    return materialise(df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n")))


def quantiles_of_counts(
    counted: DataFrame, by: str, value: str, quantiles: list[float], rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """``exact_quantiles`` of values already counted."""
    ranged, single = with_range(counted, [by, value], rows_per_range)
    inside = Window.partitionBy(by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    upto = ranged.withColumn("_upto", F.sum("n").over(inside))
    if single:
        placed = upto.withColumn("before", F.lit(0)).withColumn("rows", F.sum("n").over(Window.partitionBy(by, "_range")))
    else:
        totals = ranged.groupBy(by, "_range").agg(F.sum("n").alias("n"))
        before = _before(totals, [by], {"n": "before"}).withColumnsRenamed({by: "_by", "_range": "_in"})
        placed = upto.join(before, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_in"))).drop("_by", "_in")
    ranks = (
        placed
        .withColumn("_last", F.col("_upto") + F.col("before") - 1)
        .withColumn("_first", F.col("_last") - F.col("n") + 1)
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_first") <= rank) & (rank <= F.col("_last")), F.col(value)))

    low = [F.floor((F.col("rows") - 1) * q) for q in quantiles]
    high = [F.ceil((F.col("rows") - 1) * q) for q in quantiles]
    ends = [e for i in range(len(quantiles)) for e in (at(low[i]).alias(f"_lo{i}"), at(high[i]).alias(f"_hi{i}"))]
    found = ranks.groupBy(by, "rows").agg(*ends)
    out = []
    for i, q in enumerate(quantiles):
        part = (F.col("rows") - 1) * F.lit(q)
        share = part - F.floor(part)
        out.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * share).alias(f"q{i}"))
    return found.select(by, "rows", *out)
