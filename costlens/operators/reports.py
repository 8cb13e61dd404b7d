"""Report figures over the request log. Every aggregate combines on the map side and groups by
a small dimension (tier, model, hour), so one hot value costs no more than the others."""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from costlens import constants as K
from costlens.functions import display, text
from costlens.functions.money import dollars, exact_sum, percent, ratio
from costlens.functions.pricing import quota_table, rate_card
from costlens.operators.ordering import ROWS_PER_RANGE, cumulative_savings, downsample, exact_quantiles, quantiles_of_counts, value_counts
from costlens.session import fixed_table, materialise


# ---- time ranges -------------------------------------------------------------------------

def range_start(range_key: str | None, as_of: Column | None = None) -> Column | None:
    """Inclusive lower bound of a named range; ``None`` means all rows."""
    now = F.current_timestamp() if as_of is None else as_of
    bounds = {
        "today": F.date_trunc("day", now),
        "7d": now - F.expr("INTERVAL 7 DAYS"),
        "30d": now - F.expr("INTERVAL 30 DAYS"),
    }
    return bounds.get(range_key)


def in_range(logs: DataFrame, range_key: str | None, as_of: Column | None = None) -> DataFrame:
    start = range_start(range_key, as_of)
    return logs if start is None else logs.where(F.col("created_at") >= start)


# ---- totals ------------------------------------------------------------------------------

SUMS = ["requests", "_savings", "_baseline", "_hits", "_fallbacks"]


def _totals() -> list[Column]:
    return [
        F.count("*").alias("requests"),
        exact_sum(F.col("savings_usd")).alias("_savings"),
        exact_sum(F.col("baseline_cost_usd")).alias("_baseline"),
        F.count_if("cache_hit").alias("_hits"),
        F.count_if("fallback_used").alias("_fallbacks"),
    ]


def _kpi_columns() -> list[Column]:
    return [
        F.col("requests"),
        dollars(F.col("_savings")).alias("savings_usd"),
        dollars(F.col("_baseline")).alias("baseline_usd"),
        percent(F.col("_savings"), F.col("_baseline"), 2).alias("savings_pct"),
        percent(F.col("_hits"), F.col("requests"), 2).alias("cache_hit_rate"),
        percent(F.col("_fallbacks"), F.col("requests"), 2).alias("fallback_rate"),
        F.lit(0.0).alias("actual_spend"),
    ]


def kpi_totals(logs: DataFrame) -> DataFrame:
    """One row, zeros over an empty log."""
    return logs.agg(*_totals()).select(*_kpi_columns())


def kpi_cube(logs: DataFrame) -> DataFrame:
    """The same figures for every combination of tier and model bucket; null means all.

    The log is added up once per combination; the cube is taken over those few rows.
    """
    cells = logs.groupBy("tier", text.model_bucket(F.col("model_used")).alias("model")).agg(*_totals())
    sums = cells.cube("tier", "model").agg(*[F.sum(c).alias(c) for c in SUMS])
    return sums.select("tier", "model", *_kpi_columns())


def cache_hit_miss(logs: DataFrame) -> DataFrame:
    return logs.agg(F.count_if("cache_hit").alias("hit"), F.count_if(~F.col("cache_hit")).alias("miss"))


# ---- distributions -----------------------------------------------------------------------

def tier_distribution(logs: DataFrame) -> DataFrame:
    return logs.groupBy("tier").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "tier")


def known_models(spark: SparkSession) -> DataFrame:
    """Four fixed rows in display order."""
    return fixed_table(spark, list(enumerate(K.KNOWN_MODELS)), "place int, model string")


def served_models(logs: DataFrame, bucket: bool = True) -> DataFrame:
    """Request count per model that answered; cache hits have no model."""
    model = text.model_bucket(F.col("model_used")) if bucket else F.col("model_used")
    return logs.where(~F.col("cache_hit")).groupBy(model.alias("model")).agg(F.count("*").alias("count"))


def _spine(counts: DataFrame) -> DataFrame:
    """One row with ``line``: the models of the report in display order, each with its count."""
    joined = (
        known_models(counts.sparkSession)
        .join(counts, "model", "full_outer")
        .select(F.coalesce("place", F.lit(len(K.KNOWN_MODELS))).alias("place"), "model",
                F.coalesce("count", F.lit(0).cast("long")).alias("count"))
    )
    # a row per model name
    return joined.agg(F.sort_array(F.collect_list(F.struct("place", "model", "count"))).alias("line"))


def model_spine(logs: DataFrame) -> DataFrame:
    """``position, model, count``: known models first, then unknown ones A to Z."""
    return _spine(served_models(logs)).select(F.posexplode("line").alias("position", "m")).select(
        F.col("position").cast("long").alias("position"), "m.model", "m.count")


def distribution_of(counts: DataFrame) -> DataFrame:
    """The spine with each model's share of all counted requests."""
    total = F.aggregate("line", F.lit(0).cast("long"), lambda s, m: s + m["count"])
    return _spine(counts).select(F.posexplode("line").alias("position", "m"), total.alias("_total")).select(
        F.col("position").cast("long").alias("position"), "m.model", "m.count",
        percent(F.col("m.count"), F.col("_total"), 1).alias("pct"))


def model_distribution(logs: DataFrame) -> DataFrame:
    return distribution_of(served_models(logs))


def bar_scale(logs: DataFrame) -> DataFrame:
    """Bar length of each model against the longest bar."""
    longest = F.greatest(F.lit(1), F.array_max(F.transform("line", lambda m: m["count"])))
    return _spine(served_models(logs)).select(F.posexplode("line").alias("position", "m"), longest.alias("_longest")).select(
        F.col("position").cast("long").alias("position"), "m.model", "m.count",
        F.round(F.col("m.count") / F.col("_longest") * 100, 4).alias("bar_pct"))


def model_universe(logs: DataFrame) -> DataFrame:
    known = known_models(logs.sparkSession).select("model")
    return known.union(served_models(logs).select("model")).distinct()


def unknown_models(logs: DataFrame, bucket: bool = True) -> DataFrame:
    return served_models(logs, bucket).select("model").subtract(known_models(logs.sparkSession).select("model"))


def cost_by_model(logs: DataFrame) -> DataFrame:
    """Theoretical cost per answering model and its share of the routed requests."""
    per_model = (
        logs.where(~F.col("cache_hit"))
        .groupBy(text.model_bucket(F.col("model_used")).alias("model"))
        .agg(F.count("*").alias("requests"), exact_sum(F.col("theoretical_cost_usd")).alias("_cost"))
    )
    # the window spans one row per model
    total = F.sum("requests").over(Window.partitionBy())
    return per_model.select(
        "model", "requests", dollars(F.col("_cost")).alias("theoretical_cost_usd"),
        percent(F.col("requests"), total, 1).alias("routing_pct"))


def rate_card_usage(logs: DataFrame) -> DataFrame:
    """Every rate-card line with the traffic billed against it."""
    served = logs.where(~F.col("cache_hit")).groupBy(F.col("model_used").alias("model")).agg(
        F.count("*").alias("requests"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"))
    zero = F.lit(0).cast("long")
    return rate_card(logs.sparkSession).join(served, "model", "left").select(
        "tier", "provider", "model", "input_rate", "output_rate", "max_tokens",
        *[F.coalesce(c, zero).alias(c) for c in ("requests", "input_tokens", "output_tokens")])


# ---- savings -----------------------------------------------------------------------------

def _from_source(source: str) -> Column:
    return exact_sum(F.when(F.col("savings_source") == source, F.col("savings_usd")))


def _split(cache: Column, routing: Column) -> list[Column]:
    total = cache + routing
    return [
        dollars(cache).alias("cache_usd"), dollars(routing).alias("routing_usd"),
        percent(cache, total, 1).alias("cache_pct"), percent(routing, total, 1).alias("routing_pct"),
    ]


def savings_split(logs: DataFrame) -> DataFrame:
    """Savings by declared source."""
    sums = logs.agg(_from_source("cache").alias("c"), _from_source("routing").alias("r"))
    return sums.select(*_split(F.col("c"), F.col("r")))


def savings_split_residual(logs: DataFrame) -> DataFrame:
    """Routing is whatever the cache did not save."""
    sums = logs.agg(_from_source("cache").alias("c"), exact_sum(F.col("savings_usd")).alias("t"))
    return sums.select(*_split(F.col("c"), F.col("t") - F.col("c")))


def savings_by_period(logs: DataFrame, unit: str = "hour") -> DataFrame:
    period = F.date_trunc(unit, F.col("created_at"))
    return logs.groupBy(period.alias("_period")).agg(
        F.count("*").alias("requests"), exact_sum(F.col("savings_usd")).alias("_saved"),
    ).select(text.iso(F.col("_period")).alias("period"), "requests", dollars(F.col("_saved")).alias("savings_usd"))


def savings_today(logs: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Today's running savings, hour by hour; the last row is today's total."""
    hourly = in_range(logs, "today", as_of).groupBy(F.date_trunc("hour", "created_at").alias("_hour")).agg(
        F.count("*").alias("requests"), exact_sum(F.col("savings_usd")).alias("_saved"))
    # at most 24 rows are left
    upto = F.sum("_saved").over(Window.partitionBy(F.to_date("_hour")).orderBy("_hour"))
    return hourly.select(
        text.iso(F.col("_hour")).alias("hour"), "requests",
        dollars(F.col("_saved")).alias("savings_usd"), dollars(upto).alias("running_savings_usd"))


def savings_series(logs: DataFrame, points: int = K.MAX_SERIES_POINTS, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    return cumulative_savings(logs, rows_per_range, points)


def sparkline(series: DataFrame) -> DataFrame:
    """Points of a bounded series scaled to the drawing area; y grows downwards.

    The scale starts at zero or below and ends just above zero or higher, so a flat series
    still has a height.
    """
    extent = series.agg(
        F.greatest(F.max("cumulative_savings"), F.lit(0.000001)).alias("_top"),
        F.least(F.min("cumulative_savings"), F.lit(0.0)).alias("_bottom"),
        F.sort_array(F.collect_list(F.struct("position", "cumulative_savings"))).alias("_points"))
    last = F.size("_points") - 1
    height = F.col("_top") - F.col("_bottom")
    height = F.when(height == 0, 1.0).otherwise(height)
    return extent.where(last >= 1).select(
        F.posexplode("_points").alias("_i", "_p"), last.alias("_last"), "_bottom", height.alias("_height"),
    ).select(
        F.col("_p.position").alias("position"),
        F.round(F.col("_i") / F.col("_last") * K.SPARK_WIDTH).cast("long").alias("x"),
        F.round(K.SPARK_HEIGHT - (F.col("_p.cumulative_savings") - F.col("_bottom")) / F.col("_height") * K.SPARK_HEIGHT)
        .cast("long").alias("y"),
    )


# ---- latency -----------------------------------------------------------------------------

def latency_percentiles(logs: DataFrame, quantiles: dict[str, float], rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    exact = exact_quantiles(logs, "tier", "latency_ms", list(quantiles.values()), rows_per_range)
    return exact.select("tier", F.col("rows").alias("count"),
                        *[F.round(f"q{i}", 1).alias(name) for i, name in enumerate(quantiles)])


def latency_percentiles_approx(logs: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """One pass with a mergeable sketch; the rank error is at most 1/accuracy."""
    sketch = F.percentile_approx("latency_ms", F.array(F.lit(0.5), F.lit(0.95)), F.lit(accuracy))
    return logs.groupBy("tier").agg(sketch.alias("q"), F.count("*").alias("count")).select(
        "tier", F.round(F.col("q")[0], 1).alias("p50"), F.round(F.col("q")[1], 1).alias("p95"), "count")


MOST_FENCES = 10_000  # groups whose fences may be broadcast


def _fences(counted: DataFrame) -> DataFrame:
    """One row per tier, null included, its name in ``_tier``; broadcast while they are few."""
    quartiles = quantiles_of_counts(counted, "tier", "latency_ms", [0.25, 0.5, 0.75])
    spread = (F.col("q2") - F.col("q0")) * 1.5
    fences = materialise(quartiles.select(F.col("tier").alias("_tier"), "q0", "q1", "q2", (F.col("q0") - spread).alias("low"), (F.col("q2") + spread).alias("high")))
    return F.broadcast(fences) if fences.count() <= MOST_FENCES else fences


def latency_box(logs: DataFrame) -> DataFrame:
    """Quartiles, whisker ends and outlier count per tier, all from one count of the values of each tier."""
    counted = value_counts(logs, "tier", "latency_ms")
    inside = F.col("latency_ms").between(F.col("low"), F.col("high"))
    return (
        counted.join(_fences(counted), F.col("tier").eqNullSafe(F.col("_tier")))
        .groupBy("tier", "q0", "q1", "q2").agg(
            F.min(F.when(inside, F.col("latency_ms"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("latency_ms"))).alias("whisker_high"),
            F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("outliers"))
        .select("tier", *[F.round(q, 4).alias(n) for q, n in (("q0", "q1"), ("q1", "median"), ("q2", "q3"))],
                "whisker_low", "whisker_high", "outliers")
    )


def latency_outliers(logs: DataFrame) -> DataFrame:
    """The rows beyond the whiskers."""
    joined = logs.join(_fences(value_counts(logs, "tier", "latency_ms")), F.col("tier").eqNullSafe(F.col("_tier")))
    return joined.where(~F.col("latency_ms").between(F.col("low"), F.col("high"))).select("id", "tier", "latency_ms")


# ---- quota, quality, display -------------------------------------------------------------

def quota_utilisation(logs: DataFrame) -> DataFrame:
    """Busiest minute and day of each limited model against its quota."""
    quotas = quota_table(logs.sparkSession)
    used = logs.where(~F.col("cache_hit")).join(F.broadcast(quotas.select("model")), F.col("model_used") == F.col("model"))
    minutes = used.groupBy("model", F.window("created_at", "1 minute").alias("w")).agg(
        F.count("*").alias("requests"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))
    per_day = minutes.groupBy("model", F.to_date("w.start").alias("day")).agg(
        F.max("requests").alias("peak_rpm"), F.max("tokens").alias("peak_tpm"), F.sum("requests").alias("requests"))
    return per_day.join(F.broadcast(quotas), "model").select(
        "model", F.col("day").cast("string").alias("day"), "requests", "peak_rpm", "peak_tpm",
        percent(F.col("peak_rpm"), F.col("rpm"), 4).alias("rpm_pct"),
        percent(F.col("peak_tpm"), F.col("tpm"), 4).alias("tpm_pct"),
        percent(F.col("requests"), F.col("rpd"), 4).alias("rpd_pct"),
        ((F.col("peak_rpm") > F.col("rpm")) | (F.col("peak_tpm") > F.col("tpm")) | (F.col("requests") > F.col("rpd")))
        .alias("over_quota"))


def quota_minutes(logs: DataFrame) -> DataFrame:
    """Requests and tokens of every model minute."""
    return logs.where(~F.col("cache_hit")).groupBy(
        F.col("model_used").alias("model"), F.window("created_at", "1 minute").alias("w"),
    ).agg(F.count("*").alias("requests"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens")).select(
        "model", text.iso(F.col("w.start")).alias("minute"), "requests", "tokens")


def quality_equivalence(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("tier").agg(F.count("*").alias("judged"), F.count_if("equivalent").alias("equal")).select(
        "tier", "judged", "equal", percent(F.col("equal"), F.col("judged"), 2).alias("equivalence_pct"))


def report_lines(logs: DataFrame, as_of: Column) -> DataFrame:
    """Each request with its figures as display text."""
    return logs.select(
        "id",
        display.money(F.col("savings_usd")).alias("savings"),
        display.percent_text(ratio(F.col("savings_usd"), F.col("baseline_cost_usd")) * 100).alias("savings_pct"),
        display.thousands(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"),
        display.clock(F.col("created_at")).alias("clock"),
        display.relative_age(F.col("created_at"), as_of).alias("age"),
    )
