"""The whole report as one nested row."""

from pyspark.sql import Column, DataFrame, functions as F

from costlens.functions import text
from costlens.functions.money import dollars, exact_sum, percent
from costlens.operators import reports
from costlens.session import materialise


def summary(logs: DataFrame) -> DataFrame:
    """Counts and sums per combination of the report's dimensions: a few dozen rows."""
    return logs.groupBy(
        "tier", text.model_bucket(F.col("model_used")).alias("model"), "cache_hit", "fallback_used", "savings_source",
    ).agg(F.count("*").alias("n"), exact_sum(F.col("savings_usd")).alias("savings"), exact_sum(F.col("baseline_cost_usd")).alias("baseline"))


def _rows(when: Column | None = None) -> Column:
    return F.coalesce(F.sum("n" if when is None else F.when(when, F.col("n"))), F.lit(0).cast("long"))


def _money(name: str, when: Column | None = None) -> Column:
    return exact_sum(F.col(name) if when is None else F.when(when, F.col(name)))


def stats_snapshot(logs: DataFrame) -> DataFrame:
    """All counts and sums come from one pass; latency and the time series each need their own.

    Every part is a handful of rows (tiers, models, at most 201 points) before it is nested.
    """
    parts = materialise(summary(logs))

    def listed(part: DataFrame, sort: list[Column]) -> Column:
        line = F.sort_array(F.collect_list(F.struct(F.struct(*sort).alias("k"), F.struct(*part.columns).alias("v"))))
        return part.agg(F.transform(line, lambda r: r["v"])).scalar()

    totals = parts.agg(
        _rows().alias("requests"), _money("savings").alias("s"), _money("baseline").alias("b"),
        _rows(F.col("cache_hit")).alias("hit"), _rows(F.col("fallback_used")).alias("fell"),
        _money("savings", F.col("savings_source") == "cache").alias("c"),
        _money("savings", F.col("savings_source") == "routing").alias("r"))
    split = F.col("c") + F.col("r")
    tiers = parts.groupBy("tier").agg(F.sum("n").alias("count"))
    models = reports.distribution_of(
        parts.where(~F.col("cache_hit")).groupBy("model").agg(F.sum("n").alias("count")))
    latency = reports.latency_percentiles(logs, {"p50": 0.5, "p95": 0.95}).select("tier", "p50", "p95", "count")
    series = reports.savings_series(logs).select("position", text.iso(F.col("created_at")).alias("timestamp"), "cumulative_savings")
    return totals.select(
        F.struct(
            "requests", dollars(F.col("s")).alias("savings_usd"), dollars(F.col("b")).alias("baseline_usd"),
            percent(F.col("s"), F.col("b"), 2).alias("savings_pct"),
            percent(F.col("hit"), F.col("requests"), 2).alias("cache_hit_rate"),
            percent(F.col("fell"), F.col("requests"), 2).alias("fallback_rate"),
            F.lit(0.0).alias("actual_spend")).alias("totals"),
        listed(tiers, [-F.col("count"), F.col("tier")]).alias("tier_distribution"),
        listed(latency, [F.col("tier")]).alias("latency_percentiles"),
        listed(series, [F.col("position")]).alias("cumulative_savings"),
        F.struct("hit", (F.col("requests") - F.col("hit")).alias("miss")).alias("cache_hit_vs_miss"),
        listed(models, [F.col("position")]).alias("model_distribution"),
        F.struct(
            dollars(F.col("c")).alias("cache_usd"), dollars(F.col("r")).alias("routing_usd"),
            percent(F.col("c"), split, 1).alias("cache_pct"), percent(F.col("r"), split, 1).alias("routing_pct"),
        ).alias("savings_split"),
    )
