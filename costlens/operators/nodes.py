"""Figures of the request-flow nodes."""

from pyspark.sql import DataFrame, functions as F

from costlens import constants as K
from costlens.functions import text
from costlens.operators.reports import kpi_totals, model_distribution
from costlens.session import fixed_table


def _nodes(spark) -> DataFrame:
    """Seven fixed rows."""
    rows = [(i, node, model) for i, (node, model) in enumerate(K.ROUTE_NODES)]
    return fixed_table(spark, rows, "place int, node string, model string")


def node_metrics(logs: DataFrame) -> DataFrame:
    """Share of traffic each node saw, by exact model bucket."""
    shares = model_distribution(logs).select("model", "pct")
    hit_rate = kpi_totals(logs).select("cache_hit_rate").scalar()
    share = (
        F.when(F.col("node") == "request", F.lit(100.0))
        .when(F.col("node") == "cache", hit_rate)
        .when(F.col("node") == "classify", 100 - hit_rate)
        .otherwise(F.coalesce("pct", F.lit(0.0)))
    )
    return _nodes(logs.sparkSession).join(shares, "model", "left").select(
        F.col("place").cast("long").alias("place"), "node", F.round(share, 2).alias("share_pct"))


def last_request_nodes(logs: DataFrame) -> DataFrame:
    """Which nodes the newest request touched."""
    newest = F.max_by(F.struct("cache_hit", "model_used"), F.struct("created_at", "id"))
    latest = logs.agg(newest).scalar()
    bucket = text.model_bucket(latest["model_used"])
    hit = F.coalesce(latest["cache_hit"], F.lit(False))
    touched = (
        F.when(F.col("node") == "request", F.lit(True))
        .when(F.col("node") == "cache", hit)
        .when(F.col("node") == "classify", latest.isNotNull() & ~hit)
        .otherwise(F.coalesce(F.col("model") == bucket, F.lit(False)))
    )
    return _nodes(logs.sparkSession).select(
        F.col("place").cast("long").alias("place"), "node", touched.alias("active"))
