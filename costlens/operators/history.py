"""Request history: filters, pages, counts."""

from pyspark.sql import Column, DataFrame, functions as F

from costlens import constants as K


def filtered(
    logs: DataFrame, *, since: Column | None = None, tier: str | None = None,
    cache_hits_only: bool = False, fallback_only: bool = False,
) -> DataFrame:
    if since is not None:
        logs = logs.where(F.col("created_at") >= since)
    if tier:
        logs = logs.where(F.col("tier") == tier)
    if cache_hits_only:
        logs = logs.where("cache_hit")
    if fallback_only:
        logs = logs.where("fallback_used")
    return logs


def count(logs: DataFrame) -> DataFrame:
    return logs.agg(F.count("*").alias("total"))


def projection(logs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns a page may show; no text of a request is among them."""
    columns = [F.coalesce(c, F.lit("")).alias(c) if c == "routing_reason" else F.col(c) for c in K.HISTORY_COLUMNS]
    return logs.select(*(keep or []), *columns)


def order(sort_by: str = "created_at", direction: str = "desc") -> list[Column]:
    """Sort columns with the row id as tie-break; an unlisted column falls back to the time."""
    name = sort_by if sort_by in K.HISTORY_SORTS else "created_at"
    turn = F.desc if direction == "desc" else F.asc
    return [turn(name), turn("id")]


def page(
    logs: DataFrame, number: int = 1, size: int = K.PAGE_SIZE, sort_by: str = "created_at", direction: str = "desc",
) -> DataFrame:
    """One page plus the total on each row; only ``number * size`` rows per task are kept."""
    start = (max(1, number) - 1) * size
    rows = projection(logs, ["id"]).orderBy(*order(sort_by, direction)).offset(start).limit(size)
    return rows.withColumn("total", count(logs).scalar())


def page_after(
    logs: DataFrame, created_at: Column, row_id: Column, size: int = K.PAGE_SIZE,
) -> DataFrame:
    """The page behind a known row, newest first: cost does not grow with the page number."""
    older = (F.col("created_at") < created_at) | ((F.col("created_at") == created_at) & (F.col("id") < row_id))
    return projection(logs.where(older), ["id"]).orderBy(*order()).limit(size)


def page_count(logs: DataFrame, size: int = K.PAGE_SIZE) -> DataFrame:
    return count(logs).select(F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long").alias("pages"))


def recent(logs: DataFrame, rows: int = K.RECENT_ROWS) -> DataFrame:
    return logs.select("id", *K.RECENT_COLUMNS).orderBy(*order()).limit(rows)
