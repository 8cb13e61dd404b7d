"""The semantic cache: lookups, expiry, replay of a whole log, threshold sweep."""

from pyspark.sql import DataFrame, functions as F

from costlens import constants as K
from costlens.functions.money import percent
from costlens.operators import replay as replay_of
from costlens.operators.similarity import BLOCK_ROWS, MAX_BROADCAST_ROWS, attach_best, similar_alive


def answerable(entries: DataFrame) -> DataFrame:
    """Entries without an answer can neither be served nor hide others."""
    return entries.where(F.coalesce(F.length("response"), F.lit(0)) > 0)


def lookup(
    queries: DataFrame, entries: DataFrame, threshold: float = K.CACHE_THRESHOLD,
    ttl_seconds: int | None = None, block_rows: int = BLOCK_ROWS, max_broadcast_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Every query with ``hit`` and, on a hit, ``cache_id, score, response`` of the best entry."""
    found = attach_best(queries, answerable(entries), ["response"], threshold, ttl_seconds, block_rows, max_broadcast_rows)
    return found.withColumn("hit", F.col("cache_id").isNotNull())


def threshold_sweep(queries: DataFrame, entries: DataFrame, thresholds: list[float]) -> DataFrame:
    """Hit rate and wrong-answer rate per threshold; ``label`` is the tier a right answer has.

    The best entry at the lowest threshold is also the best at every higher one it reaches.
    """
    best = attach_best(queries, answerable(entries), ["tier"], min(thresholds))
    parts = F.array(*[
        F.struct(F.lit(t).alias("threshold"),
                 F.count_if(F.col("score") >= t).alias("hits"),
                 F.count_if((F.col("score") >= t) & (F.col("tier") != F.col("label"))).alias("wrong"))
        for t in thresholds])
    return best.agg(F.count("*").alias("queries"), parts.alias("p")).select("queries", F.explode("p").alias("p")).select(
        "p.threshold", "queries", "p.hits", "p.wrong",
        percent(F.col("p.hits"), F.col("queries"), 4).alias("hit_rate"),
        percent(F.col("p.wrong"), F.col("p.hits"), 4).alias("false_positive_rate"))


# ---- replay ------------------------------------------------------------------------------

def replay(
    requests: DataFrame, ttl_seconds: int = K.CACHE_TTL_SECONDS, stored: DataFrame | None = None,
    slab_seconds: int | None = None, block_rows: int = BLOCK_ROWS, max_broadcast_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """See ``costlens.operators.replay``. ``slab_seconds`` has no effect: all times are worked on together."""
    return replay_of.replay(requests, ttl_seconds, stored, block_rows=block_rows, max_broadcast_rows=max_broadcast_rows)


def replay_answers(requests: DataFrame, decisions: DataFrame, ttl_seconds: int = K.CACHE_TTL_SECONDS) -> DataFrame:
    """The stored request whose answer each hit was served: ``query_id, cache_id, score``."""
    span = ttl_seconds * 1_000_000
    start = F.unix_micros("asked_at")
    keyed = requests.join(decisions.select("request_id", "hit", "stored"), "request_id")
    return similar_alive(
        keyed.where("hit").select(F.col("request_id").alias("query_id"), "embedding", start.alias("at")),
        keyed.where("stored").select(F.col("request_id").alias("cache_id"), "embedding", start.alias("start"),
                                     (start + span).alias("until")),
        span, earlier_only=True)
