"""Pricing of requests against the rate card and the premium baseline."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from costlens import constants as K
from costlens.session import fixed_table

_CARD_SCHEMA = "tier string, provider string, model string, input_rate double, output_rate double, max_tokens long"


def rate_card(spark: SparkSession, provider: str | None = None) -> DataFrame:
    """Six fixed rows (three per provider), so a broadcast of it has a constant size."""
    card = fixed_table(spark, K.RATE_CARD, _CARD_SCHEMA)
    return card if provider is None else card.where(F.col("provider") == provider).drop("provider")


def quota_table(spark: SparkSession) -> DataFrame:
    return fixed_table(spark, K.QUOTAS, "model string, rpm long, tpm long, rpd long")


def token_cost(input_tokens: Column, output_tokens: Column, input_rate: Column, output_rate: Column) -> Column:
    return F.round(input_tokens / 1000 * input_rate + output_tokens / 1000 * output_rate, 8)


def baseline_cost(input_tokens: Column, output_tokens: Column) -> Column:
    return token_cost(input_tokens, output_tokens, F.lit(K.BASELINE_INPUT_RATE), F.lit(K.BASELINE_OUTPUT_RATE))


def with_rates(df: DataFrame) -> DataFrame:
    """Primary rates beside each row; rows without a known tier keep null rates."""
    rates = rate_card(df.sparkSession, "primary").select("tier", "input_rate", "output_rate")
    return df.join(F.broadcast(rates), "tier", "left")


def with_costs(df: DataFrame, strict: bool = False) -> DataFrame:
    """Add the five cost columns from ``tier, input_tokens, output_tokens, cache_hit``.

    A cache hit ran no inference: it costs nothing and saves the whole baseline, whatever its
    tier. Otherwise the tier must be on the card: with ``strict`` a stray tier fails the job,
    else its costs stay null (see ``invalid_tiers``).
    """
    hit = F.col("cache_hit")
    known = F.col("input_rate").isNotNull()
    theoretical = token_cost(F.col("input_tokens"), F.col("output_tokens"), F.col("input_rate"), F.col("output_rate"))
    if strict:
        theoretical = F.when(known, theoretical).otherwise(
            F.raise_error(F.concat(F.lit("tier not on the rate card: "), F.col("tier"))).cast("double"))
    return (
        with_rates(df)
        .withColumn("actual_cost_usd", F.lit(0.0))
        .withColumn("theoretical_cost_usd", F.when(hit, F.lit(0.0)).otherwise(theoretical))
        .withColumn("baseline_cost_usd", baseline_cost(F.col("input_tokens"), F.col("output_tokens")))
        .withColumn("savings_usd", F.col("baseline_cost_usd") - F.col("theoretical_cost_usd"))
        .withColumn("savings_source", F.when(hit, F.lit("cache")).otherwise(F.lit("routing")))
        .drop("input_rate", "output_rate")
    )


def invalid_tiers(df: DataFrame) -> DataFrame:
    """Rows that cannot be priced: not a cache hit and not on the rate card."""
    card = rate_card(df.sparkSession, "primary").select("tier")
    return df.where(~F.col("cache_hit")).join(F.broadcast(card), "tier", "left_anti")
