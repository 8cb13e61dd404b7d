"""Figures over chat messages ``(conv_id, turn, role, text)``; a long conversation is combined
on the map side, its messages are never gathered."""

from pyspark.sql import Column, DataFrame, functions as F

from costlens import constants as K
from costlens.functions import pricing, text


def _newest(role: str) -> Column:
    """The newest text of a role, from the columns ``_spoken`` adds."""
    return F.coalesce(F.max_by(f"_{role}_text", f"_{role}_turn"), F.lit(""))


def _spoken(messages: DataFrame, *roles: str) -> DataFrame:
    """Turn and text only where the role matters, so that sorting by conversation carries no other text."""
    columns = [
        F.when(F.col("role") == role, F.col(name)).alias(f"_{role}_{name}") for role in roles for name in ("turn", "text")]
    return messages.select("conv_id", F.length("text").alias("_chars"), *columns)


def last_user_message(messages: DataFrame) -> DataFrame:
    """The newest user text per conversation, empty if there is none."""
    return _spoken(messages, "user").groupBy("conv_id").agg(_newest("user").alias("question"))


def exchanges(messages: DataFrame) -> DataFrame:
    """Last question, last answer and both token estimates per conversation, in one pass."""
    per_message = F.greatest(F.lit(1).cast("long"), F.floor(F.col("_chars") / 4))
    joined = F.sum("_chars") + F.count("_chars") - 1
    return _spoken(messages, "user", "assistant").groupBy("conv_id").agg(
        _newest("user").alias("question"), _newest("assistant").alias("answer"),
        F.sum(per_message).alias("estimated_tokens"), F.floor(joined / 4).alias("joined_tokens"))


def token_estimate(messages: DataFrame) -> DataFrame:
    """Every message counts at least one token."""
    return messages.groupBy("conv_id").agg(F.sum(text.estimated_tokens(F.col("text"))).alias("estimated_tokens"))


def token_estimate_joined(messages: DataFrame) -> DataFrame:
    """As if the texts were joined by single spaces; may be zero."""
    joined = F.sum(F.length("text")) + F.count("text") - 1
    return messages.groupBy("conv_id").agg(F.floor(joined / 4).alias("estimated_tokens"))


def usage_or_estimate(calls: DataFrame) -> DataFrame:
    """Reported counts where there is a usage record (a null count is zero), else the estimates."""
    def pick(reported: str, estimate: str) -> Column:
        return F.when(F.col("usage").isNotNull(), F.coalesce(F.col(f"usage.{reported}"), F.lit(0).cast("long"))) \
            .otherwise(F.col(estimate)).cast("long")

    return calls.withColumn("input_tokens", pick("prompt_tokens", "estimated_input")) \
        .withColumn("output_tokens", pick("completion_tokens", "estimated_output"))


def validate(requests: DataFrame) -> DataFrame:
    """Add ``problems``: why a request cannot be accepted; empty for a good one.

    Expects ``roles array<string>, temperature, max_tokens, stream``.
    """
    allowed = F.array(*[F.lit(r) for r in ("system", "user", "assistant")])
    checks = [
        (F.size(F.array_except("roles", allowed)) > 0, "role"),
        (~F.col("temperature").between(0.0, 2.0), "temperature"),
        (F.col("max_tokens") < 1, "max_tokens"),
        (F.col("stream"), "stream"),
    ]
    return requests.withColumn(
        "problems", F.array_compact(F.array(*[F.when(bad, F.lit(name)) for bad, name in checks])))


def effective_settings(requests: DataFrame) -> DataFrame:
    """Unset or zero settings take the default temperature and the tier's output cap."""
    caps = pricing.rate_card(requests.sparkSession, "primary").select("tier", F.col("max_tokens").alias("_cap"))
    return (
        requests.join(F.broadcast(caps), "tier")
        .withColumn("temperature", F.coalesce(F.nullif("temperature", F.lit(0.0)), F.lit(K.DEFAULT_TEMPERATURE)))
        .withColumn("max_tokens", F.coalesce(F.nullif("max_tokens", F.lit(0).cast("long")), "_cap"))
        .drop("_cap")
    )


def guard(questions: DataFrame) -> DataFrame:
    """Blank questions get the default tier at zero confidence; others their encoder text."""
    blank = text.is_blank(F.col("question"))
    return questions.select(
        "conv_id",
        F.when(blank, F.lit(K.DEFAULT_TIER)).alias("preset_tier"),
        F.when(blank, F.lit(0.0)).alias("preset_confidence"),
        F.when(~blank, text.guarded(F.col("question"))).alias("encoder_text"),
    )
