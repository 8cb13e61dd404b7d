"""Text expressions: fingerprints, token estimates, guards, labels."""

from pyspark.sql import Column, functions as F

from costlens import constants as K


def fingerprint(text: Column, digits: int = 16) -> Column:
    """Identifier of a question that does not reveal its text."""
    return F.concat(
        F.lit("sha256:"), F.substring(F.sha2(text, 256), 1, digits),
        F.lit("(len="), F.length(text).cast("string"), F.lit(")"),
    )


def request_id(key: Column) -> Column:
    return F.concat(F.lit("chatcmpl-"), F.substring(F.sha2(key.cast("string"), 256), 1, 12))


def estimated_tokens(text: Column) -> Column:
    """About four characters per token, at least one."""
    return F.greatest(F.lit(1).cast("long"), F.floor(F.length(text) / 4))


def is_blank(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, r"^\s+", "") == "", F.lit(True))


def guarded(text: Column) -> Column:
    """The clipped text a size-limited encoder accepts."""
    return F.substring(text, 1, K.GUARD_CHARS)


def model_bucket(model: Column) -> Column:
    return F.when(model.startswith("ollama"), F.lit(K.LOCAL_BUCKET)).otherwise(model)


def model_short_name(model: Column) -> Column:
    """Drop the first occurrence of each vendor prefix."""
    return F.regexp_replace(
        F.regexp_replace(model, r"^(.*?)groq/", "$1"), r"^(.*?)openai/", "$1")


def routing_reason(cache_hit: Column, fallback_used: Column, tier: Column) -> Column:
    return (
        F.when(cache_hit, F.lit("cache · cosine match"))
        .when(fallback_used, F.concat(F.lit("fallback · "), tier))
        .otherwise(F.concat(F.lit("classifier · "), tier))
    )


def reason_category(reason: Column) -> Column:
    found = F.coalesce(*[F.when(reason.contains(word), F.lit(word)) for word in ["cache", *K.TIERS]])
    return F.coalesce(found, F.lit("fallback"))


def request_path(cache_hit: Column, model: Column, fallback_used: Column) -> Column:
    served = F.concat(
        F.lit("request → classifier → "), model,
        F.when(fallback_used, F.lit(" (via Ollama fallback)")).otherwise(F.lit("")),
    )
    return F.when(cache_hit, F.lit("request → semantic cache")).otherwise(served)


def error_category(error: Column) -> Column:
    lowered = F.lower(error)
    chain = None
    for category, needles in K.ERROR_PATTERNS:
        hit = F.lit(False)
        for needle in needles:
            hit = hit | lowered.contains(needle)
        chain = F.when(hit, F.lit(category)) if chain is None else chain.when(hit, F.lit(category))
    return F.when(error.isNotNull(), chain.otherwise(F.lit("other")))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")
