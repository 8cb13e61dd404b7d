"""Explicit schemas; nothing in the library is inferred from files."""

from pyspark.sql import types as T

REQUEST_LOG = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("request_id", T.StringType()),
    T.StructField("query_id", T.StringType()),
    T.StructField("tier", T.StringType()),
    T.StructField("model_used", T.StringType()),
    T.StructField("cache_hit", T.BooleanType()),
    T.StructField("fallback_used", T.BooleanType()),
    T.StructField("routing_reason", T.StringType()),
    T.StructField("classifier_confidence", T.DoubleType()),
    T.StructField("latency_ms", T.DoubleType()),
    T.StructField("input_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()),
    T.StructField("actual_cost_usd", T.DoubleType()),
    T.StructField("theoretical_cost_usd", T.DoubleType()),
    T.StructField("baseline_cost_usd", T.DoubleType()),
    T.StructField("savings_usd", T.DoubleType()),
    T.StructField("savings_source", T.StringType()),
])

# Defaults of columns that older rows may lack.
REQUEST_LOG_DEFAULTS = {
    "cache_hit": False,
    "fallback_used": False,
    "routing_reason": "",
    "classifier_confidence": 0.0,
    "input_tokens": 0,
    "output_tokens": 0,
    "actual_cost_usd": 0.0,
    "theoretical_cost_usd": 0.0,
    "baseline_cost_usd": 0.0,
    "savings_usd": 0.0,
    "savings_source": "routing",
}

# One pushed event per logged row.
LIVE_EVENT = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("query_id", T.StringType()),
    T.StructField("tier", T.StringType()),
    T.StructField("model_used", T.StringType()),
    T.StructField("cache_hit", T.BooleanType()),
    T.StructField("fallback_used", T.BooleanType()),
    T.StructField("latency_ms", T.DoubleType()),
    T.StructField("input_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()),
    T.StructField("actual_cost_usd", T.DoubleType()),
    T.StructField("theoretical_cost_usd", T.DoubleType()),
    T.StructField("baseline_cost_usd", T.DoubleType()),
    T.StructField("savings_usd", T.DoubleType()),
    T.StructField("savings_source", T.StringType()),
    T.StructField("routing_reason", T.StringType()),
    T.StructField("classifier_confidence", T.DoubleType()),
    T.StructField("timestamp", T.StringType()),
])

EVAL_ROW = T.StructType([
    T.StructField("query", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("_corrupt_record", T.StringType()),
])
