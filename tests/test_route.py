"""Batch routing: what a request is billed by."""

from pyspark.sql import functions as F

from costlens.plans import route

REQUESTS = ("id long, created_at timestamp_ntz, question string, answer string, estimated_tokens long, joined_tokens long, "
            "embedding array<double>, latency_ms double")
CALLS = "request_id string, attempt_no int, provider string, tier string, error_text string"


def routed(spark, requests):
    calls = spark.createDataFrame([], CALLS)
    examples = spark.createDataFrame([("a", "simple", [1.0, 0.0, 0.0])], "exemplar_id string, tier string, embedding array<double>")
    return {r["id"]: r for r in route.route_batch(requests, calls, examples).collect()}


def requests(spark):
    import datetime as dt

    def row(number, answer, vector):
        return number, dt.datetime(2024, 1, 1, 0, number), f"question {number}", answer, 9, 7, vector, 1.0

    rows = [row(1, "an answer of 23 letters", [1.0, 0.0, 0.0]), row(2, "other", [0.0, 1.0, 0.0]), row(3, "ok", [0.0, 0.0, 1.0]),
            row(4, "never called", [1.0, 0.0, 0.0])]
    return spark.createDataFrame(rows, REQUESTS).withColumn("created_at", F.col("created_at").cast("timestamp"))


def test_misses_without_a_record_are_billed_by_the_joined_estimate(spark):
    got = routed(spark, requests(spark))
    assert [(got[i]["cache_hit"], got[i]["input_tokens"], got[i]["output_tokens"]) for i in (1, 2, 3, 4)] == [
        (False, 7, 5), (False, 7, 1), (False, 7, 0), (True, 9, 5)]


def test_misses_with_a_record_are_billed_by_it(spark):
    usage = F.when(F.col("id") == 1, F.struct(F.lit(100).cast("long").alias("prompt_tokens"), F.lit(50).cast("long").alias("completion_tokens"))) \
        .when(F.col("id") == 2, F.struct(F.lit(None).cast("long").alias("prompt_tokens"), F.lit(3).cast("long").alias("completion_tokens")))
    got = routed(spark, requests(spark).withColumn("usage", usage))
    # a null count of a record is zero; a hit calls no model, whatever its row says
    assert [(got[i]["input_tokens"], got[i]["output_tokens"]) for i in (1, 2, 3, 4)] == [(100, 50), (0, 3), (7, 0), (9, 5)]
