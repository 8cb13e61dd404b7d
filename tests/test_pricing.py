import pytest
from conftest import one
from pyspark.sql import functions as F

from costlens.functions import pricing, text
from costlens.functions.vectors import cosine


def priced(spark, rows, strict=False):
    frame = spark.createDataFrame(rows, "tier string, input_tokens long, output_tokens long, cache_hit boolean")
    return [r.asDict() for r in pricing.with_costs(frame, strict).collect()]


@pytest.mark.parametrize("tier,theoretical", [("simple", 0.0015), ("medium", 0.00075), ("complex", 0.02)])
def test_a_thousand_tokens_each_way(spark, tier, theoretical):
    row = priced(spark, [(tier, 1000, 1000, False)])[0]
    assert row["actual_cost_usd"] == 0
    assert row["baseline_cost_usd"] == pytest.approx(0.02)
    assert row["theoretical_cost_usd"] == pytest.approx(theoretical)
    assert row["savings_usd"] == pytest.approx(0.02 - theoretical)
    assert row["savings_source"] == "routing"


@pytest.mark.parametrize("tier", ["simple", "medium", "complex", "cache"])
def test_a_hit_saves_the_whole_baseline(spark, tier):
    row = priced(spark, [(tier, 500, 500, True)])[0]
    assert row["theoretical_cost_usd"] == 0
    assert row["savings_usd"] == row["baseline_cost_usd"] == pytest.approx(0.01)
    assert row["savings_source"] == "cache"


def test_no_tokens_cost_nothing(spark):
    row = priced(spark, [("complex", 0, 0, False)])[0]
    assert row["baseline_cost_usd"] == row["theoretical_cost_usd"] == row["savings_usd"] == 0


def test_unknown_tier(spark):
    rows = [("nonexistent", 10, 10, False), ("nonexistent", 10, 10, True), ("simple", 10, 10, False)]
    frame = spark.createDataFrame(rows, "tier string, input_tokens long, output_tokens long, cache_hit boolean")
    assert pricing.invalid_tiers(frame).count() == 1
    with pytest.raises(Exception, match="not on the rate card"):
        priced(spark, rows, strict=True)
    assert priced(spark, rows[:1])[0]["theoretical_cost_usd"] is None


@pytest.mark.parametrize("value,tokens", [("", 1), ("abcd", 1), ("a" * 400, 100)])
def test_token_estimate(spark, value, tokens):
    frame = spark.createDataFrame([(value,)], "t string")
    assert one(frame.select(text.estimated_tokens(F.col("t")).alias("n")))["n"] == tokens


def test_fingerprint_counts_characters(spark):
    got = one(spark.createDataFrame([("é→",)], "t string").select(text.fingerprint(F.col("t")).alias("f")))["f"]
    assert got.startswith("sha256:") and got.endswith("(len=2)")


@pytest.mark.parametrize("message,category", [
    ("RateLimit reached", "rate_limit"), ("HTTP 429", "rate_limit"), ("model was Decommissioned", "deprecated"),
    ("Connection refused", "connection"), ("Timeout calling x", "timeout"), ("odd", "other"), (None, None)])
def test_error_category(spark, message, category):
    frame = spark.createDataFrame([(message,)], "e string")
    assert one(frame.select(text.error_category(F.col("e")).alias("c")))["c"] == category


@pytest.mark.parametrize("a,b,score", [
    ([1.0, 0.0], [2.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 3.0], 0.0), ([1.0], [1.0, 0.0], 0.0), ([0.0, 0.0], [1.0, 1.0], 0.0)])
def test_cosine(spark, a, b, score):
    frame = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    assert one(frame.select(cosine(F.col("a"), F.col("b")).alias("s")))["s"] == pytest.approx(score)


@pytest.mark.parametrize("model,short", [
    ("groq/openai/gpt-oss-20b", "gpt-oss-20b"), ("groq/groq/x", "groq/x"), ("ollama/llama3.2:3b", "ollama/llama3.2:3b")])
def test_short_name(spark, model, short):
    frame = spark.createDataFrame([(model,)], "m string")
    assert one(frame.select(text.model_short_name(F.col("m")).alias("s")))["s"] == short
