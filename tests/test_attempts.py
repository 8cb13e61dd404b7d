from costlens.operators import attempts, conversations

COLUMNS = "request_id string, attempt_no int, provider string, tier string, error_text string"


def test_rollup(spark):
    rows = [
        ("plain", 1, "primary", "simple", None),
        ("patient", 1, "primary", "simple", "Rate limit hit: 429"), ("patient", 2, "primary", "simple", "429"), ("patient", 3, "primary", "simple", None),
        ("spent", 1, "primary", "complex", "429"), ("spent", 2, "primary", "complex", "429"), ("spent", 3, "primary", "complex", "429"), ("spent", 4, "local", "complex", None),
        ("climber", 1, "primary", "simple", "Timeout"), ("climber", 2, "primary", "medium", None),
        ("lost", 1, "primary", "complex", "Timeout"), ("lost", 2, "local", "complex", "Connection error"),
    ]
    got = {r["request_id"]: r for r in attempts.rollup(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert (got["plain"]["tier_used"], got["plain"]["escalated"], got["plain"]["wait_seconds"], got["plain"]["first_error"]) == ("simple", False, 0, None)
    assert (got["patient"]["retries"], got["patient"]["wait_seconds"]) == (2, 3)
    # no wait after the last of three tries
    assert (got["spent"]["retries"], got["spent"]["wait_seconds"], got["spent"]["fallback_used"]) == (3, 3, True)
    assert (got["climber"]["tier_used"], got["climber"]["escalated"], got["climber"]["fallback_used"]) == ("medium", True, False)
    assert (got["lost"]["answered"], got["lost"]["fallback_used"], got["lost"]["first_error"]) == (False, False, "Timeout")


def test_confidence_is_cut_only_on_escalation(spark):
    rolled = attempts.rollup(spark.createDataFrame(
        [("a", 1, "primary", "simple", "Timeout"), ("a", 2, "primary", "medium", None),
         ("b", 1, "primary", "complex", "Timeout"), ("b", 2, "local", "complex", None)], COLUMNS))
    graded = spark.createDataFrame([("a", "simple", 0.8), ("b", "complex", 0.8), ("c", "simple", 0.8)], "request_id string, tier string, confidence double")
    got = {r["request_id"]: (r["final_tier"], round(r["confidence"], 4)) for r in attempts.escalated_confidence(graded, rolled).collect()}
    assert got == {"a": ("medium", 0.6), "b": ("complex", 0.8), "c": ("simple", 0.8)}


def test_messages(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "first"), (1, 2, "assistant", "ok"), (1, 3, "user", "second"), (1, 4, "assistant", "done"),
            (2, 0, "assistant", "hello")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {r["conv_id"]: r["question"] for r in conversations.last_user_message(messages).collect()} == {1: "second", 2: ""}
    assert {r["conv_id"]: r["estimated_tokens"] for r in conversations.token_estimate(messages).collect()} == {1: 5, 2: 1}
    assert {r["conv_id"]: r["estimated_tokens"] for r in conversations.token_estimate_joined(messages).collect()} == {1: (7 + 5 + 2 + 6 + 4 + 4) // 4, 2: 1}


def test_settings(spark):
    rows = [("simple", None, None), ("simple", 0.0, 0), ("complex", 1.5, 10)]
    got = conversations.effective_settings(spark.createDataFrame(rows, "tier string, temperature double, max_tokens long")).collect()
    assert sorted((r["tier"], r["temperature"], r["max_tokens"]) for r in got) == [("complex", 1.5, 10), ("simple", 0.7, 1024), ("simple", 0.7, 1024)]


def test_validation_names_every_problem(spark):
    rows = [(["user"], 0.7, None, False), (["tool", "user"], 2.5, 0, True), (["user"], None, 1, None)]
    frame = spark.createDataFrame(rows, "roles array<string>, temperature double, max_tokens long, stream boolean")
    assert [r["problems"] for r in conversations.validate(frame).collect()] == [[], ["role", "temperature", "max_tokens", "stream"], []]


def test_blank_question(spark):
    frame = spark.createDataFrame([(1, " \n\t"), (2, "x" * 3000)], "conv_id long, question string")
    got = {r["conv_id"]: r for r in conversations.guard(frame).collect()}
    assert got[1]["preset_tier"] == "medium" and got[1]["encoder_text"] is None
    assert got[2]["preset_tier"] is None and len(got[2]["encoder_text"]) == 2000
