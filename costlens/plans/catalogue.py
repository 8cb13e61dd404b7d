"""Every registered query: a name, the job, and the tables it reads.

Each one runs over its whole tables. Figures are returned as plain numbers and texts (times as
text) so that they compare across engines.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from costlens import constants as K
from costlens.functions import pricing, text
from costlens.functions.embedding import embed_text
from costlens.functions.vectors import cosine, norm
from costlens.operators import (
    attempts as A, cache as C, conversations as V, evaluation as X, grading as G, history as H,
    nodes as N, ordering as O, reports as R, similarity as M, snapshot as P,
)
from costlens.plans import route
from costlens.session import new_dir, prepare
from costlens.sources import cache_store, evaluation_files, logs as L, tables as S
from costlens.streaming import feed, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(job: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[job.__name__] = job
    return job


def moment(literal: str):
    return F.to_timestamp(F.lit(literal))


NOW = "2024-01-30 12:00:00"


# ---- sources and sinks -------------------------------------------------------------------

@query
def log_append(spark, folder):
    path = new_dir(prepare(spark), "log")
    L.append(S.request_logs(spark, folder), path)
    stored = spark.read.schema(L.STORED_LOG).parquet(path)
    return stored.select("id", text.iso(F.col("created_at")).alias("created_at"), "request_id", "tier",
                         "savings_usd", F.col("day").cast("string").alias("day"))


@query
def log_scan_recent(spark, folder):
    path = new_dir(prepare(spark), "log")
    L.append(S.request_logs(spark, folder), path)
    rows = L.newest_first(L.scan(spark, path, "2024-01-15 00:00:00"))
    return rows.select("id", text.iso(F.col("created_at")).alias("created_at"), "tier", "model_used", "savings_usd")


@query
def log_schema_upgrade(spark, folder):
    path = new_dir(prepare(spark), "old-log")
    L.append(S.request_logs(spark, folder).drop("routing_reason", "classifier_confidence"), path)
    return L.scan(spark, path).select("id", "tier", "routing_reason", "classifier_confidence")


@query
def rate_card(spark, folder):
    return R.rate_card_usage(S.request_logs(spark, folder))


@query
def exemplar_table(spark, folder):
    return S.exemplars(spark, folder).select(
        "exemplar_id", "tier", F.size("embedding").cast("long").alias("width"),
        F.round(norm(F.col("embedding")), 6).alias("length"))


@query
def eval_load(spark, folder):
    asked = V.last_user_message(S.messages(spark, folder))
    label = F.element_at(F.array(*[F.lit(t) for t in [*K.TIERS, "unknown"]]), (F.col("conv_id") % 4 + 1).cast("int"))
    lines = F.array(F.to_json(F.struct(F.col("question").alias("query"), label.alias("label"))), F.lit("  "), F.lit("not json"))
    path = new_dir(spark, "eval-lines")
    asked.select(F.explode(lines).alias("value")).write.text(path)
    return evaluation_files.load(spark, path).select(
        text.fingerprint(F.col("query")).alias("query_id"), "label", "reject_reason")


@query
def eval_result_sink(spark, folder):
    path = new_dir(prepare(spark), "eval-result")
    document = X.result_document(_scored(spark, folder))
    evaluation_files.write_result(document, path)
    return spark.read.schema(document.schema).json(path).select(
        "accuracy", "correct", "total", "passed", "target_accuracy",
        F.size("per_class").cast("long").alias("classes"), F.size("confusion").cast("long").alias("cells"))


def _answered(spark, folder):
    tier = F.element_at(F.array(F.lit("simple"), F.lit("medium"), F.lit("complex")), (F.col("conv_id") % 3 + 1).cast("int"))
    return V.exchanges(S.messages(spark, folder)).select(
        "conv_id", F.col("question").alias("query"), F.col("answer").alias("response"), tier.alias("tier"),
        S.after_start(F.col("conv_id") * 60).alias("stored_at"))


def _stored(spark, folder):
    """A store with the entries of all answered requests, with their vectors."""
    path = new_dir(prepare(spark), "store")
    cache_store.append(cache_store.keyed(embed_text(cache_store.build(_answered(spark, folder)), "query")), path)
    return path


def _cache_store(spark, folder):
    return cache_store.read(spark, _stored(spark, folder), "2024-01-01 00:00:00").select(
        "conv_id", "query_id", text.iso(F.col("stored_at")).alias("stored_at"), text.iso(F.col("expires_at")).alias("expires_at"), "tier", "key",
        F.sha2("query", 256).alias("query_sha256"), F.sha2("response", 256).alias("response_sha256"), F.size("embedding").cast("long").alias("width"))


QUERIES["cache_store"] = _cache_store


@query
def cache_purge_expired(spark, folder):
    path, moment = _stored(spark, folder), "2024-01-01 01:30:00"
    cache_store.purge(spark, path, moment)
    return cache_store.read(spark, path, moment).select("conv_id", text.iso(F.col("expires_at")).alias("expires_at"), "key")


@query
def live_event_feed(spark, folder):
    base = new_dir(prepare(spark), "live")
    logs = S.request_logs(spark, folder)
    logs.write.parquet(f"{base}/log")
    stream = spark.readStream.schema(logs.schema).parquet(f"{base}/log")
    feed.run(feed.to_events(stream), f"{base}/events", f"{base}/checkpoint")
    return feed.parse(spark.read.parquet(f"{base}/events")).select(
        "request_id", text.iso(F.col("created_at")).alias("created_at"), "query_id", "tier", "model_used", "cache_hit",
        "fallback_used", "latency_ms", "input_tokens", "output_tokens", "theoretical_cost_usd", "baseline_cost_usd",
        "savings_source", "routing_reason", "classifier_confidence")


# ---- projections, filters, predicates ----------------------------------------------------

@query
def last_user_message(spark, folder):
    return V.last_user_message(S.messages(spark, folder))


@query
def query_fingerprint(spark, folder):
    return V.last_user_message(S.messages(spark, folder)).select("conv_id", text.fingerprint(F.col("question")).alias("query_id"))


@query
def query_fingerprint_short(spark, folder):
    return V.last_user_message(S.messages(spark, folder)).select("conv_id", text.fingerprint(F.col("question"), 8).alias("query_id"))


@query
def token_estimate(spark, folder):
    return V.token_estimate(S.messages(spark, folder))


@query
def token_estimate_joined(spark, folder):
    return V.token_estimate_joined(S.messages(spark, folder))


@query
def usage_coalesce(spark, folder):
    key = F.col("conv_id")
    usage = F.struct(
        F.when(key % 5 != 0, key + 100).alias("prompt_tokens"), F.when(key % 7 != 0, key + 10).alias("completion_tokens"))
    calls = (
        V.exchanges(S.messages(spark, folder)).withColumnRenamed("joined_tokens", "estimated_input")
        .withColumn("estimated_output", F.floor(F.length("answer") / 4))
        .withColumn("usage", F.when(key % 3 != 0, usage))
    )
    return V.usage_or_estimate(calls).select("conv_id", "input_tokens", "output_tokens")


_COSTS = ["actual_cost_usd", "theoretical_cost_usd", "baseline_cost_usd", "savings_usd", "savings_source"]


@query
def cost_breakdown(spark, folder):
    priced = pricing.with_costs(S.requests(spark, folder), strict=True)
    return priced.select("id", "tier", "input_tokens", "output_tokens", "cache_hit", *_COSTS)


@query
def cache_hit_costing(spark, folder):
    """Every request priced as if the cache had answered it."""
    return pricing.with_costs(S.requests(spark, folder).withColumn("cache_hit", F.lit(True))).select("id", *_COSTS)


def _with_stray_tiers(requests):
    return requests.withColumn("tier", F.when(F.col("id") % 7 == 0, "nonexistent").otherwise(F.col("tier")))


@query
def invalid_tier_rows(spark, folder):
    return pricing.invalid_tiers(_with_stray_tiers(S.requests(spark, folder))).select("id", "tier")


@query
def effective_request_settings(spark, folder):
    key = F.col("id")
    asked = S.requests(spark, folder).where(~F.col("cache_hit")).select(
        "id", "tier",
        F.when(key % 4 == 1, 0.0).when(key % 4 > 1, key % 20 / 10).alias("temperature"),
        F.when(key % 3 == 1, 0).when(key % 3 == 2, 256).cast("long").alias("max_tokens"))
    return V.effective_settings(asked).select("id", "tier", "temperature", "max_tokens")


@query
def request_validation(spark, folder):
    key = F.col("conv_id")
    role = F.when((key % 13 == 0) & (F.col("role") == "system"), "tool").otherwise(F.col("role"))
    # a set of role names
    asked = S.messages(spark, folder).groupBy("conv_id").agg(F.collect_set(role).alias("roles")).select(
        "conv_id", "roles", (key % 25 / 10).alias("temperature"), (key % 7).alias("max_tokens"), (key % 11 == 0).alias("stream"))
    return V.validate(asked).select(
        "conv_id", F.concat_ws(",", "problems").alias("problems"), (F.size("problems") == 0).alias("accepted"))


@query
def model_bucket(spark, folder):
    return S.request_logs(spark, folder).select("id", text.model_bucket(F.col("model_used")).alias("model"))


@query
def model_short_name(spark, folder):
    return S.request_logs(spark, folder).select("id", text.model_short_name(F.col("model_used")).alias("short_name"))


@query
def routing_reason(spark, folder):
    return S.request_logs(spark, folder).select(
        "id", text.routing_reason(F.col("cache_hit"), F.col("fallback_used"), F.col("tier")).alias("reason"))


@query
def reason_category(spark, folder):
    return S.request_logs(spark, folder).groupBy(text.reason_category(F.col("routing_reason")).alias("category")).agg(
        F.count("*").alias("requests"))


@query
def request_path(spark, folder):
    return S.request_logs(spark, folder).select(
        "id", text.request_path(F.col("cache_hit"), F.col("model_used"), F.col("fallback_used")).alias("path"))


@query
def range_filter(spark, folder):
    logs = S.request_logs(spark, folder)
    parts = [
        R.in_range(logs, key, moment(NOW)).agg(F.count("*").alias("requests"), F.min("id").alias("first_id")).select(
            F.lit(key).alias("range_key"), "requests", "first_id")
        for key in ("today", "7d", "30d", "all")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query
def history_filter(spark, folder):
    logs = S.request_logs(spark, folder)
    return H.filtered(logs, since=moment("2024-01-10 00:00:00"), tier="medium", fallback_only=True).select(
        "id", "tier", "cache_hit", "fallback_used")


def _shown(rows):
    return rows.withColumn("created_at", text.iso(F.col("created_at")))


@query
def history_projection(spark, folder):
    return _shown(H.projection(S.request_logs(spark, folder), ["id"]))


@query
def text_guard(spark, folder):
    asked = V.last_user_message(S.messages(spark, folder))
    key = F.col("conv_id")
    # some conversations ask a blank question, some an overlong one
    varied = asked.withColumn("question", F.when(key % 9 == 0, F.lit("   ")).when(key % 9 == 1, F.repeat("question", 20)).otherwise(F.col("question")))
    return V.guard(varied).select(
        "conv_id", "preset_tier", "preset_confidence",
        F.length("encoder_text").cast("long").alias("encoder_chars"), text.fingerprint(F.col("encoder_text")).alias("encoder_id"))


@query
def error_category(spark, folder):
    return A.categories(S.attempts(spark, folder)).select("request_id", "attempt_no", "category")


@query
def report_format(spark, folder):
    return R.report_lines(S.request_logs(spark, folder), moment("2024-01-30 23:59:00"))


# ---- joins -------------------------------------------------------------------------------

@query
def cost_rate_join(spark, folder):
    return pricing.with_rates(S.requests(spark, folder)).select("id", "tier", "input_rate", "output_rate")


@query
def cosine_pairs(spark, folder):
    """Each probe with the entry it came from."""
    entries = S.cache_entries(spark, folder).select("cache_id", F.col("embedding").alias("stored"))
    pairs = S.probes(spark, folder).join(entries, F.col("query_id") == F.col("cache_id"))
    return pairs.select("query_id", "cache_id", F.round(cosine(F.col("embedding"), F.col("stored")), 6).alias("score"))


def _found(rows):
    return rows.select("query_id", "hit", "cache_id", F.round("score", 6).alias("score"), "response")


@query
def semantic_cache_lookup(spark, folder):
    return _found(C.lookup(S.probes(spark, folder), S.cache_entries(spark, folder)))


@query
def semantic_cache_ttl_join(spark, folder):
    return _found(C.lookup(S.probes(spark, folder), S.cache_entries(spark, folder), ttl_seconds=K.CACHE_TTL_SECONDS))


def _cache_traffic(spark, folder):
    """All entries and all probes as one log of requests."""
    first = S.cache_entries(spark, folder).select(
        (F.col("cache_id") * 2).alias("request_id"), F.col("stored_at").alias("asked_at"), "embedding",
        (F.length("response") > 0).alias("answered"))
    again = S.probes(spark, folder).select(
        (F.col("query_id") * 2 + 1).alias("request_id"), "asked_at", "embedding", F.lit(True).alias("answered"))
    return first.unionByName(again)


@query
def semantic_cache_replay(spark, folder):
    return C.replay(_cache_traffic(spark, folder)).select("request_id", "hit", "stored")


@query
def route_classify(spark, folder):
    return G.grade(S.probes(spark, folder), S.exemplars(spark, folder)).select("query_id", "predicted", "confidence", "score")


@query
def model_spine(spark, folder):
    return R.model_spine(S.request_logs(spark, folder))


@query
def node_metrics(spark, folder):
    return N.node_metrics(S.request_logs(spark, folder))


@query
def last_request_nodes(spark, folder):
    return N.last_request_nodes(S.request_logs(spark, folder))


@query
def eval_leak_check(spark, folder):
    copied = F.when(F.col("conv_id") % 8 == 0, F.lit("  WHAT is Python? ")).otherwise(F.col("text"))
    asked = S.messages(spark, folder).where("role = 'user'").select("conv_id", "turn", copied.alias("question"))
    return X.leaks(asked, S.example_questions(spark)).select("conv_id", "turn")


@query
def event_unseen(spark, folder):
    logs = S.request_logs(spark, folder)
    applied = logs.where(F.col("created_at") < moment("2024-01-15 00:00:00")).select("request_id")
    return logs.join(applied, "request_id", "left_anti").select("id", "request_id")


# ---- aggregations ------------------------------------------------------------------------

def _over_log(name, job):
    QUERIES[name] = lambda spark, folder: job(S.request_logs(spark, folder))


_over_log("kpi_totals", R.kpi_totals)
_over_log("tier_distribution", R.tier_distribution)
_over_log("model_distribution", R.model_distribution)
_over_log("savings_split", R.savings_split)
_over_log("savings_split_residual", R.savings_split_residual)
_over_log("latency_percentiles", lambda logs: R.latency_percentiles(logs, {"p50": 0.5, "p95": 0.95}))
_over_log("latency_percentiles_approx", R.latency_percentiles_approx)
_over_log("latency_bench_summary", lambda logs: R.latency_percentiles(logs, {"p50": 0.5, "p95": 0.95, "p99": 0.99}))
_over_log("latency_box", R.latency_box)
_over_log("latency_outliers", R.latency_outliers)
_over_log("cache_hit_miss", R.cache_hit_miss)
_over_log("history_count", lambda logs: H.count(H.filtered(logs, tier="simple", cache_hits_only=False, fallback_only=True)))
_over_log("empty_defaults", lambda logs: R.kpi_totals(logs.where(F.col("tier") == "absent")))
_over_log("cost_by_model", R.cost_by_model)
_over_log("savings_today", lambda logs: R.savings_today(logs, moment(NOW)))
_over_log("savings_by_period", R.savings_by_period)
_over_log("quota_utilisation", R.quota_utilisation)
_over_log("quota_minutes", R.quota_minutes)
_over_log("kpi_cube", R.kpi_cube)


@query
def stats_snapshot(spark, folder):
    document = P.stats_snapshot(S.request_logs(spark, folder))

    def joined(column, entry):
        return F.concat_ws(";", F.transform(column, entry)).alias(column)

    return document.select(
        "totals.*",
        joined("tier_distribution", lambda t: F.concat_ws(":", t["tier"], t["count"].cast("string"))),
        joined("model_distribution", lambda m: F.concat_ws("=", m["model"], m["count"].cast("string"))),
        joined("latency_percentiles", lambda t: F.format_string("%s:%.1f:%.1f:%d", t["tier"], t["p50"], t["p95"], t["count"])),
        joined("cumulative_savings", lambda p: F.format_string("%d=%s=%.8f", p["position"], p["timestamp"], p["cumulative_savings"])),
        "cache_hit_vs_miss.*", "savings_split.*")


def _scored(spark, folder):
    return G.grade(S.probes(spark, folder), S.exemplars(spark, folder)).select("query_id", "label", "predicted")


def _scored_with_strays(spark, folder):
    stray = F.when(F.col("query_id") % 9 == 0, "unknown").otherwise(F.col("label"))
    return _scored(spark, folder).withColumn("label", stray)


@query
def confusion_matrix(spark, folder):
    return X.confusion_matrix(_scored(spark, folder))


@query
def confusion_matrix_wide(spark, folder):
    return X.confusion_wide(_scored(spark, folder))


@query
def class_metrics(spark, folder):
    return X.class_metrics(_scored(spark, folder))


@query
def eval_accuracy_gate(spark, folder):
    return X.accuracy_gate(_scored(spark, folder))


@query
def eval_misclassified(spark, folder):
    return X.misclassified(_scored_with_strays(spark, folder))


@query
def eval_invalid_labels(spark, folder):
    return X.invalid_labels(_scored_with_strays(spark, folder))


@query
def eval_report(spark, folder):
    document = route.eval_report(S.probes(spark, folder), S.exemplars(spark, folder))
    return document.select("accuracy", "correct", "total", "passed", F.explode("per_class").alias("c")).select(
        "accuracy", "correct", "total", "passed", "c.*")


@query
def threshold_sweep(spark, folder):
    return C.threshold_sweep(S.probes(spark, folder), S.cache_entries(spark, folder), K.SWEEP_THRESHOLDS)


@query
def topk_sweep(spark, folder):
    return G.top_k_sweep(S.probes(spark, folder), S.exemplars(spark, folder), K.SWEEP_TOP_K)


@query
def quality_equivalence(spark, folder):
    return R.quality_equivalence(S.verdicts(spark, folder))


@query
def attempt_rollup(spark, folder):
    return A.rollup(S.attempts(spark, folder))


@query
def escalation_confidence(spark, folder):
    key = F.col("id")
    graded = S.requests(spark, folder).where(~F.col("cache_hit")).select(
        "request_id", F.when(key % 3 == 0, "simple").when(key % 3 == 1, "medium").otherwise("complex").alias("tier"),
        F.col("classifier_confidence").alias("confidence"))
    return A.escalated_confidence(graded, A.rollup(S.attempts(spark, folder))).withColumn("confidence", F.round("confidence", 6))


# ---- windows, sorts, sets ----------------------------------------------------------------

def _series(rows):
    return rows.select("id", "position", text.iso(F.col("created_at")).alias("created_at"), "cumulative_savings")


_over_log("cumulative_savings", lambda logs: _series(O.cumulative_savings(logs)))
_over_log("savings_downsample", lambda logs: _series(R.savings_series(logs)))
_over_log("sparkline_scale", lambda logs: R.sparkline(R.savings_series(logs)))
_over_log("bar_scale", R.bar_scale)
_over_log("history_page", lambda logs: _shown(H.page(logs, 3, 25, "latency_ms", "desc")))
_over_log("history_page_keyset", lambda logs: _shown(H.page_after(logs, moment("2024-01-20 00:00:00"), F.lit(0), 25)))
_over_log("history_sorted", lambda logs: _shown(H.projection(logs, ["id"]).orderBy(*H.order("savings_usd", "asc"))))
_over_log("page_count", H.page_count)
_over_log("recent_requests", lambda logs: _shown(H.recent(logs)))
_over_log("model_universe", R.model_universe)
_over_log("unknown_models", lambda logs: R.unknown_models(logs, bucket=False))


@query
def topk_neighbours(spark, folder):
    found = M.nearest(S.probes(spark, folder), S.exemplars(spark, folder))
    return M.neighbour_rows(found).withColumn("similarity", F.round("similarity", 6))


@query
def backoff_schedule(spark, folder):
    return A.backoff_schedule(S.attempts(spark, folder)).select("request_id", "attempt_no", "tier", "tier_try", "wait_seconds")


# ---- streaming ---------------------------------------------------------------------------

def _framed(spark, folder, condition=None):
    """The log, or what meets ``condition`` on ``created_at``, as JSON frames in ranges of time: some repeated, some malformed,
    some of another type."""
    key = F.col("id")
    frame = F.col("value")
    lines = F.array_compact(F.array(
        frame, F.when(key % 20 == 0, frame),
        F.when(key % 500 == 0, F.substring(frame, 1, 40)),
        F.when(key % 500 == 1, F.lit('{"type": "ping"}'))))
    logs = S.request_logs(spark, folder, S.events_by_time(spark, folder, condition))
    return feed.to_events(logs, keep=["id"]).select(F.explode(lines).alias("value"))


def _frames(spark, folder, condition=None, figures=None):
    """A feed of these frames, and the stream of its events."""
    base = new_dir(prepare(spark), "feed")
    _framed(spark, folder, condition).write.text(f"{base}/frames")
    return base, feed.parse(feed.read_frames(spark, f"{base}/frames"), figures)


@query
def stream_parse(spark, folder):
    base, events = _frames(spark, folder)
    feed.run(events, f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").select(
        "request_id", text.iso(F.col("created_at")).alias("created_at"), "tier", "cache_hit", "baseline_cost_usd")


@query
def stream_dedup(spark, folder):
    base, events = _frames(spark, folder)
    feed.run(feed.deduplicated(events), f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").select("request_id", "tier", "baseline_cost_usd")


def _live_totals(spark, folder):
    base, events = _frames(spark, folder, figures=feed.TOTALLED)
    feed.running_totals(events, f"{base}/out", f"{base}/checkpoint")
    return feed.latest_totals(spark, f"{base}/out")


@query
def stream_kpis(spark, folder):
    return _live_totals(spark, folder)


@query
def stream_recent(spark, folder):
    base, events = _frames(spark, folder)
    feed.recent_events(events, f"{base}/out", f"{base}/checkpoint", K.RECENT_ROWS)
    return feed.latest_recent(spark, f"{base}/out").select(
        "request_id", text.iso(F.col("created_at")).alias("created_at"), "tier", "model_used")


@query
def stream_reconcile(spark, folder):
    """A snapshot of the log in the middle of the month, then the events of the other half."""
    middle = moment("2024-01-15 00:00:00")
    base, events = _frames(spark, folder, F.col("created_at") < middle, feed.TOTALLED)
    feed.running_totals(events, f"{base}/out", f"{base}/checkpoint")
    feed.publish_snapshot(S.request_logs(spark, folder).where(F.col("created_at") < middle), f"{base}/out", f"{base}/published")
    _framed(spark, folder, F.col("created_at") >= middle).write.mode("append").text(f"{base}/frames")
    feed.running_totals(events, f"{base}/out", f"{base}/checkpoint")
    return feed.compared(feed.published_totals(spark, f"{base}/out", f"{base}/published"), feed.latest_totals(spark, f"{base}/out"))


@query
def stream_windows(spark, folder):
    base, events = _frames(spark, folder)
    feed.run(feed.tumbling(feed.deduplicated(events)), f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").withColumn("window_start", text.iso(F.col("window_start")))


@query
def stream_windows_sliding(spark, folder):
    base, events = _frames(spark, folder)
    feed.run(feed.sliding(feed.deduplicated(events)), f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").withColumn("window_start", text.iso(F.col("window_start")))


@query
def stream_windows_session(spark, folder):
    base, events = _frames(spark, folder)
    feed.run(feed.sessions(feed.deduplicated(events)), f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").withColumn("window_start", text.iso(F.col("window_start")))


@query
def stream_log_append(spark, folder):
    base = new_dir(prepare(spark), "priced")
    requests = _with_stray_tiers(S.requests(spark, folder))
    requests.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(requests.schema).parquet(f"{base}/in")
    writers.priced_log(stream, f"{base}/log", f"{base}/quarantine", f"{base}/checkpoint")
    good = writers.read_batches(spark, f"{base}/log").select("id", "tier", F.lit(True).alias("priced"), "baseline_cost_usd")
    bad = writers.read_batches(spark, f"{base}/quarantine").select("id", "tier", F.lit(False).alias("priced"), "baseline_cost_usd")
    return good.unionByName(bad)


@query
def stream_cache_ttl(spark, folder):
    base = new_dir(prepare(spark), "cache-stream")
    requests = _cache_traffic(spark, folder)
    requests.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(requests.schema).parquet(f"{base}/in")
    writers.cached_decisions(stream, f"{base}/out", f"{base}/alive", f"{base}/checkpoint")
    return writers.read_batches(spark, f"{base}/out").select("request_id", "hit", "stored")


# ---- text encoder and routing ------------------------------------------------------------

def _embed_text(spark, folder):
    made = embed_text(S.table(spark, folder, "documents").select("doc_id", "text"), "text")
    return made.select("doc_id", F.size("embedding").cast("long").alias("width"),
                       F.round(norm(F.col("embedding")), 6).alias("length"))


QUERIES["embed_text"] = _embed_text


@query
def route_batch(spark, folder):
    asked = embed_text(V.exchanges(S.messages(spark, folder)), "question").select(
        F.col("conv_id").alias("id"), S.after_start(F.col("conv_id") * 60).alias("created_at"), "question", "answer",
        "estimated_tokens", "joined_tokens", "embedding", F.length("answer").cast("double").alias("latency_ms"))
    routed = route.route_batch(asked, S.attempts(spark, folder), route.example_vectors(spark))
    return _shown(routed.select("id", *K.HISTORY_COLUMNS, "request_id", "classifier_confidence"))
