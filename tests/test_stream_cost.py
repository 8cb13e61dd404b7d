"""What a stream's events cost: parsed once, made once, moved before anything is derived from them."""

from conftest import SF, one
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from costlens.operators import reports
from costlens.plans import catalogue
from costlens.sources import tables
from costlens.streaming import feed


def _plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_a_frame_is_parsed_once(spark, logs):
    frames = feed.to_events(logs)
    for events in (feed.parse(frames), feed.parse(frames, feed.TOTALLED)):
        assert _plan(events).count("from_json(") == 1
    assert "query_id" not in _plan(feed.parse(spark.createDataFrame([("{}",)], "value string"), feed.TOTALLED))


def test_fewer_figures_keep_the_events(spark, logs):
    good = '{"type": "request", "id": "a", "timestamp": "2024-01-01 00:00:00.000001", "savings_usd": 1.5, "cache_hit": true, "tier": "x"}'
    odd = [good, good[:40], good[:-1], f"[{good}]", f"{good} more", good + good, "", "null", "7", "[]", "{}", None, '{"type": "ping"}',
           '{"type": "request"}', '{"type": "request", "id": 7}', '{"type": "request", "id": "b", "tier": [1], "cache_hit": "yes"}',
           '{"type": "request", "id": "c", "latency_ms": {"a": 1}, "savings_usd": "x"}', '{"type": "request", "id": "d", "tier": tru}']
    frames = spark.createDataFrame([(line,) for line in odd], "value string").union(feed.to_events(logs))
    few = ["request_id", "created_at", *feed.TOTALLED]
    events, wanted = feed.parse(frames), feed.parse(frames, feed.TOTALLED)
    assert sorted(wanted.columns) == sorted(few)
    kept = sorted(events.select(few).collect(), key=repr)
    assert kept == sorted(wanted.select(few).collect(), key=repr)
    assert [r.request_id for r in kept if not r.request_id.startswith("chatcmpl-")] == ["7", "a", "a", "a", "b", "c"]
    assert one(reports.kpi_totals(wanted.where("request_id like 'chatcmpl-%'"))) == one(reports.kpi_totals(logs))


def test_events_are_moved_before_they_are_priced(spark, monkeypatch):
    written, text = [], DataFrameWriter.text

    def record(self, path, *args, **options):
        written.append(_plan(self._df))
        return text(self, path, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "text", record)
    assert one(catalogue.stream_reconcile(spark, SF))["in_step"]
    assert len(written) == 2  # each half once; the later one is not copied
    for plan in written:
        above, below = plan.split("RepartitionByExpression")
        assert "sha2(" in above and "sha2(" not in below and "round(" not in below


def test_events_by_time_are_whole_and_in_order(spark):
    middle = F.to_timestamp(F.lit("2024-01-15 00:00:00"))
    every = tables._events(spark, SF)
    for condition in (None, F.col("created_at") < middle, F.col("created_at") >= middle):
        rows = every if condition is None else every.where(condition)
        ranged = tables.events_by_time(spark, SF, condition, rows_per_range=40)
        assert sorted(ranged.collect()) == sorted(rows.collect())
        parts = ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.min("created_at"), F.max("created_at"), F.count("*").alias("n"))
        parts = parts.orderBy("p").collect()
        assert len(parts) > 8 and all(a[2] <= b[1] for a, b in zip(parts, parts[1:])) and max(p.n for p in parts) < 120


def test_state_is_not_counted_unless_asked(spark):
    key = "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"
    spark.conf.unset(key)
    feed._keep_state_on_disk(spark)
    assert spark.conf.get(key) == "false"
    spark.conf.set(key, "true")
    feed._keep_state_on_disk(spark)
    assert spark.conf.get(key) == "true"
    spark.conf.unset(key)
