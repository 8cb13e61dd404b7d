"""Streams in several batches against the batch result on the same events."""

from conftest import SF, one
from pyspark.sql import functions as F

from costlens.operators import cache, reports
from costlens.plans.catalogue import _cache_traffic
from costlens.sources import tables
from costlens.streaming import feed, writers


def frames(spark, logs, path, repeats=True):
    """Four files in time order."""
    made = feed.to_events(logs, keep=["id", "created_at"])
    cuts = [F.lit(f"2024-01-{d:02d}") for d in (1, 8, 15, 22)] + [F.lit("2024-03-01")]
    for i in range(4):
        part = made.where((F.col("created_at") >= cuts[i]) & (F.col("created_at") < cuts[i + 1])).select("value")
        lines = part.union(part.limit(20)) if repeats else part
        lines.union(spark.createDataFrame([("{broken",), ('{"type": "ping"}',), ('{"type": "request"}',)], "value string")).coalesce(1).write.mode("append").text(path)


def test_several_batches_keep_the_batch_figures(spark, logs, tmp_path):
    path = str(tmp_path / "frames")
    frames(spark, logs, path)
    events = feed.parse(feed.read_frames(spark, path, files_per_batch=1))
    feed.running_totals(events, f"{tmp_path}/totals", f"{tmp_path}/c1")
    live = feed.latest_totals(spark, f"{tmp_path}/totals")
    assert one(live) == one(reports.kpi_totals(logs))
    assert one(feed.reconcile(logs, live))["in_step"]
    assert not one(feed.reconcile(logs.where("id > 5"), live))["in_step"]


def test_later_events_add_to_the_published_snapshot(spark, logs, tmp_path):
    path, totals, output = (str(tmp_path / name) for name in ("frames", "totals", "published"))
    events = None
    for version, (low, high) in enumerate((("2024-01-01", "2024-01-08"), ("2024-01-08", "2024-01-15"), ("2024-01-15", "2024-03-01"))):
        upto = logs.where(F.col("created_at") < high)
        feed.to_events(upto.where(F.col("created_at") >= low)).coalesce(1).write.mode("append").text(path)
        events = events or feed.parse(feed.read_frames(spark, path))
        if version == 0:  # before the first batch: everything streamed is added
            feed.publish_snapshot(logs.limit(0), totals, output)
        feed.running_totals(events, totals, f"{tmp_path}/c")
        assert one(feed.published_totals(spark, totals, output)) == one(reports.kpi_totals(upto))
        if version == 1:
            # the log holds a correction that the stream never saw: the snapshot has the last word
            assert feed.publish_snapshot(upto.where("id <> 5"), totals, output) == 1
            assert one(feed.published_totals(spark, totals, output)) == one(reports.kpi_totals(upto.where("id <> 5")))
            logs = logs.where("id <> 5")
    assert one(feed.published_totals(spark, totals, output))["requests"] == logs.count()


def test_recent_events_across_batches(spark, logs, tmp_path):
    path = str(tmp_path / "frames")
    frames(spark, logs, path)
    events = feed.parse(feed.read_frames(spark, path, files_per_batch=1))
    feed.recent_events(events, f"{tmp_path}/recent", f"{tmp_path}/c", 50)
    got = {r["request_id"] for r in feed.latest_recent(spark, f"{tmp_path}/recent").collect()}
    assert got == {r["request_id"] for r in logs.orderBy(F.desc("created_at"), F.desc("request_id")).limit(50).collect()}


def test_restart_adds_nothing_twice(spark, logs, tmp_path):
    path = str(tmp_path / "frames")
    frames(spark, logs, path, repeats=False)
    for _ in range(2):
        feed.run(feed.deduplicated(feed.parse(feed.read_frames(spark, path))), f"{tmp_path}/out", f"{tmp_path}/c")
    assert spark.read.parquet(f"{tmp_path}/out").count() == logs.count()


def test_priced_log_isolates_bad_rows(spark, tmp_path):
    requests = tables.requests(spark, SF).withColumn("tier", F.when(F.col("id") == 3, "odd").otherwise(F.col("tier")))
    requests.withColumn("cache_hit", F.lit(False)).where("tier <> 'cache'").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(requests.schema).parquet(f"{tmp_path}/in")
    writers.priced_log(stream, f"{tmp_path}/log", f"{tmp_path}/bad", f"{tmp_path}/c")
    assert [r["id"] for r in writers.read_batches(spark, f"{tmp_path}/bad").collect()] == [3]
    assert writers.read_batches(spark, f"{tmp_path}/log").count() == requests.where("tier not in ('cache', 'odd')").count()


def test_streamed_cache_equals_replay(spark, tmp_path):
    requests = _cache_traffic(spark, SF).cache()
    for low, high in (("00:00:00", "02:30:00"), ("02:30:00", "05:00:00"), ("05:00:00", "23:59:59")):
        part = requests.where(F.date_format("asked_at", "HH:mm:ss").between(low, high) & (F.date_format("asked_at", "HH:mm:ss") != high))
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    writers.cached_decisions(stream, f"{tmp_path}/out", f"{tmp_path}/alive", f"{tmp_path}/c")
    streamed = {r["request_id"]: (r["hit"], r["stored"]) for r in writers.read_batches(spark, f"{tmp_path}/out").collect()}
    assert streamed == {r["request_id"]: (r["hit"], r["stored"]) for r in cache.replay(requests).collect()}


def test_folders_do_not_grow_with_batches(spark, logs, tmp_path, monkeypatch):
    monkeypatch.setattr(feed, "KEPT_BATCHES", 2)
    path, totals, recent, output = (str(tmp_path / name) for name in ("frames", "totals", "recent", "published"))
    for day in range(1, 7):
        feed.to_events(logs.where(F.dayofmonth("created_at") == day)).coalesce(1).write.mode("append").text(path)
    events = feed.parse(feed.read_frames(spark, path, files_per_batch=1))
    seen = logs.where(F.dayofmonth("created_at") <= 6)
    feed.running_totals(events, totals, f"{tmp_path}/c1")
    feed.recent_events(events, recent, f"{tmp_path}/c2", 30)
    assert len(list((tmp_path / "totals").glob("batch=*"))) == len(list((tmp_path / "recent").glob("batch=*"))) == 2
    assert one(feed.latest_totals(spark, totals)) == one(reports.kpi_totals(seen))
    got = {r["request_id"] for r in feed.latest_recent(spark, recent).collect()}
    assert got == {r["request_id"] for r in seen.orderBy(F.desc("created_at"), F.desc("request_id")).limit(30).collect()}
    # the snapshot knows what was streamed before it, though the folder of its position goes
    feed.publish_snapshot(seen, totals, output)
    for day in (7, 8, 9):
        feed.to_events(logs.where(F.dayofmonth("created_at") == day)).coalesce(1).write.mode("append").text(path)
    feed.running_totals(events, totals, f"{tmp_path}/c1")
    assert one(feed.published_totals(spark, totals, output)) == one(reports.kpi_totals(logs.where(F.dayofmonth("created_at") <= 9)))
