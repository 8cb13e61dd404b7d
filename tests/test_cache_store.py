"""A written cache store: whole entries, expiry by folder, compaction; and live entries of the streamed cache."""

import os

from pyspark.sql import functions as F

from costlens.sources import cache_store
from costlens.streaming import writers


def answered(spark, rows):
    frame = spark.createDataFrame(rows, "query string, response string, tier string, s long, embedding array<double>")
    start = F.unix_micros(F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    return frame.withColumn("stored_at", F.timestamp_micros(start + F.col("s") * 1_000_000)).drop("s")


def test_store(spark, tmp_path):
    rows = [(f"q{i % 40}", f"a{i}", "simple", 60 * i, [0.5, float(i)]) for i in range(200)]
    rows += [("", "a", "simple", 0, None), ("q", None, "simple", 0, None), ("timeless", "a", "simple", None, None)]
    path = f"{tmp_path}/store"
    entries = cache_store.keyed(cache_store.build(answered(spark, rows)))
    cache_store.append(entries.where("stored_at < TIMESTAMP '2024-01-01 01:00:00'"), path)
    cache_store.append(entries.where("stored_at >= TIMESTAMP '2024-01-01 01:00:00'"), path)
    back = cache_store.read(spark, path, "2024-01-01 00:00:00")
    assert sorted(r["response"] for r in back.collect()) == sorted(r[1] for r in rows[:200])
    assert {r["response"]: r["embedding"] for r in back.collect()} == {r[1]: r[4] for r in rows[:200]}
    moment = "2024-01-01 02:33:00"
    live = {f"a{i}" for i in range(200) if 60 * i + 3600 > 9180}
    late = cache_store.read(spark, path, moment)
    assert {r["response"] for r in late.collect()} == live
    assert "PartitionFilters: [isnotnull(expires_bucket" in late._jdf.queryExecution().toString()
    before = len([n for n in os.listdir(path) if n.startswith("expires_bucket=")])
    removed = cache_store.purge(spark, path, moment)
    after = [n for n in os.listdir(path) if n.startswith("expires_bucket=")]
    assert removed == before - len(after) > 0 and cache_store.purge(spark, path, moment) == 0
    assert {r["response"] for r in cache_store.read(spark, path, moment).collect()} == live
    cache_store.append(entries.where("response = 'a199'"), path)  # added twice
    cache_store.compact(spark, path, f"{tmp_path}/small", moment)
    kept = cache_store.read(spark, f"{tmp_path}/small", moment).collect()
    assert sorted(r["response"] for r in kept) == sorted(f"a{i}" for i in range(160, 200))


def test_one_folder_has_few_files(spark, tmp_path):
    rows = [(f"q{i}", "a", "simple", i % 600, None) for i in range(2000)]
    cache_store.append(cache_store.build(answered(spark, rows).repartition(16)), f"{tmp_path}/s", 6000)
    files = [f for folder, _, names in os.walk(f"{tmp_path}/s") for f in names if f.endswith(".parquet") and "_schema" not in folder]
    assert len(files) == 1


def test_odd_times_keep_live_entries(spark, tmp_path):
    """A batch without any time, and one with a time far ahead, leave what is alive alone."""
    start = F.unix_micros(F.to_timestamp(F.lit("2024-01-01 00:00:00")))

    def batch(rows, name):
        frame = spark.createDataFrame(rows, "request_id long, s long, embedding array<double>, answered boolean")
        frame = frame.withColumn("asked_at", F.timestamp_micros(start + F.col("s") * 1_000_000)).drop("s")
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        return frame.schema

    batch([(1, 0, [1.0, 0.0], True)], "first")
    batch([(2, None, [1.0, 0.0], True)], "timeless")
    batch([(3, 20, [0.0, 1.0], True), (4, 10_000_000, [0.0, 1.0], True)], "ahead")
    schema = batch([(5, 60, [1.0, 0.0], True)], "last")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    writers.cached_decisions(stream, f"{tmp_path}/out", f"{tmp_path}/alive", f"{tmp_path}/c")
    found = {r["request_id"]: (r["hit"], r["stored"]) for r in writers.read_batches(spark, f"{tmp_path}/out").collect()}
    assert found == {1: (False, True), 2: (False, False), 3: (False, True), 4: (False, True), 5: (True, False)}
