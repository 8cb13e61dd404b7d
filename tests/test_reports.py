"""Invariants, empty input, and independence from partitioning."""

import pytest
from conftest import one
from pyspark.sql import Window, functions as F

from costlens.operators import evaluation, history, nodes, ordering, reports, snapshot
from costlens.sources import logs as log_source


def test_parts_add_up(logs):
    totals = one(reports.kpi_totals(logs))
    split = one(reports.savings_split(logs))
    assert split["cache_usd"] + split["routing_usd"] == pytest.approx(totals["savings_usd"])
    assert one(reports.savings_split_residual(logs)) == split
    hits = one(reports.cache_hit_miss(logs))
    assert hits["hit"] + hits["miss"] == totals["requests"] == logs.count()
    assert sum(r["count"] for r in reports.tier_distribution(logs).collect()) == totals["requests"]
    last = reports.savings_series(logs).orderBy(F.desc("position")).first()
    assert last["cumulative_savings"] == pytest.approx(totals["savings_usd"])


def test_complex_requests_save_nothing(logs):
    assert one(reports.kpi_totals(logs.where("tier = 'complex'")))["savings_usd"] == 0


def test_empty_log(logs):
    none = logs.limit(0)
    assert set(one(reports.kpi_totals(none)).values()) == {0}
    assert set(one(reports.savings_split(none)).values()) == {0.0}
    assert [r["count"] for r in reports.model_distribution(none).collect()] == [0, 0, 0, 0]
    assert one(history.page_count(none))["pages"] == 1
    assert reports.savings_series(none).count() == 0
    assert reports.latency_percentiles(none, {"p50": 0.5}).count() == 0
    document = one(snapshot.stats_snapshot(none))
    assert document["totals"]["requests"] == 0 and document["cumulative_savings"] == []
    assert nodes.last_request_nodes(none).where("active").count() == 1


def test_partitioning_does_not_matter(logs):
    spread = logs.repartition(7, "id")
    assert one(reports.kpi_totals(spread)) == one(reports.kpi_totals(logs.coalesce(1)))
    assert sorted(reports.kpi_cube(spread).collect(), key=str) == sorted(reports.kpi_cube(logs).collect(), key=str)


def test_unknown_model_follows_the_known_ones(logs):
    odd = logs.withColumn("model_used", F.when(F.col("id") % 2 == 0, "zeta/x").otherwise("alpha/y"))
    assert [r["model"] for r in reports.model_spine(odd).orderBy("position").collect()][4:] == ["alpha/y", "zeta/x"]
    assert reports.unknown_models(logs).count() == 0


@pytest.mark.parametrize("rows_per_range", [10, 97, 10_000])
def test_running_total_in_ranges(logs, rows_per_range):
    # a third of the rows share one instant
    hot = logs.withColumn("created_at", F.when(F.col("id") % 3 == 0, F.to_timestamp(F.lit("2024-01-12 00:00:00"))).otherwise(F.col("created_at")))
    ours = ordering.cumulative_savings(hot, rows_per_range)
    upto = Window.orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, 0)
    plain = hot.select("id", F.row_number().over(Window.orderBy("created_at", "id")).alias("p"),
                       F.sum(F.col("savings_usd").cast("decimal(18,8)")).over(upto).cast("double").alias("c"))
    off = ours.join(plain, "id").where((F.col("p") != F.col("position")) | (F.abs(F.col("c") - F.col("cumulative_savings")) > 1e-9))
    assert ours.count() == hot.count() and off.count() == 0


def test_ranges_are_even_under_a_hot_instant(logs):
    hot = logs.withColumn("created_at", F.to_timestamp(F.lit("2024-01-12 00:00:00")))
    sizes = [r["count"] for r in ordering.with_range(hot, ["created_at", "id"], 50)[0].groupBy("_range").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 5 * 50


@pytest.mark.parametrize("rows_per_range", [7, 10_000])
@pytest.mark.parametrize("quantiles", [[0.5, 0.95], [0.0, 0.25, 1.0]])
def test_exact_quantiles(logs, rows_per_range, quantiles):
    skewed = logs.withColumn("latency_ms", F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("latency_ms")))
    ours = {r["tier"]: [r[f"q{i}"] for i in range(len(quantiles))] for r in
            ordering.exact_quantiles(skewed, "tier", "latency_ms", quantiles, rows_per_range).collect()}
    built_in = skewed.groupBy("tier").agg(F.percentile("latency_ms", F.array(*[F.lit(q) for q in quantiles])).alias("q"))
    for row in built_in.collect():
        assert ours[row["tier"]] == pytest.approx(row["q"])


def test_approximate_percentiles_are_close(logs):
    exact = {r["tier"]: r for r in reports.latency_percentiles(logs, {"p50": 0.5, "p95": 0.95}).collect()}
    for row in reports.latency_percentiles_approx(logs).collect():
        assert row["count"] == exact[row["tier"]]["count"]
        assert abs(row["p50"] - exact[row["tier"]]["p50"]) < 3


@pytest.mark.parametrize("n,points", [(200, 200), (201, 101), (1000, 201), (10_000, 201)])
def test_downsample(spark, n, points):
    series = spark.range(1, n + 1).select(F.col("id").alias("position"), F.lit(n).alias("rows"))
    kept = [r["position"] for r in ordering.downsample(series, 200).orderBy("position").collect()]
    expected = list(range(1, n + 1, -(-n // 200)))
    if expected[-1] != n:
        expected.append(n)
    assert kept == expected
    assert len(kept) == points


@pytest.mark.parametrize("rows_per_range,points", [(10, 3), (10, 200), (97, 7), (10_000, 200)])
def test_points_of_a_series_in_ranges(logs, rows_per_range, points):
    whole = ordering.downsample(ordering.cumulative_savings(logs), points)
    assert sorted(ordering.cumulative_savings(logs, rows_per_range, points).collect()) == sorted(whole.collect())


def test_ranges_without_a_point_are_not_ordered(spark, logs):
    series = ordering.cumulative_savings(logs, 10, 3)
    plan = series._jdf.queryExecution().optimizedPlan().toString()
    # the rows are cut down to the ranges wanted below the window
    assert 0 < plan.index("Window") < plan.index("Join LeftSemi")
    totals = spark.range(100).select((F.col("id") * 10).alias("before"), F.lit(10).alias("n"), F.lit(1000).alias("rows"))
    held = totals.where(ordering._holds_point(F.col("before"), F.col("n"), F.col("rows"), 3))
    assert [r["before"] for r in held.orderBy("before").collect()] == [0, 330, 660, 990]


def test_files_of_a_day_grow_with_its_bytes(spark, logs, tmp_path):
    scattered = logs.repartition(40)
    days = logs.select(F.to_date("created_at")).distinct().count()
    log_source.append(scattered, f"{tmp_path}/few")
    assert len(list((tmp_path / "few").glob("day=*/*.parquet"))) == days
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    try:
        spark.conf.set(size, "2000")
        log_source.append(scattered.withColumn("created_at", F.to_timestamp(F.lit("2024-01-12 00:00:00"))), f"{tmp_path}/hot")
    finally:
        spark.conf.set(size, before)
    assert len(list((tmp_path / "hot").glob("day=*/*.parquet"))) > 1
    assert log_source.scan(spark, f"{tmp_path}/hot").count() == log_source.scan(spark, f"{tmp_path}/few").count() == logs.count()


def test_pages_tile_the_log(logs):
    ids = [r["id"] for n in range(1, 4) for r in history.page(logs, n, 10, "latency_ms", "asc").orderBy("latency_ms", "id").collect()]
    whole = [r["id"] for r in logs.orderBy("latency_ms", "id").limit(30).collect()]
    assert ids == whole
    assert {r["id"] for r in history.page(logs, 0, 5).collect()} == {r["id"] for r in history.page(logs, 1, 5).collect()}
    last = history.page(logs, 1, 10).orderBy("created_at", "id").first()
    behind = history.page_after(logs, F.lit(last["created_at"]), F.lit(last["id"]), 10)
    assert {r["id"] for r in behind.collect()} == {r["id"] for r in history.page(logs, 2, 10).collect()}


def test_unlisted_sort_column_falls_back_to_time(logs):
    assert history.page(logs, 1, 5, "query_id").collect() == history.page(logs, 1, 5, "created_at").collect()


def test_log_round_trip_with_day_pruning(spark, logs, tmp_path):
    path = str(tmp_path / "log")
    log_source.append(logs, path)
    log_source.append(logs.withColumn("id", F.col("id") + 1_000_000), path)
    recent = log_source.scan(spark, path, "2024-01-20 00:00:00")
    assert recent.count() == 2 * logs.where("created_at >= '2024-01-20'").count()
    assert "PartitionFilters: [isnotnull(day" in recent._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_matrix_of_sixty(spark):
    tiers = ["simple", "medium", "complex"]
    rows = [(i, tiers[i % 3], tiers[i % 3] if i % 5 else tiers[(i + 1) % 3]) for i in range(60)] + [(99, "huh", "simple"), (98, None, "simple")]
    scored = spark.createDataFrame(rows, "query_id long, label string, predicted string")
    cells = evaluation.confusion_matrix(scored).collect()
    assert len(cells) == 9
    assert all(sum(c["n"] for c in cells if c["label"] == t) == 20 for t in tiers)
    assert one(evaluation.accuracy_gate(scored)) == {"accuracy": 0.8, "correct": 48, "total": 60, "passed": True, "target_accuracy": 0.8}
    assert evaluation.invalid_labels(scored).count() == 2
    empty = evaluation.class_metrics(scored.limit(0)).collect()
    assert len(empty) == 3 and all(r["f1"] == 0 and r["support"] == 0 for r in empty)
