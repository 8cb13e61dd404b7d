"""Null keys, empty example sets and failed requests: the same answer at every input size."""

from costlens.operators import ordering, reports, similarity
from pyspark.sql import functions as F


def test_quantiles_keep_null_groups_in_any_number_of_ranges(spark):
    rows = spark.createDataFrame([(f"t{i % 4}" if i % 4 else None, float(i)) for i in range(200)] + [("only", 1.0)], "tier string, latency_ms double")
    one, many = (sorted(map(str, ordering.exact_quantiles(rows, "tier", "latency_ms", [0.5], size).collect())) for size in (1000, 20))
    assert one == many and len(one) == 5
    logs = rows.withColumn("id", F.monotonically_increasing_id())
    assert reports.latency_box(logs).count() == 5


def test_nearest_without_examples_or_with_two_widths(spark):
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0, 0.0])], "query_id long, embedding array<double>")
    examples = spark.createDataFrame([(1, "simple", [1.0, 0.0]), (2, "medium", [0.0, 1.0, 0.0])], "exemplar_id long, tier string, embedding array<double>")
    for limit in (0, 1000):
        none = similarity.nearest(queries, examples.limit(0), max_broadcast_rows=limit).collect()
        assert len(none) == 2 and all(row["neighbours"] == [] for row in none)
