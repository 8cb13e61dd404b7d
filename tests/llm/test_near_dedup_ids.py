"""Near duplicates where one id has unlike texts."""

from pyspark.sql import functions as F

from costlens.llm import near_dedup


def text(seed, changed=0):
    return " ".join(f"w{seed}x{i}" if i >= changed else f"other{i}" for i in range(100))


def test_unlike_texts_of_one_id(spark):
    rows = [(1, text("a")), (1, text("b")), (2, text("a", 3)), (3, text("b", 3)), (4, text("c")), (4, text("c")), (5, text("d")), (5, text("d", 2)), (5, None), (None, text("a"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("own")).withColumn("row", F.lit("own")).withColumn("key1", F.lit(1)).repartition(3)
    found = sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).where("doc_id IS NOT NULL").collect())
    assert found == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (4, 4, True), (5, 5, True), (5, 5, True), (5, 5, True)]
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    left = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    assert [doc for doc, _ in left] == [0, 1, 1, 4, 5, 5]
    assert {t for doc, t in left if doc == 1} == {text("a"), text("b")} and ("" in {t for doc, t in left if doc == 5})
