"""Scoring of graded questions: ``query_id, label, predicted``."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from costlens import constants as K
from costlens.functions.money import ratio
from costlens.session import fixed_table


def _valid():
    return F.coalesce(F.col("label").isin(K.TIERS) & F.col("predicted").isin(K.TIERS), F.lit(False))


def invalid_labels(scored: DataFrame) -> DataFrame:
    return scored.where(~_valid())


def misclassified(scored: DataFrame) -> DataFrame:
    return scored.where(_valid() & (F.col("label") != F.col("predicted")))


def _cells(spark: SparkSession) -> DataFrame:
    """Nine fixed rows."""
    return fixed_table(spark, [(a, p) for a in K.TIERS for p in K.TIERS], "label string, predicted string")


def confusion_matrix(scored: DataFrame) -> DataFrame:
    """All nine cells, zero where nothing fell."""
    counts = scored.where(_valid()).groupBy("label", "predicted").agg(F.count("*").alias("n"))
    return _cells(scored.sparkSession).join(counts, ["label", "predicted"], "left").select(
        "label", "predicted", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def confusion_wide(scored: DataFrame) -> DataFrame:
    return confusion_matrix(scored).groupBy("label").pivot("predicted", K.TIERS).agg(F.sum("n"))


def class_metrics(scored: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per tier; an undefined ratio is zero."""
    # each cell counts once as a row and once as a column of the matrix
    sides = confusion_matrix(scored).select(F.explode(F.array(
        F.struct(F.col("label").alias("tier"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("guessed"),
                 F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0).alias("right")),
        F.struct(F.col("predicted").alias("tier"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("guessed"),
                 F.lit(0).cast("long").alias("right")),
    )).alias("s")).select("s.*")
    sums = sides.groupBy("tier").agg(F.sum("actual").alias("support"), F.sum("guessed").alias("_guessed"), F.sum("right").alias("_right"))
    rates = sums.withColumn("_p", ratio(F.col("_right"), F.col("_guessed"))).withColumn("_r", ratio(F.col("_right"), F.col("support")))
    return rates.select(
        "tier", F.round("_p", 6).alias("precision"), F.round("_r", 6).alias("recall"),
        F.round(ratio(F.col("_p") * F.col("_r") * 2, F.col("_p") + F.col("_r")), 6).alias("f1"), "support")


def accuracy_gate(scored: DataFrame, target: float = K.ACCURACY_TARGET) -> DataFrame:
    counts = scored.where(_valid()).agg(F.count_if(F.col("label") == F.col("predicted")).alias("correct"), F.count("*").alias("total"))
    accuracy = ratio(F.col("correct"), F.col("total"))
    return counts.select(F.round(accuracy, 6).alias("accuracy"), "correct", "total",
                         (accuracy >= target).alias("passed"), F.lit(target).alias("target_accuracy"))


def leaks(questions: DataFrame, examples: DataFrame) -> DataFrame:
    """Questions that are also example questions, ignoring case and outer blanks."""
    def key(column: str):
        return F.lower(F.trim(F.col(column)))

    return questions.join(
        examples.select(key("utterance").alias("_key")).distinct(), key("question") == F.col("_key"), "left_semi")


def result_document(scored: DataFrame) -> DataFrame:
    """One nested row: headline, class metrics, matrix.

    Every part has at most nine rows.
    """
    metrics = class_metrics(scored).agg(
        F.sort_array(F.collect_list(F.struct("tier", "precision", "recall", "f1", "support"))).alias("per_class"))
    matrix = confusion_matrix(scored).agg(
        F.sort_array(F.collect_list(F.struct("label", "predicted", "n"))).alias("confusion"))
    return accuracy_gate(scored).withColumn("per_class", metrics.scalar()).withColumn("confusion", matrix.scalar())
