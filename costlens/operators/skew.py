"""Joins that stay even when one key holds most rows."""

from pyspark.sql import DataFrame, functions as F

SALTS = 16


def salted_join(many: DataFrame, few: DataFrame, keys: list[str], row_id: str, how: str = "inner") -> DataFrame:
    """Join where ``many`` may repeat a key any number of times and ``few`` has it once.

    The rows of a key are dealt to SALTS sub-keys by their ``row_id``; each row of ``few`` is
    copied to all of them.
    """
    dealt = many.withColumn("_salt", F.pmod(F.xxhash64(row_id), F.lit(SALTS)).cast("int"))
    copied = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copied, [*keys, "_salt"], how).drop("_salt")
