"""Text to unit vector with Spark ML: hashed words and word pairs."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import HashingTF, NGram, Normalizer, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

WORD_FEATURES = 128
PAIR_FEATURES = 128


def embed_text(df: DataFrame, column: str, output: str = "embedding") -> DataFrame:
    """Add a unit vector of the whole text; a text without words gets the zero vector."""
    folded = df.withColumn("_text", F.lower(F.coalesce(column, F.lit(""))))
    stages = [
        RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"(?U)\W+"),
        NGram(n=2, inputCol="_words", outputCol="_pairs"),
        HashingTF(numFeatures=WORD_FEATURES, inputCol="_words", outputCol="_word_counts"),
        HashingTF(numFeatures=PAIR_FEATURES, inputCol="_pairs", outputCol="_pair_counts"),
        VectorAssembler(inputCols=["_word_counts", "_pair_counts"], outputCol="_counts"),
        Normalizer(p=2.0, inputCol="_counts", outputCol="_unit"),
    ]
    model = Pipeline(stages=stages).fit(folded)
    made = model.transform(folded).withColumn(output, vector_to_array("_unit"))
    return made.select(*df.columns, output)


def embed_with(df: DataFrame, column: str, load: Callable, output: str = "embedding") -> DataFrame:
    """The same with any other encoder: ``load()`` runs once per worker and returns a function
    from a list of texts to a list of vectors."""

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load()
        for texts in batches:
            yield pd.Series([list(map(float, v)) for v in encoder(texts.fillna("").tolist())])

    return df.withColumn(output, encode(column))
