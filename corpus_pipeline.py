"""A corpus pipeline: five stages from the documents table to packed training sequences.

Each stage takes all rows its predecessor kept; all but the last return the columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from costlens.llm import language, mixing, near_dedup, packing, personal_data
from costlens.session import new_dir, prepare, remove

LEAST_SCORE = 0.05


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go; the others carry the predicted one."""
    names = [language.free_name(docs, name) for name in ("held_out", "lang_pred", "score")]
    found = language.identify(docs, *names).where((F.col(names[1]) != language.UNKNOWN) & (F.col(names[2]) >= LEAST_SCORE))
    return found.withColumn("lang", F.col(names[1])).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest doc_id."""
    return near_dedup.keep_one(docs).select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become masks."""
    return personal_data.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.copies(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_languages),
    ("minhash_near_dedup", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

# Classifiers, sketches and a tokenizer are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage wrote is removed when the next one is written."""
    docs, written = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if written:
            remove(spark, written)
        written = path
    return docs
