"""Corpus pipeline: five stages, each over all documents the one before it kept.

Every stage function takes (spark, docs, sf_dir); its result is written as Parquet and
read again as the next one's docs. All stages but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridwash.llm import minhash, mixing, phrases, quality, repeats
from gridwash.session import drop_scratch, scratch_path, scratch_tables


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return minhash.drop_near_duplicates(docs)


#: Passages of more words than 50 are cut. In bytes, strings of this length make them up:
#: 51 words of prose have some 250 to 340 bytes, hardly ever below this.
PASSAGE_WORDS, PASSAGE_BYTES = 51, 200


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that occur again go from the texts; n_chars follows."""
    out = repeats.remove_repeats(docs, length=PASSAGE_BYTES, least_words=PASSAGE_WORDS)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return out.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return phrases.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the words that the mix takes from each."""
    return mixing.mix_sources(docs)


STAGES = [
    ("quality classifier", drop_low_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix),
]

#: Trained models and byte-level cuts have no SQL twin; tests/llm compares with plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; of the tables written on the way the last one stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    keep = scratch_tables(spark)
    for _, stage in STAGES:
        path = scratch_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        drop_scratch(spark, [*keep, path])
    return docs
