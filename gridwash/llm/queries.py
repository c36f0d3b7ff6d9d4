"""The registered queries of the operators: opN_<name>(spark, sf_dir), whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridwash.llm import (
    bilinear, clusters, fingerprints, licenses, minhash, mixing, neighbours, periods, phrases, quality, repeats, token_counts,
    transcripts,
)
from gridwash.llm.tables import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op4_mix_sources", mixing.ORACLE_SQL)
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


@query("op6_benchmark_phrases")
def op6_benchmark_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrases.find_phrases(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=phrases.NEAR)
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near").cast("long").alias("n_near"),
    )


@query("op10_near_duplicates")
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


@query("op7_repeated_strings")
def op7_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.repeats_and_passages(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages"
    )


@query("op9_bilinear_scores")
def op9_bilinear_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bilinear.score_texts(table(spark, sf_dir, "documents"))


@query("op2_quality_classifier")
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "held_out", "score", "predicted")


@query("op3_nearest_vectors")
def op3_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


@query("op1_token_histogram")
def op1_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        vocabulary = file.read()
    return token_counts.token_histogram(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)


@query("op8_license_scan")
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    names = F.transform("licenses", lambda x: x["name"])
    best = F.array_max(F.transform("licenses", lambda x: x["score"]))
    return found.select(
        "doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"),
        F.coalesce(best, F.lit(0.0)).alias("best_score"), F.array_min(F.transform("licenses", lambda x: x["line"])).alias("first_line"),
    )


@query("op5_chat_transcripts")
def op5_chat_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = stored(transcripts.raw_transcripts(table(spark, sf_dir, "conversations")), "transcripts")
    found = transcripts.parse(raw, transcripts.fit(raw))
    return found.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["role"]), ",").alias("roles"), "rendered",
    )


@query("op11_centroid_clusters", clusters.ORACLE_SQL)
def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(table(spark, sf_dir, "embeddings"))


@query("op12_document_fingerprints")
def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


@query("op13_periodic_runs", periods.ORACLE_SQL)
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.collapse_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), plant=True)
    place = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    found = found.withColumn("best", F.array_max(place))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    length, period = F.col("best.length"), -F.col("best.period")
    return found.select(
        F.col("row.doc_id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
        length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
