"""A training-data pipeline: each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytable.llm import decontam, mixing, ngram_join, quality, secrets
from keytable.llm.storage import remove, scope, scratch_path, table


def _with_length(before: DataFrame, after: DataFrame) -> DataFrame:
    """n_chars of changed texts brought up to date, columns in their old order."""
    if "n_chars" in before.columns:
        after = after.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return after.select(*before.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.score(docs, model, name="__score").where(F.col("__score") >= quality.THRESHOLD).drop("__score")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id."""
    return ngram_join.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; documents of nothing else go."""
    clean = decontam.remove_contamination(docs.withColumn("__full", F.length(F.trim("text")) > 0), table(spark, sf_dir, "benchmark"))
    kept = clean.where(~F.coalesce("__full", F.lit(False)) | (F.length(F.trim("text")) > 0))
    return _with_length(docs, kept.drop("__full"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked."""
    return _with_length(docs, secrets.redact(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: blocks of text drawn from the sources to their target weights,
    each with the ids of its documents."""
    return mixing.mixed_blocks(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("mixing sources to target weights", mixing_stage),
]

#: SQL can express neither the classifier nor the similarity join.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; each result is written and read again, and what
    led to it is removed."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage{k}")
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove(spark, [before])
        before = path
    return docs
