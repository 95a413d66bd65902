"""The ``opN_<name>`` queries over whole tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytable.llm import decontam, fingerprint, html, licenses, mixing, ngram_join, oracle, pii, quality, secrets, warc
from keytable.llm.storage import table

#: The session setting that holds the secret of the pseudonyms.
PII_KEY = "spark.keytable.pii.key"


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels)
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id",
        *[secrets.count_of(F.col("spans"), kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(secrets.listed(base), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    n_hit = decontam.hit_words(F.col("spans"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        decontam.items_digest(F.col("items")).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_edits(table(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=85)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = pii.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), key=spark.conf.get(PII_KEY, "no secret: for these queries only"))
    return named.select("doc_id", "text", *[F.col(f"n_{k}").cast("long") for k in pii.KINDS], pii.count_all().alias("n_found"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(licenses.scan(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html": op1_html,
        "op2_warc": op2_warc,
        "op3_quality": op3_quality,
        "op4_secrets": op4_secrets,
        "op5_decontaminate": op5_decontaminate,
        "op6_fingerprint": op6_fingerprint,
        "op7_ngram_join": op7_ngram_join,
        "op8_mixing": op8_mixing,
        "op9_pii": op9_pii,
        "op10_licenses": op10_licenses,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc": oracle.OP2,
        "op4_secrets": oracle.secrets(secrets.BASE, secrets.TOKEN, secrets.ALPHABETS, secrets.OTHER, secrets.KINDS, secrets.RATE, secrets.MISSED, secrets.DECOYS, secrets.LEAST, secrets.BINS, secrets.PER_OCTAVE),
        "op5_decontaminate": oracle.OP5,
        "op7_ngram_join": oracle.OP7,
        "op8_mixing": oracle.mixing(mixing.BLOCK_WORDS, mixing.SHARD_SLOTS, "mix", mixing.ROUNDS, mixing.MOST),
        "op10_licenses": oracle.licenses(licenses.TEMPLATES, licenses.PHRASES, licenses.K, licenses.NEAR, licenses.COVER),
    }
