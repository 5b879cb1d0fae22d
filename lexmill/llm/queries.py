"""The operators as queries over the given tables: whole tables, whole texts, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.llm import (
    audit,
    html_extract,
    licenses,
    lines,
    manifest,
    mixing,
    neighbours,
    packing,
    sharding,
    simhash,
    sketches,
    substrings,
    toxicity,
)
from lexmill.llm.shared import table

Query = Callable[[SparkSession, str], DataFrame]


def html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return html_extract.extract(table(spark, sf, "pages"))


def document_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return sketches.fingerprint_neighbours(table(spark, sf, "documents"))


def best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"))


def simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    hexadecimal = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select("doc_id", hexadecimal.alias("fingerprint"), "component_id")


def toxicity_scores(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


def license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(table(spark, sf, "documents"))


def nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf, "embeddings"))


def substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.removals(table(spark, sf, "documents")).drop("row_key")


def source_mixing(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf, "documents"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mixed.select("row.doc_id", "size", "source_size", "target", taken)


def sharding_slots(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf, "documents"))


def line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    left = lines.dedup_lines(table(spark, sf, "documents"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return audit.interactions(table(spark, sf, "documents"), table(spark, sf, "labels"))


def merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.tamper_check(table(spark, sf, "documents"))


QUERIES: dict[str, Query] = {
    "op1_html_extraction": html_extraction,
    "op2_document_fingerprints": document_fingerprints,
    "op3_best_fit_packing": best_fit_packing,
    "op4_simhash_near_dedup": simhash_near_dedup,
    "op5_toxicity": toxicity_scores,
    "op6_license_scan": license_scan,
    "op7_nearest_neighbours": nearest_neighbours,
    "op8_substring_dedup": substring_dedup,
    "op9_source_mixing": source_mixing,
    "op10_sharding": sharding_slots,
    "op11_line_dedup": line_dedup,
    "op12_filter_audit": filter_audit,
    "op13_merkle_manifest": merkle_manifest,
}
