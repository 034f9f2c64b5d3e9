"""The queries of this subpackage: one opN_ query per operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import collocations, decontam, exactdedup, langid, license, linededup, mixing, neardup, ngramjoin, pii, sharding, suffixdedup


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op8_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(_docs(spark, sf_dir))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_dedup(_docs(spark, sf_dir))


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(_docs(spark, sf_dir), shards=8)


def op3_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.train_and_identify(_docs(spark, sf_dir))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(_docs(spark, sf_dir), shingle=1)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(_docs(spark, sf_dir))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join(_docs(spark, sf_dir)).drop("_row", "_comp")


def op7_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir)).drop("_no")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(_docs(spark, sf_dir))


def op11_near_duplicate_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("ball")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_docs(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_template_decontamination, op2_stratified_shards, op3_ppm_language, op4_line_dedup, op5_license_scan, op6_ngram_jaccard_join, op7_entropy_mix, op8_suffix_repeats, op9_exact_dedup, op10_personal_data, op11_near_duplicate_vectors, op12_collocations)}


def oracle_sql() -> dict[str, str]:
    return {"op11_near_duplicate_vectors": neardup.ORACLE, "op12_collocations": collocations.ORACLE, "op2_stratified_shards": sharding.ORACLE, "op6_ngram_jaccard_join": ngramjoin.ORACLE, "op9_exact_dedup": exactdedup.ORACLE}
