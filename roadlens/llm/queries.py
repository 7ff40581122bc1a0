"""The registered queries of this package: each applies one operator to its whole table. An empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roadlens.llm import base_sql, decontaminate, langid, packing, pii, quality, secrets, simhash, substrings, vectors, warc
from roadlens.llm.common import table


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of every document by the benchmark; nulls, odd texts and repeats as in ``decontaminate.contamination``."""
    return decontaminate.op6(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; nulls, odd texts and repeats as in ``langid.identify``."""
    return langid.op1(table(spark, sf_dir, "documents"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document; nulls, odd texts and repeats as in ``pii.personal_data``."""
    return pii.op4(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; nulls, odd texts and repeats as in ``simhash.near_duplicates``."""
    return simhash.op5(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document; nulls, odd texts and repeats as in ``secrets.secrets``."""
    return secrets.op9(table(spark, sf_dir, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector; nulls, odd vectors and repeats as in ``vectors.near_duplicates``."""
    return vectors.op2(table(spark, sf_dir, "embeddings"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of all documents; nulls, odd texts and repeats as in ``substrings.repeats``."""
    return substrings.op3(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in its sequence; nulls, odd texts and repeats as in ``packing.pack``."""
    return packing.op7(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; nulls, odd texts, repeats and odd labels as in ``quality.score`` and ``quality.rules_of``."""
    return quality.op8(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, archived and read back; nulls, odd payloads and repeats as in ``warc.write_archives``."""
    return warc.op10(table(spark, sf_dir, "pages"))


def personal_data_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of ``op4_personal_data``: all but the spans that the method adds."""
    return op4_personal_data(spark, sf_dir).drop("spans")


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of ``op9_secrets``: all but the spans that the method adds."""
    return op9_secrets(spark, sf_dir).drop("spans")


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_embedding_near_dedup,
        op3_substring_dedup,
        op4_personal_data,
        op5_simhash,
        op6_benchmark_decontamination,
        op7_packing,
        op8_quality,
        op9_secrets,
        op10_warc,
        personal_data_base,
        secrets_base,
    )
}
#: SQL tells neither learned models, XXH64, zstandard nor tokens; tests hold the others against brute force, and SQL
#: tells the base spans of personal data and secrets.
SQL = {
    "op2_embedding_near_dedup": vectors.OP2_SQL,
    "op6_benchmark_decontamination": decontaminate.OP6_SQL,
    "op10_warc": warc.OP10_SQL,
    "personal_data_base": base_sql.PERSONAL_DATA_BASE,
    "secrets_base": base_sql.SECRETS_BASE,
}
