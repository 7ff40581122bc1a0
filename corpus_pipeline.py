"""A corpus pipeline of five stages, each of which works on all that its predecessor kept.

Language identification drops the documents it rejects, SimHash keeps one document of each group of near
copies, decontamination drops documents in which a benchmark window occurs, personal data is masked, and what
is left is packed into sequences. All stages but the last return the columns of documents, further ones with clashing
names included; an empty table passes through all of them and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roadlens.llm import decontaminate, langid, packing, pii, simhash
from roadlens.llm.common import table, write_out


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rejected documents: null, empty and letterless texts, narrow margins, ties. Repeated rows stay or go together."""
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies stays, that of the least doc_id; null and empty texts are copies of each
    other, repeated rows one, and rows without doc_id stay."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of the benchmark occurs; null and empty texts, and repeated clean rows, stay."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind and counts n_chars anew; null and empty texts, and all rows, stay."""
    return pii.mask_personal_data(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences; a null text is a piece of the closing id."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: Compression, XXH64 fingerprints and the tokenizer are beyond SQL; a test holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each one's result written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_out(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
