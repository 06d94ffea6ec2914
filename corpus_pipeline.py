"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, token-ID output.

Each stage reads what its predecessor wrote, all of it. All but the last keep the columns of ``documents``, and further columns of any name.

Every stage takes an empty table and gives one. Ids may be null or repeat: each row is judged by its own text, so rows that share an id may part ways
(near_dedup prefers rows with an id; mixing reads them together; token output puts null ids first and orders rows of one id by text). Null, empty and
letterless texts go with language_id, as unrecognised. Repeated rows are near-duplicates, of which one stays. A null source is the source "".
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiquarry.llm import decontam, langid, mixing, simhash, tokenbin
from lexiquarry.session import free_shuffles, materialise


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose language is not recognised, null and letterless texts among them; a table without labels to learn from recognises none."""
    return langid.keep_identified(docs, langid.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: the row with the smallest id; one without an id only if its group has no other. Rows are judged one by one, whatever ids they share."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold an item of the benchmark."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mixture reads a document."""
    return mixing.mix(docs, places=False)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token ids, and return each document's place in the files, read back from them."""
    return tokenbin.token_binary(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("token_output", token_output),
]

#: Training, random walks and entropy coding are beyond SQL; tests hold the result against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    free_shuffles(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
