"""From raw documents to packed training sequences: five stages, each written before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


from rillspark.llm import bpe, decontaminate, near_dup, packing, pii, quality
from rillspark.session import removed, tables_so_far, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the cascade."""
    return quality.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near copies."""
    groups = near_dup.near_components(docs, size=5)
    return docs.join(groups.where("not kept").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with the benchmark; each row is judged by its own text, whatever its id."""
    keyed = docs.withColumn("__row", decontaminate.row_key())
    found = decontaminate.hits(keyed.select("__row", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "__row")
    return keyed.join(found.select("__row").distinct(), "__row", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data replaced by its kind."""
    return pii.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of binary length with their sequence numbers."""
    return packing.packed(docs, bpe.default_path())


STAGES = [
    ("quality", quality_rules),
    ("near_dup", near_duplicates),
    ("decontaminate", decontamination),
    ("pii", personal_data),
    ("packing", packed),
]

#: Hashed shingle groups, a trained tagger and a tokenizer: not for SQL; tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each stage's rows written and read again; only the last table stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = tables_so_far()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        # this stage's table is whole: neither what the stage wrote on its way nor the one before it is read again
        removed(spark, before, keep_last=True)
    return docs
