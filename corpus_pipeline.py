"""The corpus pipeline: from the documents table to token ids.

Each stage takes the documents that the one before has kept, reads them from the table it wrote, and applies
one operator to all of them. All stages but the last give the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import decontaminate, jaccard_join, mixing, quality_rules, shared, token_tables
from quire.sources.tables import spread


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the production policy rejects."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a Jaccard similarity of 0.8 or more."""
    return jaccard_join.deduplicate(docs, n=5, num=80)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of the benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the target weights of their sources; those of scarce sources repeat, up to three times."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of all documents, as read back."""
    return token_tables.report(docs, token_tables.public_tokenizer())


STAGES = [
    ("quality_rules", rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_free),
    ("mixing", mixed),
    ("token_tables", tokens),
]

#: Neither the order of the mix nor the tokenizer can be told in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder and read again; what a stage writes besides
    goes with its end. Documents without text go in the first stage; empty tables pass through all of them."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES[:-1]:
        path = shared.new_path(spark, f"stage-{name}")
        with shared.scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
