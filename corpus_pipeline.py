"""A corpus pipeline: toxicity filter, exact and near duplicates, benchmark decontamination, source mix.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the
last return the columns of ``documents``. Between stages the rows are written as Parquet to the
shared folder and read back, which also cuts the lineage.

The near-duplicate stage links documents by SimHash (5-word shingles, 2 bits of 64, the keys of op2), and beside
it by MinHash bands and exact Jaccard similarity (0.8), as most near copies are more bits apart.

SQL cannot express trained networks, fingerprints or hash permutations, so there is no SQL for the
whole; its stages are tested one by one, each operator against a plain version.

Defined results, as of the operators: null texts count as empty; a null doc_id is kept by no stage that
keeps one row of a class unless all of its class are null; repeated rows are members of their class like
any other, and rows of the id that stays all stay; extra columns pass through all stages, but for those
named as the last stage's own (tokens, weight, copies, exponent, turn, block, place, copy); an empty table
gives no rows. The last stage gives each document as often as the mix takes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logweave.llm import decontaminate, exact_dedup, mixing, near_dedup, toxicity
from logweave.llm.common import documents, materialise
from logweave.llm.queries import toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity_model(spark, docs, sf_dir), threshold=0.7)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs, near_dedup.Near(shingle=5, threshold=0.8, bits=True))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.realise(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash", drop_near_copies),
    ("decontaminate", drop_benchmark),
    ("mixing", mix_sources),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
