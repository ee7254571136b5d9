"""A training corpus from `documents`: five stages, each written as Parquet and read again for the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from keyflow.llm import common, line_quality, packing, simhash, source_mix, toxicity_fm
from keyflow.llm.token_prefix import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the factorization machine doesn't call toxic; it learns from all labels that it may see."""
    labels = common.table(spark, sf_dir, "labels").where(~common.crc_is("doc_id", 3, 1))
    return toxicity_fm.not_toxic(docs, toxicity_fm.fit(docs, labels))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither fail the base rules nor lose most of their words to lines that their host repeats."""
    return line_quality.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the smallest doc_id, null last."""
    return simhash.one_row_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return source_mix.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packing.pack_documents(docs, vocabulary())


STAGES = [("toxicity", drop_toxic), ("quality rules", quality_rules), ("near dedup", near_dedup), ("source mix", mix_sources), ("packing", pack)]
#: Learning, tokenizing and packing can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    base = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
