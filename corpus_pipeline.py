"""A corpus pipeline of five stages; each is written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import bpe, decontaminate, jaccard, linededup, quality
from folioscope.llm.common import fresh, named, shared_folder, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go."""
    models = quality.train(docs, table(spark, sf_dir, "labels"))
    out = quality.score(docs, models)
    return out.where(named(out.columns[-1])).select(*map(named, docs.columns))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: recurring templates stay in their first document; a document with no other line that is not blank goes."""
    out = linededup.dedup_lines(docs)
    left = (named(out.columns[-1]) == 0) | F.coalesce(F.col("text").rlike(r"\S"), F.lit(True))
    return out.where(left).withColumn("n_chars", F.length("text").cast("long")).select(*map(named, docs.columns))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: the smallest id of each component stays."""
    classes = jaccard.jaccard_components(docs, width=5, percent=80)
    (own,) = fresh(docs, "gone")
    gone = classes.where("component_id <> doc_id").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(gone, F.col("doc_id") == named(own), "left_anti").select(*map(named, docs.columns))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that contain a test item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*map(named, docs.columns))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: ids and their number."""
    (count,) = fresh(docs, "n_tokens")
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.withColumn(count, F.size(named(coded.columns[-1])).cast("long"))


STAGES = [("quality", keep_good), ("line_dedup", drop_lines), ("jaccard", one_of_each), ("decontaminate", keep_clean), ("bpe", tokenise)]

#: The classifier and the tokeniser have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
