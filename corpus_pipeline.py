"""The corpus pipeline: quality, toxicity, near-duplicates, packing.

Each stage takes the documents its predecessor kept; all but the last return
the columns of ``documents``.

Defined cases: null text is empty text (scored as such, linked with nothing,
packed as the end id); without labels of both kinds the quality stage gives
every document the labels' mean, 0.5 without labels, which is under its
threshold, and the toxicity stage uses its built-in weights; rows that repeat
an id are scored each, are one document to the near-duplicate stage and are
packed each; a null id is kept by it; equal texts have equal scores; very long
texts are read whole; empty tables give no rows; other columns pass through
all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrail.llm import quality, toxicity
from kinetrail.llm.common import dispose, documents, fold, stored, tokenizer_path
from kinetrail.llm.near_dedup import drop_near_duplicates
from kinetrail.llm.packing import pack_documents

QUALITY_LEAST, TOXICITY_MOST, SIMILARITY = 0.7, 0.3, 80


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold(F.col("doc_id"), 4) != 2)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, _labels(spark, sf_dir))
    return docs.where(quality.score_column(docs, model, docs["text"]) >= QUALITY_LEAST)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, _labels(spark, sf_dir))
    return docs.where(quality.score_column(docs, model, docs["text"]) < TOXICITY_MOST)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs, SIMILARITY)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), cache=200_000)  # beside what earlier stages hold


STAGES = [("quality", keep_quality), ("toxicity", drop_toxic), ("near_dedup", near_dedup), ("packing", pack)]
#: Fitted classifiers cannot be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES[:-1]):
        kept = stored(stage(spark, docs, sf_dir), name)
        if i:
            dispose(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
