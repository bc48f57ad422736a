"""A corpus pipeline of five of the text operators. Each stage works on all that the one before it kept.

Defined cases, for every stage: extra columns, whatever their names, are kept (the last stage returns ids and decoded texts instead); an empty table gives an
empty table; rows that repeat are judged each by itself, but of equal and near-equal texts, and of rows that share an id, one stays after the near-duplicates stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reciprospark.llm import decontaminate, minhash, rules, spm, toxicity
from reciprospark.llm.storage import shared_dir

#: No SQL: the toxicity model, the MinHash components and the tokenizer have none.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null, empty and short texts too."""
    return rules.keep_good(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the model learns from the labels of four fifths of the ids. Null and empty texts stay, and all do without labels of both kinds."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fitted(docs, labels, trains=lambda i: F.crc32(i.cast("string").cast("binary")) % 5 != 0)
    return toxicity.drop_toxic(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the least id; a link is a similarity of 0.8 or more. Rows without a text or an id stay."""
    return minhash.drop_copies(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts stay; null and empty items are passed over."""
    return decontaminate.drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, decoded) of what is left; a null text has no ids and decodes to an empty one."""
    return spm.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality rules", quality), ("toxicity", toxic), ("near-duplicates", near_duplicates), ("decontamination", decontamination), ("sentencepiece", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
