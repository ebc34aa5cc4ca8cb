"""The corpus pipeline: language, quality, near duplicates, mix, pack.

Every stage takes (spark, docs, sf_dir) and calls one of the operators of
``siltstone.llm``; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import langid, mixing, packing, quality, simhash
from siltstone.llm.common import held_out, new_path
from siltstone.llm.queries import tokenizer_paths


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose text is in none of the learned languages."""
    model = langid.train(docs.where(~held_out(F.col("doc_id"), 4, 2)))
    scored = langid.score_table(docs, model, docs.columns)
    return scored.where(~F.col("rejected")).select(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose calibrated quality is below the threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.score_quality(docs, labels, ~held_out(F.col("doc_id"), 4, 2), keep=docs.columns)
    return scored.where(F.col("score") >= quality.THRESHOLD).select(*docs.columns)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id in each group of near duplicates: SimHash and Golay links, verified and completed exactly."""
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents repeated by epoch, the last one cut at the budget."""
    return mixing.mixed_corpus(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return packing.pack_documents(docs, *tokenizer_paths())


STAGES = [
    ("language", known_language),
    ("quality", good_quality),
    ("near_duplicates", one_of_near_duplicates),
    ("mix", mixed),
    ("pack", packed),
]

#: The language and quality models and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written and reread as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
