"""Documents to packed training sequences: stages, each an operator of tidebar.llm.

A stage gets what its predecessor kept, with the columns of ``documents``, and its decisions
take effect. Empty tables give empty results; further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm import jaccard, ordinal, packing, pii, rules
from tidebar.llm.queries import PII_KEY, WORD_BPE, grades
from tidebar.session import scratch_folder


def good_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose votes of quality rules speak for them."""
    return rules.kept(docs)


def good_by_grade(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that reach the top grade with a probability of three quarters, learned from ``labels``."""
    known = grades(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return ordinal.selected(docs, ordinal.fit(docs, known, levels=3), levels=3)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of least id."""
    return jaccard.distinct(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates; ``n_chars`` follows the text."""
    new = pii.replaced(docs, PII_KEY)
    if "n_chars" in new.columns:
        new = new.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return new


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    pieces = packing.pack(docs, WORD_BPE, end_id=1, window=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality rules", good_by_rules),
    ("quality classifier", good_by_grade),
    ("near-duplicates", distinct),
    ("personal data", without_personal_data),
    ("packing", packed),
]

#: The classifier's training, minhash runs, keyed surrogates and packing have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
