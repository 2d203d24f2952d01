"""The corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage takes the documents that the one before it kept and returns
documents (doc_id, text, lang, source, n_chars); the last returns the pieces of
the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tentpole.llm import decontaminate, packing, quality, simhash, substring
from tentpole.llm.common import made, released, scratch_path
from tentpole.llm.queries import tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality cascade rejects go."""
    return quality.filtered(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest id stays."""
    return simhash.deduplicated(docs.select(*COLUMNS), simhash.SIMILAR)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 50 words that an earlier document has are cut; ``n_chars`` follows the text."""
    return substring.removed(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a test item go."""
    return decontaminate.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    return packing.packed(docs, tokenizer_file())


STAGES = [
    ("quality rules", rules),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("packing", sequences),
]
#: SQL has no byte-level tokenizer and no XXH64, so the rows of run() cannot be expressed in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents, each written as Parquet to the shared folder and read again.

    A stage's own intermediate tables, and the documents it began with, are
    deleted once its result is written; that of the last stays until the
    process ends. Null texts, and texts without words, go with the first stage;
    an empty table gives no pieces.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        before = made()
        path = scratch_path(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        released(before - {last}, {path})
        docs, last = spark.read.parquet(path), path
    return docs
