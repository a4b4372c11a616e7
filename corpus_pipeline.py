"""A training-corpus pipeline of five stages, each written as Parquet before the next one reads it.

``documents`` -> toxicity -> line dedup -> near-dedup -> decontamination -> packing.

Every stage but the last returns the columns of its input, whatever their names, and
takes null ids, rows that share an id, null and empty texts, and empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import cut, identity, rows_of
from graphloom.llm.decontamination import find_contamination
from graphloom.llm.line_dedup import apply_line_dedup
from graphloom.llm.near_copies import near_texts
from graphloom.llm.packing import pack_documents
from graphloom.llm.queries import WORD_TOKENIZER, tokenizer_file
from graphloom.llm.toxicity import drop_toxic

#: Chunks and words that a worker remembers while it packs: its process then runs other stages' tasks beside an executor's heap.
PACKING_MEMO = 150_000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar doesn't reject."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that other documents keep; ``n_chars`` follows the text."""
    kept = apply_line_dedup(docs, report=False)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in kept.columns else kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies: five-word shingles, similarity 0.8 or more.

    The groups are those of op5's SimHash and op12's join with these parameters (:func:`near_copies`).
    Of rows with the same id and text one stays; a group without ids keeps one row.
    """
    return rows_of(docs, near_texts(docs).select(F.col("least").alias("key")), "left_semi", once=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item; rows that share an id are judged by their own texts."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_contamination(docs.select(identity().alias("key"), "text"), benchmark, id_col="key")
    return rows_of(docs, found.select(F.col("doc_id").alias("key")), "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, in sequences of 4096 tokens."""
    return pack_documents(docs, tokenizer_file(WORD_TOKENIZER), memo=PACKING_MEMO)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: A grammar, an edit distance and a tokeniser are beyond SQL; tests compare near-dedup and decontamination with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
