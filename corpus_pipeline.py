"""Corpus pipeline: quality rules, near-dedup, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's ``docs``. All but the last return the columns of
documents. Rejected, near-duplicate and contaminated documents go; mixing repeats documents
of light sources and drops none, since its budget takes every source once; the last stage
writes and reads back token files and returns their index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import table
from tidemark.llm.decontaminate import clean_documents
from tidemark.llm.mixing import mixed_documents, scattered
from tidemark.llm.quality import fit_references, passing_documents
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.similar import one_of_each_similar
from tidemark.llm.token_output import token_table
from tidemark.session import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: rows that fail the base rules or diverge from every language go."""
    return passing_documents(docs, fit_references(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3, widened to a five-word similarity of 0.8 or more: the row with the smallest doc_id of each group stays."""
    return one_of_each_similar(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: rows in which a benchmark window occurs go."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: rows as often as the tempered weights take them, each at least once."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: token files in the mixture's order, copies of a document apart; their index."""
    return token_table(docs, tokenizer_path(), end_id=2, order=scattered(docs))


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", tokens),
]

#: The sketches, the references and the tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage")
    return docs
