"""From raw documents to token ids: quality rules, line dedup, near-dedup, source mix, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result to the shared folder as Parquet and
reads it back as the next stage's documents. All stages but the last return the columns they were given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ovenplan.llm import line_dedup, mixing, near_dups, pieces, quality_rules
from ovenplan.llm.common import settled, table
from ovenplan.llm.queries import ORACLE, vocabulary
from ovenplan.llm.queries import QUERIES as OPERATORS


def _like(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """``changed`` with the columns of ``docs``; a count of characters follows a text that was cut."""
    if {"n_chars", "text"} <= set(docs.columns):
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the fences of their language and source reject go."""
    return quality_rules.judge(docs).filter("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten or more documents go; the document stays."""
    return _like(docs, line_dedup.drop_shared_lines(docs, min_docs=10, min_chars=1))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that with the smallest id."""
    return near_dups.one_per_class(docs, similarity=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in training order."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids instead of the text, and whether decoding gives the text back."""
    encoded = pieces.encode_texts(docs, vocabulary("piece_bpe_32k.model"))
    text = F.coalesce(F.col("text"), F.lit(""))
    return encoded.withColumns({"n_tokens": F.size("ids").cast("long"), "round_trip": F.col("decoded") == text}).drop("text", "decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near dedup", near),
    ("source mix", mix),
    ("encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


# Order MinHash, banded alignment and SentencePiece have no SQL; tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None

QUERIES = {**OPERATORS, "pipeline": run}
SQL = dict(ORACLE)
