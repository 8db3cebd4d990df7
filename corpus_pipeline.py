"""A training corpus from `documents`: each stage is written as Parquet and read again by the next.

The stages' outputs stay in the shared folder; what a stage has stored on its way is deleted when its output is there.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.frames import stored_alone
from tickloom.llm.languages import document_evidence, identify_languages
from tickloom.llm.leaks import find_leaks
from tickloom.llm.lines import dedup_lines
from tickloom.llm.mixing import mixed_documents
from tickloom.llm.nearcopies import keep_one_copy
from tickloom.llm.queries import language_model, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; the others go."""
    found = identify_languages(docs, document_evidence(docs), language_model(docs))
    return found.where("accepted").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without its common lines; n_chars follows the text. Null text becomes the empty text."""
    found = dedup_lines(docs).withColumns({"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")})
    return found.select(*(c if c in ("text", "n_chars") else F.col("row")[c].alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-copies, that with the smallest id."""
    return keep_one_copy(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    return find_leaks(docs, table(spark, sf_dir, "benchmark")).where("NOT contaminated").select("row.*")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents copied to the sources' target weights, in a global random order."""
    return mixed_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]

#: SQL can express neither the fitted language model nor the search for near-copies.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored_alone(spark, partial(stage, spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
