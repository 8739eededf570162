"""Corpus pipeline: language ID, line dedup, near-dedup, decontamination and encoding of documents.

Each stage takes (spark, docs, sf_dir); ``run`` writes its result to the shared folder as Parquet and
gives what it reads back to the next. All but the last return the columns of documents.

Stages need doc_id and text (the first also lang; a table without it is an error) and keep all other columns as they are, whatever their names; the last adds
its own, which replace columns of their names. Null texts go in the first stage, as do empty ones; ties, repeated rows,
long texts and empty tables are treated as each stage's operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, language_id, line_dedup, piece_bpe, simhash
from ledgerloom.llm.common import materialize, table
from ledgerloom.llm.queries import piece_model


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; the model is fitted on the labelled rows outside the held-out fold."""
    return language_id.accepted(docs, language_id.fit_unheld(docs))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the blocks that an earlier document has; documents that lose every line go. n_chars, where docs have it, follows the text."""
    return line_dedup.cleaned(docs, size_col="n_chars" if "n_chars" in docs.columns else None)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles with a similarity of 0.8 or more."""
    return simhash.keep_similar(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their piece ids, their number, and digests of ids and decoded text."""
    return piece_bpe.encode_documents(docs, piece_model())


STAGES = [
    ("language_id", identify),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_copies),
    ("decontamination", drop_leaks),
    ("sentencepiece", encode),
]

#: SQL has no XXH64, patience diff, centroid model or piece encoder; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
