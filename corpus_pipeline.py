"""The corpus pipeline: toxic documents go, copies and near copies go, personal data is masked, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet before the
next stage reads it; run() does the same in memory-bounded steps through the checkpoint folder.

In all stages a null text counts as an empty one, texts may be of any length, ``docs`` may be empty
and may have more columns than documents has, of any names; all stages but the last return the columns
of ``docs``. What becomes of repeated rows and of rows without a doc_id is said at each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm import exact_dedup, minhash, packing, pii, toxicity
from panelweave.llm.common import cut, table
from panelweave.llm.queries import WORD_BPE

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the toxicity grammar scores at 0.5 and more.

    Each row is judged by its own text alone, also repeated ones and those without a doc_id; null and
    empty texts have no evidence and stay. Without labels the fixed word lists and weights hold.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"), threshold=0.5)


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for white space, keep the one with the least id.

    Null and empty texts are equal. Rows that share an id and a text are one row; a row without an id
    stays only where no equal one has an id, and then once.
    """
    return exact_dedup.drop_exact_copies(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 0.8 and more on five-word shingles join, keep the one with the least id.

    Texts without words and rows without an id have no near copies and stay; rows that share an id stay
    or go together.
    """
    return minhash.drop_near_copies(docs, width=5, percent=80)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data and the terms that disclose it; n_chars, where there is one, is the new length.

    No row goes. Null and empty texts stay as they are; rows that share an id and a text change alike.
    """
    masked = pii.redact_personal_data(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the documents' tokens into sequences of 2048; ids are little-endian 32-bit.

    Null and empty texts are an end id alone. Each row is a document of its own, also a repeated one or
    one without an id.
    """
    return packing.pack(docs, WORD_BPE, length=2048, end_id=1)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", remove_toxic),
    ("exact_dedup", remove_copies),
    ("minhash_near_dedup", remove_near_copies),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

#: Learned scores, shingle links and tokens have no SQL form; a test holds each stage and run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the pieces of packed sequences. An empty table gives none."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
