"""The corpus pipeline: five stages over ``documents``, each calling one operator.

Every stage but the last returns the columns of ``documents``. A stage's output is written as
Parquet and read again as the next stage's input.

Defined cases, the same in every stage: a null text counts as empty (line dedup returns it as
an empty text), a null doc_id as the smallest id, rows that share id and text are one document
and stay or go together, extra columns of any name pass through, texts are taken whole, and an
empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import lines, minhash, packing, secrets, toxicity
from lodestone.llm.common import packed, staged
from lodestone.llm.queries import WORD_VOCAB, table


def _sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns, ``n_chars`` counted anew."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("long"))
    return docs.select(*columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(packed(docs, F.col("text")), model).where("score < 0.5").select("row.*")


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more hold stay in one of them."""
    return _sized(lines.drop_lines(docs, lines.keep_bitmaps(docs), out=None), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return minhash.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to the name of their kind."""
    return _sized(secrets.redact(docs), docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become pieces of windows of 2048 tokens."""
    return packing.pack(docs, WORD_VOCAB)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("near_dedup", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("packing", pack_windows),
]

#: A learned score and a tokenizer can't be said in SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
