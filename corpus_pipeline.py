"""A corpus from raw documents to packed sequences, one operator a stage.

run() applies the stages to the table documents of a folder; each stage's rows are written to the shared folder and read again
by the next. Every stage but the last returns the columns of documents, whatever further columns those have. In all stages
null and empty texts are documents without words, whole texts count however long they are, and an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seriesloom.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from seriesloom.llm.shared import shared_dir, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model finds toxic go; the model learns from those of docs that labels covers.

    Null and empty texts stay, as does everything where labels has not both kinds; rows that repeat are judged alike, and null ids
    have no label. A probability of exactly one half is toxic.
    """
    return toxicity.drop_toxic(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text the one with the smallest doc_id stays; null ids come last, null text equals empty text, and
    of rows that repeat both exactly one stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shared word shingles (five words, a Jaccard similarity of 0.8) the smallest doc_id stays, null ids last.

    Documents without words link with nothing and stay; rows that repeat identifier and text stay or go together.
    """
    return ngram_join.keep_one(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, up to three times; a null source is one of its own.

    Documents of equal size are put in order by a hash of their id; rows that repeat share their copies out in turn.
    """
    return mixing.take_copies(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids and their places in sequences; a document without text is its end token, rows that repeat are packed each."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The first and last stages hold a fitted model and a tokeniser, which SQL can't express; tests compare run() with brute force.
ORACLE_SQL: str | None = None


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's folder goes once its successor has been written; that of the last but one stays for the result."""
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            _remove(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pipeline": run}
