"""The corpus pipeline: quality, exact copies, near copies, mixing, tokens.

`STAGES` lists (name, function); each function takes (spark, docs, sf_dir) and returns a frame that
is written as Parquet and read again as the next one's docs.  All but the last return the columns of
documents.  `run` applies them to the documents of a folder.

In every stage a null text counts as empty, and texts may be of any length; an empty table gives an
empty result; rows that repeat are judged alike; further columns, whatever their names, are carried
along by all stages but the last.  What else a stage defines is in its docstring.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm import bpe, exact_dedup, mixing, quality, simhash
from shelfwise.llm._common import ensure_checkpoint_dir, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps.

    A text without words weighs nothing and is drawn like any other; of ties at the threshold all
    stay.  Without labels every document stays.
    """
    return quality.Sampler(docs, table(spark, sf_dir, "labels")).kept(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest doc_id; a null doc_id loses to any other.

    Texts without a character, null included, are equal.  Of rows that repeat one stays.
    """
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id.

    Texts without a word are copies of each other.  Rows without a doc_id stay.  Of rows that repeat
    one stays.
    """
    return simhash.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as its source's rate gives, none at all or twice included.

    A null source is a source of its own; one without words takes no copies.  Rows of one doc_id
    draw alike, and rows without one draw as the word null.
    """
    return mixing.mix(docs)


def count_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix, a row for each copy.

    A text without words has no tokens; a null doc_id is carried along.
    """
    return bpe.digests(docs, bpe.vocabulary())


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_exact_copies),
    ("simhash near-dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("bpe tokens", count_tokens),
]

#: The SimHash graph and the BPE merges are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of `sf_dir`; stages meet in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{number}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{number}")
    return docs
