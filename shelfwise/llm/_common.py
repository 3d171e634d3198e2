"""What the operators of this subpackage share: table access, lineage cuts, text helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.session import ensure_checkpoint_dir, settled

__all__ = ["ascii_lower", "ensure_checkpoint_dir", "release", "settled", "slices", "stored", "table", "unit_interval", "unused", "word_count"]

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()

#: A word is a run of characters other than ASCII white space.
WORD_SEPARATORS = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, stem: str) -> str:
    """A column name that `df` doesn't have, whatever the case of its letters."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows, written as compressed Parquet to the shared checkpoint folder and read again; for what is large."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Has the driver collect its garbage, upon which Spark deletes the shuffle files of frames that are gone."""
    spark.sparkContext._jvm.System.gc()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few rows, so that their Python objects are few at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def word_count(text: Column) -> Column:
    """Number of words, as long; null and white space only give 0."""
    parts = F.split(F.coalesce(text, F.lit("")), WORD_SEPARATORS, -1)
    edges = F.when(F.element_at(parts, 1) == "", 1).otherwise(0) + F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return (F.size(parts) - edges).cast("long")


def unit_interval(key: Column, seed: int) -> Column:
    """A number in [0, 1) drawn from the key: 52 bits of its MD5 with the seed in front."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(2**52))
