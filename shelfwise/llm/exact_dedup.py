"""Exact deduplication by a heavy-hitter split, in DataFrame operations only.

1. Every text becomes a digest; the digests are written once and read again by what follows.
2. A Misra-Gries summary (Spark's frequent-items sketch, merged over a two-level tree) proposes
   digests that may be frequent.  Its size is fixed, whatever the input.
3. Exact counts over the proposed digests verify the proposals; partial aggregation reduces each
   to a row a task.  The verified winners, at most `HEAVY_LIMIT` of them, are broadcast, and
   their rows are settled on the map side without a shuffle.
4. The remaining digests are shuffled the ordinary way; none of them is a heavy hitter.

Whatever the summary misses takes the ordinary way too, so the result never depends on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.llm._common import ascii_lower, settled, table, unused

#: Counters kept by a summary; frequencies above about 3.5 / TRACKED of the rows cannot be missed.
TRACKED = 8192
#: Most digests that are broadcast; each is a row of under 200 bytes.
HEAVY_LIMIT = 512
#: Groups below this size are left to the shuffle.
HEAVY_ROWS = 32
#: Summaries are merged in so many groups before the last merge.
MERGE_FAN = 64


def text_digest(text: Column) -> Column:
    """SHA-256 of the text with A-Z lower-cased, as lowercase hex; null counts as empty."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256)


def frequent_digests(keyed: DataFrame) -> DataFrame:
    """Misra-Gries: at most `HEAVY_LIMIT` candidate hashes, as a one-column frame `h`."""
    leaves = keyed.groupBy((F.spark_partition_id() % MERGE_FAN).alias("leaf")).agg(F.expr(f"approx_top_k_accumulate(xxhash64(digest), {TRACKED})").alias("summary"))
    merged = leaves.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_combine(summary, {TRACKED})").alias("summary"))
    items = merged.select(F.expr(f"approx_top_k_estimate(summary, {HEAVY_LIMIT})").alias("items"))
    return items.select(F.explode("items").alias("x")).where(F.col("x.count") >= HEAVY_ROWS).select(F.col("x.item").alias("h"))


def heavy_digests(keyed: DataFrame) -> DataFrame:
    """Verified winners with their exact group size and the row that stays: at most `HEAVY_LIMIT` rows."""
    candidates = frequent_digests(keyed).limit(HEAVY_LIMIT)
    counted = keyed.join(F.broadcast(candidates), F.xxhash64("digest") == F.col("h"), "left_semi").groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "rid")).alias("winner"))
    return settled(counted.where(F.col("group_size") >= HEAVY_ROWS).orderBy(F.desc("group_size"), "digest").limit(HEAVY_LIMIT))


def assign(documents: DataFrame) -> DataFrame:
    """For each row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty, so null
    and empty texts form one group.  Of equal texts the row with the largest doc_id stays; a
    null doc_id loses to any other, and of repeated rows with the same doc_id exactly one stays.
    An empty table gives an empty result; further columns of the input, whatever their names, are
    not read.
    """
    keyed = settled(documents.select("doc_id", text_digest(F.col("text")).alias("digest")).withColumn("rid", F.monotonically_increasing_id()))
    heavy = heavy_digests(keyed)
    by_map = keyed.join(F.broadcast(heavy), "digest")
    group = W.partitionBy("digest")
    by_shuffle = keyed.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").select(
        "digest", "doc_id", "rid", F.count(F.lit(1)).over(group).alias("group_size"), F.max(F.struct("doc_id", "rid")).over(group).alias("winner")
    )
    return by_map.select("digest", "doc_id", "rid", "group_size", "winner").unionByName(by_shuffle).select(
        "doc_id", F.col("winner.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("winner.rid")).alias("kept"), F.col("digest").alias("text_sha256")
    )


def deduplicate(documents: DataFrame) -> DataFrame:
    """The rows that `assign` keeps, with all their columns.

    A heavy text's rows are reduced on the map side to those that carry the doc_id that stays; the
    others meet by digest, and one of each group is taken.  Null texts count as empty, a null doc_id
    loses to any other, and of repeated rows one stays; an empty table gives an empty result, and
    further columns, whatever their names, are carried along unchanged.
    """
    digest, heavy_id, place = (unused(documents, n) for n in ("text_digest", "heavy_id", "place_in_group"))
    full = documents.withColumn(digest, text_digest(F.col("text")))
    keyed = settled(full.select("doc_id", F.col(digest).alias("digest")).withColumn("rid", F.monotonically_increasing_id()))
    heavy = heavy_digests(keyed).select(F.col("digest").alias(digest), F.struct(F.col("winner.doc_id").alias("id")).alias(heavy_id))
    marked = full.join(F.broadcast(heavy), digest, "left")
    left = marked.where(F.col(heavy_id).isNull() | F.col("doc_id").eqNullSafe(F.col(f"{heavy_id}.id")))
    first = F.row_number().over(W.partitionBy(digest).orderBy(F.desc_nulls_last("doc_id")))
    return left.withColumn(place, first).where(F.col(place) == 1).select(*documents.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH keyed AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM keyed
"""
