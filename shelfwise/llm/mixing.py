"""Mixing sources to target weights, in DataFrame operations only.

Tokens are summed per source, targets and repetition rates follow from the sums, and each document
is emitted floor(rate) times plus one Bernoulli copy whose chance is the fraction.  The Bernoulli
draw is a hash of the doc_id and a seed, so reruns agree and no state is kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.llm._common import settled, table, unit_interval, unused, word_count

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: The mix has so many times the words of all sources.
SHARE = 1.5
#: No source is repeated more often than this.
MOST = 2.0
SEED = 17
#: Source tables up to so many rows (under 200 bytes each) are broadcast; longer ones are joined by a shuffle.
BROADCAST_SOURCES = 10_000


def targets(per_source: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds `target` and `rate` to a frame of (source, source_size), one row per source.

    The fill level is the one at which weights times level, stopped at `most` times the size, add
    up to the total share.  It is found in closed form: in order of cap over weight, a source is
    capped as long as its cap lies below the level that all from it on would share.  The frame has
    a row for each source, so the window's single partition holds a name and a sum a source.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    ranked = per_source.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    by_fill = W.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("source_size").over(by_fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_fill.rowsBetween(0, W.unboundedFollowing))
    everything = F.sum("source_size").over(W.partitionBy())
    filled = ranked.withColumn("place", F.row_number().over(by_fill)).withColumn("level", (F.lit(float(share)) * everything - F.lit(float(most)) * before) / rest)
    open_ = F.col("weight") * F.col("level") < F.lit(float(most)) * F.col("source_size")
    first_open = F.min(F.when(open_, F.struct(F.col("place"), F.col("level")))).over(W.partitionBy())
    leveled = filled.withColumn("final", first_open["level"])
    cap = F.lit(float(most)) * F.col("source_size")
    goal = F.when(F.col("final").isNull() | (F.col("weight") * F.col("final") >= cap), cap).otherwise(F.col("weight") * F.col("final"))
    return leveled.withColumn("target", goal).select("source", "source_size", "target", F.when(F.col("source_size") > 0, goal / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"))


def assign(documents: DataFrame, seed: int = SEED) -> DataFrame:
    """For each row: doc_id, size, source_size, target, taken, copies.

    size is the number of words; a null or empty text has 0 and adds nothing.  A null source is a
    source of its own, last in order.  A source without words has target 0 and takes no copies.
    Repeated rows draw alike.  A null doc_id draws as the word null.  An empty table gives an
    empty result; columns other than doc_id, source and text are not read.
    """
    sized = settled(documents.select("doc_id", F.struct("source").alias("s"), word_count(F.col("text")).alias("size")))
    per_source = settled(sized.groupBy("s").agg(F.sum("size").alias("source_size")).select("s.source", "source_size"))
    rates = targets(per_source).select(F.struct("source").alias("s"), "source_size", "target", "rate")
    if per_source.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    drawn = sized.join(rates, "s")
    fraction = F.col("rate") - F.floor("rate")
    copies = (F.floor("rate") + F.when(unit_interval(F.col("doc_id"), seed) < fraction, 1).otherwise(0)).cast("long")
    return drawn.withColumn("copies", copies).select("doc_id", F.col("s.source").alias("source"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix(documents: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: every document as many times as its copies, with the input's columns.

    Nulls, empty texts, sources without words and repeated rows are as in `assign`; an empty table
    gives an empty result, and further columns, whatever their names, are carried along unchanged.
    """
    rates = settled(targets(settled(documents.select(F.struct("source").alias("s"), word_count(F.col("text")).alias("size")).groupBy("s").agg(F.sum("size").alias("source_size")).select("s.source", "source_size"))))
    key, rate, copy = (unused(documents, n) for n in ("mix_source", "mix_rate", "mix_copy"))
    small = rates.select(F.struct("source").alias(key), F.col("rate").alias(rate))
    if rates.count() <= BROADCAST_SOURCES:
        small = F.broadcast(small)
    joined = documents.withColumn(key, F.struct("source")).join(small, key)
    copies = (F.floor(rate) + F.when(unit_interval(F.col("doc_id"), seed) < F.col(rate) - F.floor(rate), 1).otherwise(0)).cast("int")
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(1), copies))).select(*documents.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
per_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM per_source),
filled AS (
  SELECT *, row_number() OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST) AS place,
         (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
leveled AS (
  SELECT *, arg_min(level, place) FILTER (WHERE weight * level < 2.0::DOUBLE * source_size) OVER () AS final FROM filled),
rated AS (
  SELECT *, CASE WHEN final IS NULL OR weight * final >= 2.0::DOUBLE * source_size THEN 2.0::DOUBLE * source_size ELSE weight * final END AS target FROM leveled),
drawn AS (
  SELECT s.doc_id, s.source, s.size, r.source_size, r.target,
         CASE WHEN r.source_size > 0 THEN r.target / r.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('{SEED}:' || coalesce(s.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source),
copied AS (
  SELECT *, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM drawn)
SELECT doc_id, source, size::BIGINT AS size, source_size, target, (size * copies)::BIGINT AS taken, copies FROM copied
"""
