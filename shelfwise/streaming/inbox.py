"""Listings that arrive in a folder: a file stream over the inbox, each batch through the batch plan.

The stream's checkpoint remembers which files were read, so a deposit is processed once; state
tables are replaced by store (`Deposits`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfwise.config import RuleSet
from shelfwise.operators import catalogue
from shelfwise.plans.pipeline import Outcome, run_pipeline
from shelfwise.session import settled
from shelfwise.sources import listing, sinks


def inbox(spark: SparkSession, folder: str) -> DataFrame:
    """The stream of listing rows with their store and file."""
    raw = spark.readStream.schema(listing.schema()).option("header", True).option("multiLine", True).option("escape", '"').option("pathGlobFilter", "*.csv").csv(folder)
    clean = raw.drop("_corrupt").withColumns({c: F.translate(F.coalesce(c, F.lit("")), "\u0000", "") for c in listing.COLUMNS})
    return clean.withColumn("file", F.col("_metadata.file_path")).withColumn("store_id", listing.store_of(F.col("file")))


def process(spark: SparkSession, folder: str, state: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Runs what is in the inbox now and stops; `state` holds the stream's checkpoint."""
    return inbox(spark, folder).writeStream.foreachBatch(handle).option("checkpointLocation", state).trigger(availableNow=True).start()


def progress(query: StreamingQuery) -> list[dict]:
    """Finished batches: number, rows and milliseconds."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "ms": p["batchDuration"]} for p in query.recentProgress]


class Deposits:
    """The inbox with state: each file through the whole run into its store's part of the catalogue.

    `state` is a folder that all executors share.  It holds products and lineage by store, routes
    (file, where to) and runs; overrides and learned merges are read from it if they are there.
    A file of a batch that is handled again replaces what it wrote the first time, and a file that
    the report puts in quarantine changes nothing but its route.  The list of a batch's files is
    the driver's; their rows stay with the executors.
    """

    def __init__(self, state: str, rules: RuleSet | None = None, statuses: DataFrame | None = None, network: bool = False):
        self.state, self.rules, self.statuses, self.network = state.rstrip("/"), rules or RuleSet.load(), statuses, network

    def read(self, spark: SparkSession, table: str) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{self.state}/{table}")
        except AnalysisException as missing:
            if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = settled(batch.withColumn("row_seq", F.monotonically_increasing_id()))
        files = rows.groupBy("store_id", "file").agg(F.count(F.lit(1)).alias("rows")).orderBy("file").collect()
        routes = []
        for store, file, n in files:
            learned = self.read(spark, "learned")
            mine = learned if learned is None else learned.where(F.col("store_id") == store).select("label", "into")
            out = run_pipeline(rows.where(F.col("file") == file).drop("store_id", "file"), self.rules, f"{number}:{file}", self.statuses, None, mine, self.network)
            stopped = bool(out.report.select("quarantined").first()[0])
            routes.append((number, store, file, n, "quarantine" if stopped else "processed"))
            if not stopped:
                self._keep(spark, store, out)
        spark.createDataFrame(routes, "batch long, store_id string, file string, rows long, route string").coalesce(1).write.mode("overwrite").parquet(f"{self.state}/routes/batch={number}")

    def _keep(self, spark: SparkSession, store: str, out: Outcome) -> None:
        fresh = out.records.withColumns({"store_id": F.lit(store), "product_key": F.col("key")})
        overrides = self.read(spark, "overrides")
        if overrides is not None:
            fresh = catalogue.replay_overrides(fresh, overrides, ("label", "ean"))
        known = self.read(spark, "products")
        if known is not None:
            old = known.where(F.col("store_id") == store).drop("change")
            fresh = catalogue.merge_snapshot(old, fresh.select(*old.columns))
        else:
            fresh = fresh.withColumn("change", F.lit("inserted"))
        sinks.overwrite_partition(settled(fresh.where("change <> 'retired'")), f"{self.state}/products", "store_id")
        sinks.overwrite_partition(settled(out.lineage.withColumn("store_id", F.lit(store))), f"{self.state}/lineage", "store_id")
