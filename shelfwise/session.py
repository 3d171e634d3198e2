"""Session helpers: a local session for tests and benches, and lineage cuts in shared storage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session as tests and the bench use it; a cluster brings its own."""
    session = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("shelfwise")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Leaves the session's checkpoint folder as it is; sets one only where none is set.

    A cluster names its shared folder in ``spark.checkpoint.dir``.  Without that setting a local
    master gets a temporary folder, any other master a folder below the warehouse, which all
    executors share.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = context.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if context.master.startswith("local") and not context.master.startswith("local-cluster"):
            named = tempfile.mkdtemp(prefix="shelfwise-checkpoints-")
        else:
            named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    context.setCheckpointDir(named)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """`df` over every core: a scan with fewer partitions than cores (one row group is one task) is hashed by `keys`."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def settled(df: DataFrame) -> DataFrame:
    """The rows of `df`, computed once and read again from the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
