"""A local session with the settings the library expects; on a cluster the given session is used as it is."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local(cores: str = "*", app: str = "tallyframe", partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the checkpoint folder that was set by hand.

    A folder of this machine is taken only where the session is local, as in tests; elsewhere none is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    by_hand = sc._jsc.sc().getCheckpointDir()
    if by_hand.isDefined():
        return by_hand.get().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.gettempdir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder; lineage ends there."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Asks the driver to collect its garbage, between the rounds of a loop.

    Spark removes the files of a shuffle once nothing on the driver names it, and those of a checkpoint too where
    spark.cleaner.referenceTracking.cleanCheckpoints is set; without a collection the files of every round stay to the end."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows that small() broadcasts at most.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df computed and kept, with a hint to broadcast it if it has no more than `rows`."""
    kept = checkpointed(df)
    return F.broadcast(kept) if kept.count() <= rows else kept
