"""Session settings, reliable lineage cuts and size checks shared by all operators."""

from __future__ import annotations

import gc
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# All of these can be changed at run time, so a session made elsewhere can be configured too.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Tables hash-partitioned by graph_id may be joined on (graph_id, node_id) without a new exchange.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # Vector aggregates keep their map-side hash tables instead of falling back to sorting at 128 keys.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "16384",
    # Row-number limits of wide beams are applied in every task before the shuffle, too.
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
    # Unions of tables partitioned alike do not claim their partitioning (see plans.skew.safe_unions).
    "spark.sql.unionOutputPartitioning": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}

# Largest table, in cells, that may be sent to every task (8 bytes a cell: 256 MiB).
BROADCAST_CELLS = 1 << 25
# Rows that a task sorts or groups where a job is dealt by the size of its input.
ROWS_A_PART = 1 << 19
# Largest number of keys that may be sent to every task.
BROADCAST_KEYS = 100_000


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings and make sure a checkpoint folder is known."""
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per context, so that tasks can import it wherever the driver runs."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="spark-")
    archive = shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name)
    context.addPyFile(archive)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared checkpoint folder; only a local session gets one of its own."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(named)
    return named


def get_session(app: str = "braidvec", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """Session for tests and the bench; on a cluster, pass your own session to ``configure``."""
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    spark = builder.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def parts_for(kept: DataFrame) -> int:
    """Parts to deal the rows of a persisted table into, so that a task's share does not grow with the table."""
    spark = kept.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-kept.count() // ROWS_A_PART))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files, and checkpoints where the session cleans them, of tables that are no longer known; otherwise
    they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
