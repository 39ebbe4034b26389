"""Sessions for jobs and for tests, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job of this library relies on. They are applied only where a
# session is built here; a cluster session passed in keeps its own values.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "possum") -> SparkSession:
    """A local session for tests and the bench (never used on a cluster)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    builder = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def job_session(app: str = "possum") -> SparkSession:
    """The session of a job started from the command line: the active one, or
    one with the master and settings of its launcher (``spark-submit``).

    Settings of ``DEFAULT_CONF`` that a running session can still take are made
    where the launcher left them unset."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.appName(app).getOrCreate()
    given = spark.sparkContext.getConf()
    for key, value in DEFAULT_CONF.items():
        if not given.contains(key) and spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    return spark


REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a query are removed as it ends; else they
    stay until the driver's garbage is collected. For queries that run once."""
    before = spark.conf.get(REMOVE_SHUFFLES, None)
    spark.conf.set(REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(REMOVE_SHUFFLES)
        else:
            spark.conf.set(REMOVE_SHUFFLES, before)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting names a shared file system folder and is left
    alone; without it a cluster session is refused. Only a local session gets a
    fresh scratch folder where the setting is unset.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        current = tempfile.mkdtemp(prefix="possum-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:  # each call would add a new sub-folder
        sc.setCheckpointDir(current)
    return current
